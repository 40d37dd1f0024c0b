import corpus_pipeline
from test_decontaminate import brute as leaks
from test_jaccard_join import brute as near
from packing_checks import check_packing

from websource_audit.llm import quality, secret_scan
from websource_audit.llm.common import read_table


def test_stages_against_brute_force(spark):
    """Each stage of the smallest corpus against brute force on its own input."""
    sf = "/root/testdata/sf0.001"
    docs, names = read_table(spark, sf, "documents"), [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    columns = docs.columns
    kept = corpus_pipeline.keep_good(spark, docs, sf)
    labels = {r.doc_id: r.quality for r in read_table(spark, sf, "labels").collect()}
    held = {r.doc_id for r in kept.collect()}
    wrong = sum((i in held) != bool(q) for i, q in labels.items())
    assert kept.columns == columns and wrong <= 0.02 * len(labels) and quality.THRESHOLD == 0.5
    one = corpus_pipeline.keep_one_of_each(spark, kept, sf)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {c for _, c in near(rows).values()}
    clean = corpus_pipeline.drop_benchmark(spark, one, sf)
    rows = [(r.doc_id, r.text) for r in one.collect()]
    items = [(r.item_id, r.text) for r in read_table(spark, sf, "benchmark").collect()]
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {d for d, *_ in leaks(rows, items)}
    safe = corpus_pipeline.redact_secrets(spark, clean, sf)
    before = {r.doc_id: r.text for r in clean.collect()}
    after = {r.doc_id: r.text for r in safe.collect()}
    assert safe.columns == columns and set(before) == set(after)
    spans = {r.path: r.spans for r in secret_scan.scan_documents(clean).collect()}
    assert {i for i in before if before[i] != after[i]} == {i for i, s in spans.items() if s}
    assert all(not r.spans for r in secret_scan.scan_documents(safe).collect())
    check_packing(corpus_pipeline.pack(spark, safe, sf).collect(), list(after.items()), 4096)
