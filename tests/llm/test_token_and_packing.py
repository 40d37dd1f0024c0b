import random

import numpy as np
from packing_checks import check_packing, ids_of

from websource_audit.llm import common, packing, token_counts
from websource_audit.llm.common import TokenIds, WordHashes, default_tokenizer, shingle_hashes

ODD = ["", None, "The cat's (paws), don't 123,45 ÀÉ. Straße, <|endoftext|>x été", "naïve,façade. ÿÿ. ß, ªb µm. ___ a_b --- ...a", "x\x1cy a​b   　c", "İstanbul ΑΣ. ΑΣ", "word " * 5000]


def test_chunked_ids_equal_the_tokenizer():
    cache = TokenIds(default_tokenizer())
    for text in ODD:
        assert np.frombuffer(cache.of(text), "<u4").tolist() == ids_of(text)


def test_word_hashes_do_not_depend_on_what_stands_around(monkeypatch):
    """Equal words have equal hashes in any window, text or case; other words have others."""
    monkeypatch.setattr(common, "WINDOW_BYTES", 700)
    words = [f"W{k % 37}x" * (1 + k % 3) for k in range(400)] + ["long" * 200, "LONG" * 200, "l" * 3000, "é" * 900, "end"]
    texts = [None, "", " \t", "one", " ".join(words), "\n".join(words[:3]) + "\x0b", " ".join(words[::-1]), words[402], words[402] + " x"]
    got = [x.tolist() for x in WordHashes().each(texts)]
    seen = {}
    for text, hashes in zip(texts, got, strict=True):
        own = common.words_of(text)
        assert len(own) == len(hashes)
        for w, h in zip(own, hashes, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(shingle_hashes(np.array(got[4], np.uint64))) == len(words) - 4 and len(shingle_hashes(np.array(got[3], np.uint64))) == 1


def test_histogram_and_limits(spark, documents):
    rows = [*ODD, "a b c", "a b c"]
    lengths = sorted(len(ids_of(t)) for t in rows)
    docs = documents(rows).withColumnRenamed("lang", "length")  # a clashing name is not read
    h = token_counts.length_histogram(docs)
    assert {r.length: r.n_docs for r in h.collect()} == {x: lengths.count(x) for x in lengths}
    for r in token_counts.limit_answers(h).collect():
        assert r.docs_from == sum(x >= r.length for x in lengths)
        assert r.tokens_from == sum(x for x in lengths if x >= r.length)
        assert r.truncated_tokens == sum(min(x, r.length) for x in lengths)
        assert r.docs_cut == sum(x > r.length for x in lengths)
    got = {r.context_limit: r for r in token_counts.totals_at(h, [1, 7, 10_000]).collect()}
    assert {k: r.truncated_tokens for k, r in got.items()} == {k: sum(min(x, k) for x in lengths) for k in (1, 7, 10_000)}
    assert token_counts.length_quantile(token_counts.limit_answers(h), 0.5).first()[0] == lengths[(len(lengths) + 1) // 2 - 1]
    assert token_counts.limit_answers(token_counts.length_histogram(documents([]))).count() == 0


def test_packing_round_trip(spark, documents):
    rnd = random.Random(3)
    docs = [(k, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 90)))) for k in range(80)] + [(90, None), (91, "x " * 200), (92, "")]
    out = packing.pack(documents(docs).repartition(3), capacity=64).collect()
    used = check_packing(out, docs, 64)
    assert used <= -(-sum(r.length for r in out) // 64) + 2
    assert packing.pack(documents([])).count() == 0


def fewest(sizes, capacity):
    """Brute force by branch and bound."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[k] <= capacity and bins[j] not in bins[:j]:
                go(k + 1, [*bins[:j], bins[j] + sizes[k], *bins[j + 1 :]])
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return best[0]


def test_dominance_fixes_only_what_an_optimum_may_hold():
    rnd = random.Random(1)
    for _ in range(150):
        c = rnd.randint(6, 20)
        sizes = [rnd.randint(1, c) for _ in range(rnd.randint(1, 8))]
        counts = {x: sizes.count(x) for x in sizes}
        plan = packing.Plan(c)
        left = packing.reduce_by_dominance(dict(counts), plan)
        rest = [x for x, n in left.items() for _ in range(n)]
        assert sum(n for n, _ in plan.groups) + fewest(rest, c) == fewest(sizes, c)
        whole = packing.plan_of(counts, c)
        held = sorted(x for n, items in whole.groups for x, m in items for _ in range(n * m))
        assert held == sorted(sizes) and all(sum(x * m for x, m in items) <= c for _, items in whole.groups)
