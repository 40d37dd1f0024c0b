import random

from websource_audit.llm import decontaminate as D


def shingles(text, n=5):
    w = (text or "").lower().split()
    return set() if not w else {tuple(w)} if len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def brute(docs, items, percent=80):
    out = set()
    for d, t in docs:
        for i, u in items:
            a, b = shingles(u), shingles(t)
            if i is not None and a and 100 * len(a & b) >= percent * len(a):
                out.add((d, i, len(a), len(a & b)))
    return out


def test_equals_brute_force(spark, documents):
    rnd = random.Random(9)
    vocab = [f"w{k}" for k in range(40)]
    words = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(words(rnd.randint(1, 60)))) for k in range(30)] + [(100, None), (101, ""), (None, "a b c d e f")]
    docs = []
    for k in range(120):
        text = words(rnd.randint(0, 400))
        for _ in range(rnd.randint(0, 3)):
            part = (rnd.choice(items)[1] or "").split()
            if part and rnd.random() < 0.5:
                part[rnd.randrange(len(part))] = "changed"
            at = rnd.randint(0, len(text))
            text[at:at] = [w.upper() for w in part]
        docs.append((k, " ".join(text)))
    docs += [(500, None), (501, ""), (502, items[0][1]), (503, "w1 w2")]
    bench = spark.createDataFrame(items + [(600, "w1 w2"), items[0]], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in D.contained_items(documents(docs), bench).collect()}
    assert got == brute(docs, items + [(600, "w1 w2")]) and len(got) > 20
    D.BLOCK_ITEMS, keep = 7, D.BLOCK_ITEMS
    try:
        assert {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in D.contained_items(documents(docs), bench).collect()} == got
    finally:
        D.BLOCK_ITEMS = keep
    left = {r.doc_id for r in D.drop_contaminated(documents(docs), bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, *_ in got}


def test_texts_of_one_item_id_and_clashing_columns(spark, documents):
    bench = spark.createDataFrame([(7, "a b c d e f g"), (7, "p q r s t u v"), (None, "k l m n o p")], "item_id long, text string")
    docs = documents(["x a b c d e f g", "p q r s t u v y", "k l m n o p"]).withColumnRenamed("source", "hit_id").withColumnRenamed("lang", "item_id")
    assert sorted(r.doc_id for r in D.contained_items(docs, bench).collect()) == [0, 1]
    assert [r.doc_id for r in D.drop_contaminated(docs, bench).collect()] == [2]


def test_empty(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contained_items(documents(["a b"]), none).count() == 0
    assert D.drop_contaminated(documents([]), none).count() == 0
