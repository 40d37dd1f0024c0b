import random

import pytest

from websource_audit.llm import jaccard_join as J
from websource_audit.llm.components import components


def sets_of(text, n=5):
    w = (text or "").lower().split()
    return set() if not w else {tuple(w)} if len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def roots(nodes, links):
    up = {x: x for x in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}


def brute(rows, percent=80):
    s = {k: sets_of(t) for k, t in rows}
    ids = sorted(s)
    links = [(a, b) for a in ids for b in ids if a < b and s[a] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    r = roots(ids, links)
    return {k: (len(s[k]), r[k]) for k in ids}


def changed(rnd, words, share):
    return [rnd.choice("xyz") + str(rnd.randint(0, 999)) if rnd.random() < share else w for w in words]


@pytest.mark.parametrize("seed, few", [(1, 4), (2, 4), (2, 1), (3, 30)])
def test_equals_brute_force(spark, documents, seed, few, monkeypatch):
    """Columns of at most ``few`` documents are multiplied out at once, the others after leader rounds."""
    monkeypatch.setattr(J, "FEW_DOCS", few)
    rnd = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    rows, base = [], []
    for k in range(160):
        kind = rnd.random()
        if base and kind < 0.45:
            words = changed(rnd, rnd.choice(base), rnd.choice([0, 0.01, 0.03, 0.05]))
            words = words[rnd.randint(0, 8) :]
        elif kind < 0.7:
            words = [f"u{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(0, 120))] + passage
        else:
            words = [f"u{rnd.randint(0, 300)}" for _ in range(rnd.randint(0, 150))]
            base.append(words)
        rows.append((k, " ".join(words)))
    rows += [(500, None), (501, ""), (502, "A b"), (503, "a B"), (504, "a b c")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_copies(documents(rows).repartition(5)).collect()}
    assert got == brute(rows)
    left = {r.doc_id for r in J.one_of_each(documents(rows)).collect()}
    assert left == {c for _, c in got.values()}


def test_large_group_of_near_copies(spark, documents):
    """Members differ so much from the leaders that later rounds and the product have to join them."""
    rnd = random.Random(8)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for k in range(120):
        words = list(base)
        for at in range(0, k, 4):
            words[at % 200] = f"c{at}"
        rows.append((k, " ".join(words)))
    rnd.shuffle(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_copies(documents(rows).repartition(4)).collect()} == brute(rows)


def test_odd_tables(spark, documents):
    assert J.near_copies(documents([])).count() == 0
    same = documents([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None)]).withColumnRenamed("lang", "component_id")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.near_copies(same).collect()), key=str)
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 0, None), (None, 2, None)]
    two = documents([(1, "a b c d e f"), (1, "g h i j k l"), (3, "g h i j k l"), (4, "z")])
    assert {(r.doc_id, r.component_id) for r in J.near_copies(two).collect()} == {(1, 1), (3, 1), (4, 4)}


def test_three_texts_of_one_id_and_clashing_columns(spark, documents):
    texts = ["a b c d e f", "g h i j k l", "m n o p q r"]
    docs = documents([(9, t) for t in texts] + [(k, t) for k, t in enumerate(texts)] + [(5, "m n o p q r s")])
    docs = docs.withColumnRenamed("lang", "copy_id").withColumnRenamed("source", "_drop")
    assert {(r.doc_id, r.component_id) for r in J.near_copies(docs, percent=60).collect()} == {(9, 0), (0, 0), (1, 0), (2, 0), (5, 0)}
    assert {r.doc_id for r in J.one_of_each(docs, percent=60).collect()} == {0}


def test_passages_shared_in_all_ways(spark, documents, monkeypatch):
    """Texts made of stock passages: nearly all pairs share some, none is similar; counts discard them before any text is read."""
    rnd = random.Random(4)
    stock = [" ".join(f"s{p}w{k}" for k in range(30)) for p in range(60)]
    seen = []
    whole = J.verified
    monkeypatch.setattr(J, "verified", lambda pairs, *more: seen.append(pairs.count()) or whole(pairs, *more))
    monkeypatch.setattr(J, "BUCKET_DOCS", 20)
    rows = [(k, " ".join(rnd.sample(stock, 6))) for k in range(400)]
    rows += [(1000, rows[0][1]), (1001, rows[1][1] + " tail")]
    got = {r.doc_id: r.component_id for r in J.near_copies(documents(rows)).collect()}
    assert got == {k: c for k, (_, c) in brute(rows).items()} and got[1001] == 1
    assert sum(seen) <= len(rows)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 160)] + [(200, k) for k in range(201, 260)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == roots(sorted(nodes), [e for e in edges if e[0] != e[1]])
    assert components(df.limit(0)).count() == 0
