import itertools
import os
import random

import pytest
import xxhash

from websource_audit.llm import queries
from websource_audit.llm import simhash as S

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words, cut = [], ""
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if c in " \t\n\x0b\x0c\r":
            words.append(cut)
            cut = ""
        else:
            cut += c
    words = [w for w in [*words, cut] if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components_of(fps, radius):
    """{fp: root}: the smallest fingerprint (unsigned) reached by links, by brute force."""
    up = {x: x for x in fps}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(up), 2):
        if (a ^ b).bit_count() <= radius:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {x: top(x) for x in up}


def brute(rows, radius=3):
    own = [(d, plain_fingerprint(t)) for d, t in rows]
    roots = components_of([f for _, f in own], radius)
    names = {}
    for d, f in own:
        if d is not None:
            names[roots[f]] = min(d, names.get(roots[f], d))
    return sorted(((d, f"{f:016x}", names.get(roots[f])) for d, f in own), key=str)


def got(spark, frame, **options):
    return sorted(((r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in S.near_copies(frame, **options).collect()), key=str)


@pytest.mark.parametrize("radius", [1, 2, 3])
@pytest.mark.parametrize("open_bits", [2**64 - 1, 0x00FF_0F0F_1234_FFFF, 0b1111])
def test_masks_cover_every_choice_of_bits(radius, open_bits):
    masks = S.covering_masks(open_bits, radius)
    places = [k for k in range(64) if open_bits >> k & 1]
    rnd = random.Random(radius)
    picks = itertools.combinations(places, radius) if len(places) < 20 else (rnd.sample(places, radius) for _ in range(5000))
    for pick in picks:
        assert any(not any(m >> k & 1 for k in pick) for m in masks)
    assert all(m & ~open_bits == 0 for m in masks)


@pytest.mark.parametrize("bucket", [4, 1024])
def test_links_equal_brute_force(spark, bucket):
    """Balls of fingerprints around centres: with a small bucket limit they pass through every refinement."""
    rnd = random.Random(bucket)
    fps = {0, 2**64 - 1}
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(40):
            x = centre
            for _ in range(rnd.randint(0, 5)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    table = spark.createDataFrame([(S._signed(x),) for x in fps], "fp long")
    pairs = [(r.a % 2**64, r.b % 2**64) for r in S.links(table, 3, bucket).collect()]
    assert pairs and all(a != b for a, b in pairs)
    up = {x: {x} for x in fps}
    for a, b in pairs:
        if up[a] is not up[b]:
            up[a] |= up[b]
            for x in up[b]:
                up[x] = up[a]
    assert {x: min(up[x]) for x in fps} == components_of(fps, 3)


def test_dense_ball_in_one_bucket(spark):
    """Every fingerprint within one bit of a centre, and of a second centre two bits off."""
    centre = random.Random(5).getrandbits(64)
    fps = {c ^ (1 << k) for c in (centre, centre ^ 3) for k in range(64)} | {centre}
    table = spark.createDataFrame([(S._signed(x),) for x in fps], "fp long")
    assert S.links(table, 3, 16).count() < 15 * len(fps) * 15
    roots = {r.root for r in S.components(S.links(table, 3, 16)).collect()}
    assert len(roots) == 1


def test_equals_brute_force(spark, documents):
    rnd = random.Random(3)
    rows, base = [], []
    for k in range(150):
        if base and rnd.random() < 0.6:
            words = list(rnd.choice(base))
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(len(words))] = f"n{rnd.randint(0, 99)}"
        else:
            words = [f"W{rnd.randint(0, 500)}" for _ in range(rnd.randint(1, 300))]
            base.append(words)
        rows.append((k, rnd.choice([" ", "\t", " \n "]).join(words)))
    rows += [(500, None), (501, ""), (499, " \n"), (502, "one"), (503, "ONE"), (504, "a b"), (505, "é É"), (506, "long " * 90000), (506, "other text of one id"), (None, "one"), (None, "nothing else is like this"), (3, rows[3][1])]
    table = documents(rows).repartition(5)
    assert got(spark, table) == brute(rows)
    clash = table.selectExpr("doc_id", "text", "1 as fp", "2 as n", "3 as key", "4 as kept", "5 as root", "6 as component_id")
    assert got(spark, clash) == brute(rows)


def test_long_text_is_hashed_whole(monkeypatch):
    rnd = random.Random(9)
    text = " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(5000))
    whole = S.fingerprint(text)
    assert whole == plain_fingerprint(text)
    monkeypatch.setattr(S, "WINDOW", 37)
    assert S.fingerprint(text) == whole


def test_empty_table(spark, documents):
    assert S.near_copies(documents([])).collect() == []


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = queries.op13_simhash(spark, SF).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in out), key=str) == brute(rows)
