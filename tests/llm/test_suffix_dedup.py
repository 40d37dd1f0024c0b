import hashlib
import random

import pytest

from websource_audit.llm import suffix_dedup as S


def brute(rows, length=S.LENGTH):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out[doc] = (len(raw), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def got(df, **limits):
    return {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in S.without_repeats(df, **limits).collect()}


def make(rnd, docs):
    base = ["".join(rnd.choice("ab cdé") for _ in range(400)) for _ in range(4)]
    rows = []
    for d in range(docs):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            k, b = rnd.random(), rnd.choice(base)
            if k < 0.5:
                a = rnd.randint(0, 300)
                parts.append(b[a : a + rnd.randint(60, 200)])
            elif k < 0.7:
                parts.append("xyz " * rnd.randint(1, 80))
            else:
                parts.append("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 150))))
        rows.append((d, "".join(parts)))
    return [*rows, (docs + 1, None), (docs + 2, rows[3][1]), (docs + 3, rows[3][1]), (docs + 4, "q" * 5000)]


@pytest.mark.parametrize("seed,pairwise,segment", [(1, S.PAIRWISE, S.SEGMENT), (2, 0, 37), (3, 1, 150)])
def test_equals_brute_force(spark, documents, seed, pairwise, segment):
    rows = make(random.Random(seed), 60)
    assert got(documents(rows).repartition(3), pairwise=pairwise, segment=segment) == brute(rows)


def test_text_beyond_a_segment(spark, documents):
    """Long texts with a repeat across the place where segments meet."""
    rnd = random.Random(8)
    own = lambda n: "".join(rnd.choices("abcdefghijklmnop ", k=n))
    shared = own(400)
    rows = [(1, own(S.SEGMENT - 150) + shared + own(300)), (2, own(40) + shared + own(20)), (3, own(S.SEGMENT + 5000))]
    out = {r.doc_id: [(s["from"], s["to"]) for s in r.spans] for r in S.without_repeats(documents(rows)).collect()}
    assert out[1] == [] and out[3] == [] and len(out[2]) == 1
    a, b = out[2][0]
    assert a <= 40 and b >= 440 and b - a < 420


def test_window_by_window_equals_pairs():
    rnd = random.Random(6)
    gram = bytes(rnd.choice(b"ab") for _ in range(S.GRAM))
    group = []
    for doc in range(60):
        left = bytes(rnd.choice(b"ab") for _ in range(2)) + b"l" * 40
        right = gram + b"r" * 50 + bytes(rnd.choice(b"ab") for _ in range(20))
        group.append((right, (left, doc, 0, len(left) + len(right) - S.LENGTH + 1)))
    windows = lambda group, pairwise: {(d, k) for d, a, b in S.repeated_windows(group, pairwise) for k in range(a, b + 1)}
    assert windows(group[:12], 0) == windows(group[:12], 12)
    assert windows(group, 12) == windows(group, 100)


def test_loser_tree_merges_front_coded_runs():
    rnd = random.Random(5)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted((bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 12))), b"", rnd.randint(0, 99), 0, 1) for _ in range(rnd.randint(1, 20))) for _ in range(k)]
        out = list(S.merge_runs([S.read_run(S.write_run(r)) for r in runs]))
        assert [s for _, s, _ in out] == sorted(s for r in runs for s, *_ in r)
        last = b""
        for shared, s, _ in out:
            assert shared == S.lcp(last, s)
            last = s


def test_odd_tables(spark, documents):
    assert S.without_repeats(documents([])).count() == 0
    t, u = "ab" * 100, "cd" * 100
    out = S.without_repeats(documents([(1, t), (1, t), (2, t), (None, t), (None, None), (3, u), (3, "e" * 90)]).withColumnRenamed("lang", "spans")).collect()
    kept = {r.doc_id: r.n_removed for r in out if r.doc_id == 2}
    assert kept == {2: 200} and len(out) == 7 and all(r.n_removed == 0 for r in out if r.doc_id is None)


@pytest.mark.parametrize("seed,hot", [(1, 0), (2, 4)])
def test_frequent_grams_are_not_gathered(spark, documents, seed, hot, monkeypatch):
    """A line in all documents between differing neighbours: none of its contexts reaches a merged run."""
    monkeypatch.setattr(S, "HOT_GRAM", hot, raising=False)
    written, stash = {}, S.stash
    monkeypatch.setattr(S, "stash", lambda df, name: written.setdefault(name, stash(df, name)))
    rnd = random.Random(seed)
    line = "".join(rnd.choice("abcdefgh ") for _ in range(70))
    own = lambda n: "".join(rnd.choice("ijklmnop") for _ in range(n))
    near = [own(40) for _ in range(3)]
    rows = [(d, own(60) + rnd.choice(near) + line + rnd.choice(near) + own(60)) for d in range(40)]
    assert got(documents(rows).repartition(3)) == brute(rows)
    assert written["shared"].count() > 0
    most = written["runs"].filter("part is not null").select("data").collect()
    assert sum(1 for r in most for _, s, _ in S.read_run(r.data) if s[: S.GRAM].decode() in line) == 0
    rows = make(rnd, 60)
    written.clear()
    assert got(documents(rows).repartition(3)) == brute(rows)
