import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from websource_audit.llm import collocations as C
from websource_audit.llm import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least=30, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = set()
    for (lang, w), a in cands.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * a >= 80 * f[lang, w[i : i + k]]:
                    covered.add((lang, w[i : i + k]))
    rows = {}
    for (lang, w), a in cands.items():
        if (lang, w) in covered:
            continue
        cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out = []
    for lang, xs in rows.items():
        out += [(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(xs)[:top])]
    return sorted(out)


def got(frame, **options):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in C.collocations(frame, **options).collect())


def made(seed, count=300):
    rnd = random.Random(seed)
    words = ["the", "of", "In", "é", "naïve", "x" * 90, "\x01odd", "日本", "a-b", "C"] + [f"w{k}" for k in range(40)]
    rows = []
    for k in range(count):
        text = ""
        for _ in range(rnd.randint(0, 60)):
            text += "new york city hall" if rnd.random() < 0.1 else rnd.choice(words[: rnd.choice([4, 10, 50])])
            text += rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; "])
        rows.append((k, text, rnd.choice(["en", "en", "de", None, "und", ""])))
    return rows + [(900, None, "en"), (901, "", None), (902, "...,;", "fr"), (903, "hot pair " * 20000, "en"), rows[0], rows[0]]


SMALL = C.Limits(word_ids=7, id_bytes=8, hot_share=20, feed=50, burst=6, entries=40, run=5, part_words=900, merge=12)


@pytest.mark.parametrize("limits", [C.Limits(), SMALL, SMALL._replace(word_ids=1 << 19, id_bytes=99), C.Limits(hot_share=3, word_ids=1)])
def test_equals_brute_force_under_any_limits(spark, limits):
    """Small limits lead through bursts, spills, merges in steps, sums over partitions, and phrases that travel as text."""
    rows = made(1)
    want = brute(rows, 4)
    assert len(want) > 100
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(4), least=4, limits=limits) == want


def test_ranks_and_ties(spark, monkeypatch):
    rows = made(2, 200)
    frame = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(C, "RANKED", 20)  # read on the driver only
    assert got(frame, least=5, top=15) == brute(rows, 5, 15)


def test_clashing_columns_and_empty_tables(spark):
    rows = made(3, 60)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as f", "2 as n", "'x' as phrase", "3 as part", "4 as t", "5 as word", "6 as score")
    assert got(frame, least=8) == brute(rows, 8)
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(1, None, None), (2, " . ", "en")], SCHEMA)) == []


def test_trie_counts_bursts_and_spills():
    rnd = np.random.default_rng(5)
    ids = rnd.integers(0, 9, 4000)
    limits = C.Limits(burst=10, entries=300, run=7)
    trie, out = C.HatTrie(2, 5, limits), []
    for part in np.array_split(ids, 9):
        out += list(trie.feed("en", np.append(part, 0)))
    assert out and trie.size <= 300
    assert any(len(t.held) > 1 for t in trie.roots["en"].values())
    out += list(trie.spill(trie.size))
    assert trie.size == 0
    seen = Counter()
    for b in out:
        row = b.to_pylist()[0]
        first, rest, count = C.unpacked(row["run"])
        keys = list(zip(first.tolist(), rest.tolist(), strict=True))
        assert keys == sorted(set(keys)) and len(keys) <= 7 and (row["low"], row["lowest"]) == keys[0]
        assert set(C.parts_of("en", first, rest, 2, 5).tolist()) == {row["part"]}
        seen.update(dict(zip(keys, count.tolist(), strict=True)))
    want = Counter()
    for part in np.array_split(ids, 9):
        p = part.tolist()
        for i in range(len(p)):
            w = p[i : i + 4]
            w = w[: w.index(0)] if 0 in w else w
            if len(w) > 1:
                w += [0] * (4 - len(w))
                want[w[0], w[1] << 40 | w[2] << 20 | w[3]] += 1
    assert seen == want


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = queries.op11_collocations(spark, SF).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out) == brute(rows)
