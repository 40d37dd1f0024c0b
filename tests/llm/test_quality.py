import math
import random

import pytest
from pyspark.sql import functions as F

from websource_audit.llm import quality as Q


def corpus(spark, n=400):
    rnd = random.Random(12)
    rows, labels = [], []
    for k in range(n):
        bad = rnd.random() < 0.3
        words = [rnd.choice(["and", "that", "reader", "of", "stone", "river"]) for _ in range(rnd.randint(3, 80))]
        text = " ".join(w.upper() + "!!" if bad and rnd.random() < 0.7 else w + ("$$$" if bad else "") for w in words)
        rows.append((k, text, rnd.choice("ab"), rnd.choice("xy")))
        labels.append((k, 0 if bad else 1, 0))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    train = labels.filter("doc_id < 200")
    got = Q.with_quality(docs, train, F.col("source"), F.col("lang")).select("doc.doc_id", "keep").join(labels, "doc_id").filter("doc_id >= 200").collect()
    assert len(got) == 200 and sum(r.keep == bool(r.quality) for r in got) >= 196
    both = {r.doc_id: r.keep for r in Q.with_quality(docs, train, F.col("source"), F.col("lang"), keep_text=False).select("doc.doc_id", "keep").collect()}
    assert both == {r.doc_id: r.keep for r in Q.with_quality(docs, train, F.col("source"), F.col("lang")).select("doc.doc_id", "keep").collect()}
    assert Q.keep_good(docs, train, F.col("source"), F.col("lang")).columns == docs.columns


def by_hand(rows):
    """(host_share, path_share) of (host, path, log_odds) rows, written down from the definitions, one document at a time."""
    p = [1 / (1 + math.exp(-x)) for _, _, x in rows]
    groups = lambda key: {k: [i for i, r in enumerate(rows) if key(r) == k] for k in {key(r) for r in rows}}
    hosts, paths = groups(lambda r: r[0]), groups(lambda r: r[:2])
    mean = lambda own: sum(p[i] for i in own) / len(own)
    total = mean(range(len(p)))
    inside = lambda gs: sum((p[i] - mean(own)) ** 2 for own in gs.values() for i in own) / (len(p) - len(gs))
    up = lambda own: mean(hosts[rows[own[0]][0]])
    host_extra = (sum(len(o) * (mean(o) - total) ** 2 for o in hosts.values()) - (len(hosts) - 1) * inside(hosts)) / (len(p) - sum(len(o) ** 2 for o in hosts.values()) / len(p))
    path_extra = (sum(len(o) * (mean(o) - up(o)) ** 2 for o in paths.values()) - (len(paths) - len(hosts)) * inside(paths)) / (len(p) - sum(len(o) ** 2 / len(hosts[k[0]]) for k, o in paths.items()))
    bound = lambda x: min(max(x, 1.0), 1e6)
    kh, kp = bound(inside(hosts) / max(host_extra, 1e-12)), bound(inside(paths) / max(path_extra, 1e-12))
    out = []
    for i, (h, q, _) in enumerate(rows):
        rest, own = [j for j in hosts[h] if j != i], [j for j in paths[h, q] if j != i]
        host = (sum(p[j] for j in rest) + kh * total) / (len(rest) + kh)
        out.append((host, (sum(p[j] for j in own) + kp * host) / (len(own) + kp)))
    return out


@pytest.mark.parametrize("seed,host_effect,path_effect", [(1, 2.0, 1.0), (2, 0.0, 0.0), (3, 3.0, 0.0)])
def test_posteriors_equal_those_by_hand(spark, seed, host_effect, path_effect):
    rnd = random.Random(seed)
    hosts = {h: rnd.gauss(0, host_effect) for h in ("a", "b", "c", "d", None)}
    paths = {(h, q): rnd.gauss(0, path_effect) for h in hosts for q in ("x", "y", None)}
    rows = [(h, q, hosts[h] + paths[h, q] + rnd.gauss(0, 1)) for h, q in (rnd.choice(list(paths)) for _ in range(300))]
    rows += [("single", "s", 3.0)]
    got = Q.with_posteriors(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "host string, path string, log_odds double, n long")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host_share, r.path_share) == pytest.approx(by_hand(rows)[r.n] if r.n % 20 == 0 else (r.host_share, r.path_share), rel=1e-9)


def test_planted_host_decides_where_texts_do_not(spark):
    """Plain texts of a host full of junk are judged by it, the same texts elsewhere are not; sparse hosts stay near the global share."""
    docs, labels = corpus(spark)
    doubtful = docs.filter("doc_id < 20").select((F.col("doc_id") + 1000).alias("doc_id"), F.lit("and THAT!! reader of stone$$$").alias("text"), "lang")
    junk = docs.join(labels.filter("quality = 0"), "doc_id").select(F.col("doc_id") + 2000, "text", F.lit("x").alias("lang"), F.lit("junk").alias("source"))
    good = docs.join(labels.filter("quality = 1"), "doc_id").select(F.col("doc_id") + 4000, "text", F.lit("x").alias("lang"), F.lit("fine").alias("source"))
    every = junk.union(good).toDF("doc_id", "text", "lang", "source")
    for k, host in enumerate(("junk", "fine", "sparse")):
        every = every.unionByName(doubtful.select(F.col("doc_id") + 10_000 * (k + 1), "text", F.lit("x").alias("lang"), F.lit(host).alias("source")).toDF("doc_id", "text", "lang", "source").limit(20 if k < 2 else 2))
    train = labels.select((F.col("doc_id") + 2000).alias("doc_id"), "quality").unionByName(labels.select((F.col("doc_id") + 4000).alias("doc_id"), "quality"))
    got = Q.with_quality(every, train, F.col("source"), F.col("lang")).filter("doc.doc_id >= 10000").select("doc.source", "log_odds", "path_share", "quality").collect()
    mean = {h: sum(r.quality for r in got if r.source == h) / sum(r.source == h for r in got) for h in ("junk", "fine", "sparse")}
    assert len({round(r.log_odds, 9) for r in got}) == 1
    assert mean["junk"] < mean["sparse"] < mean["fine"]


def test_odd_tables(spark, documents):
    docs = documents([None, "", "x", "x"]).withColumnRenamed("n_chars", "keep")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = Q.with_quality(docs, none, F.lit(None).cast("string"), F.col("lang")).collect()
    assert len(out) == 4 and all(0 < r.quality < 1 for r in out)
    labels = spark.createDataFrame([(2, 1, 0), (2, None, 0), (None, 0, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    assert Q.keep_good(docs, labels, F.col("source"), F.col("lang")).count() == 4
    assert Q.with_quality(documents([]), labels, F.col("source"), F.col("lang")).count() == 0


def test_held_out_labels_of_the_given_tables(spark):
    """Half of the real labels is held out."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.filter(F.xxhash64("doc_id") % 2 == 0)
    got = Q.with_quality(docs, train, F.col("source"), F.col("lang"), keep_text=False).select("doc.doc_id", "keep").join(labels.join(train, "doc_id", "left_anti"), "doc_id").collect()
    assert len(got) > 100 and sum(r.keep == bool(r.quality) for r in got) >= 0.97 * len(got)
