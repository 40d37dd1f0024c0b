import math
import random

import numpy as np
import pytest

from websource_audit.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100):
    own = {}
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * c) for c in x])
        own[i] = min(own.get(i, row), row)
    score = lambda a, b: sum(x * y for x, y in zip(own[a][1], own[b][1], strict=False))
    out = []
    for a in own:
        if a % every:
            continue
        by = sorted(((-score(a, b), b) for b in own if b != a))
        for ps, p in [x for x in by if own[x[1]][0] == own[a][0]][:5]:
            ok = [(s, n) for s, n in by if own[n][0] != own[a][0] and 30 * -ps <= 100 * -s <= 90 * -ps][:10]
            out += [(a, p, k + 1, n, -ps, -s) for k, (s, n) in enumerate(ok)]
    return sorted(out)


def got(frame):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in H.hard_negatives(frame).collect())


def near(rnd, centre, by):
    return [float(np.float32(c + rnd.gauss(0, by))) for c in centre]


@pytest.mark.parametrize("d, bits", [(2, 4), (3, 2), (4, 1), (5, 2)])
def test_curve_visits_each_cell_once_by_single_steps(d, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d), axis=-1).reshape(-1, d)
    keys = H.curve_keys(cells, bits)
    assert len(set(keys)) == len(cells)
    walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_equals_brute_force(spark):
    rnd = random.Random(4)
    centres = [[rnd.gauss(0, 0.3) for _ in range(8)] for _ in range(6)]
    rows = [(k, near(rnd, centres[k % 6], 0.15), (k * 7) % 5) for k in range(1500)]
    rows += [(2000 + k, rows[100][1], k % 3) for k in range(60)]  # a vector that many rows share
    rows += [(3000, [0.0] * 8, 1), (3100, [-1.0] * 8, 99), (3001, None, 1), (3200, [float("nan")] * 8, 1), (3201, [None] * 8, 1), (3202, [float("inf")] * 8, 1), (3203, [0.5] * 8, None), (None, [0.5] * 8, 1)]
    rows += [rows[7], (8, near(rnd, centres[0], 0.2), 2), (3300, [0.5, 0.25], 2), (3301, [], 2)]
    rnd.shuffle(rows)
    want = brute(rows)
    assert want and got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == want
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as v", "3 as x", "4 as block", "5 as score")
    assert got(clash) == want


def test_blocks_that_no_window_needs_are_not_read(spark):
    """Tight groups far apart: of the blocks of one label few can hold an anchor's positives."""
    rnd = random.Random(6)
    centres = [[rnd.choice([-1, 1]) * rnd.random() for _ in range(16)] for _ in range(20)]
    rows = [(k, near(rnd, centres[k % 20], 0.01), 1 if k % 7 else 0) for k in range(12000)]
    table = spark.createDataFrame(rows, SCHEMA)
    q = H.quantized(table)
    placed = H.on_curve(q, 16, -300, 300)
    blocks = H.stash(H.packed(placed, 16, 64), "blocks")
    batches = H.stash(H.packed(placed.filter("id = 100"), 16, 8).selectExpr("block as batch", "ids", "labels", "vectors"), "batches")
    wanted = H.stash(H.chosen(batches, blocks, 16, True), "chosen")
    assert 0 < wanted.count() < blocks.count() / 4
    found = [(r.score, r.id) for r in H._first(H.read(batches, blocks, wanted, 16, True), ["anchor_id"], 5).collect()]
    own = {r.id: (r.label, r.v) for r in q.collect()}
    by = sorted((-sum(x * y for x, y in zip(own[100][1], v, strict=True)), i) for i, (label, v) in own.items() if label == own[100][0] and i != 100)
    assert sorted(found, key=lambda x: (-x[0], x[1])) == [(-s, i) for s, i in by[:5]]


def test_zone_bounds_hold(spark):
    rnd = np.random.default_rng(2)
    v = rnd.integers(-99, 99, (40, 7))
    a = H.Anchors({"batch": 0, "ids": np.arange(5).tobytes(), "labels": np.zeros(5, np.int32).tobytes(), "vectors": rnd.integers(-99, 99, (5, 7)).astype(np.int64).tobytes()}, 7, True)
    least, most = a.bounds(v.min(axis=0)[None], v.max(axis=0)[None])
    s = H.products(a.v, v)
    assert (s.min(axis=1) >= least[:, 0]).all() and (s.max(axis=1) <= most[:, 0]).all()


def test_huge_components_are_exact(spark):
    big = float(2**20)
    rows = [(k, [big * (k % 5 - 2), 1.0 + k], k % 2) for k in range(0, 60)] + [(100, [big, 3.0], 0), (200, [1e30, 1.0], 1), (201, [1e30, 1.0], 1)]
    want = [r for r in brute(rows) if r[0] != 200 and r[1] not in (200, 201) and r[3] not in (200, 201)]
    out = [r for r in got(spark.createDataFrame(rows, SCHEMA)) if r[0] != 200 and r[1] not in (200, 201) and r[3] not in (200, 201)]
    fits = lambda r: abs(r[4]) < 2**62
    assert list(filter(fits, out)) == list(filter(fits, want)) and any(map(fits, want))


def test_empty_table(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(100, [1.0], 1)], SCHEMA)) == []
