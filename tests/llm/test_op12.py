"""Hard negatives against brute force; pruning, odd rows and hot vectors."""

import math
import random
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from relevo.llm import op12_hard_negatives as op12

SCHEMA = "vec_id long, embedding array<double>, label int, bucket string, score string, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", "y", "z") for i, v, y in rows], SCHEMA)


def brute(rows, step, n_pos=5, n_neg=5, ratio=80):
    ok = []
    for i, v, y in rows:
        if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, tuple(math.floor(256 * x) for x in v), y))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    key = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for a in sorted({(i, y, v) for i, v, y in ok if i is not None and i % step == 0}):
        i, y, v = a
        pos = sorted(((dot(v, w), j) for j, w, z in ok if z == y and j != i), key=key)[:n_pos]
        neg = sorted(((dot(v, w), j) for j, w, z in ok if z != y), key=key)
        for p, j in pos:
            near = [(s, k) for s, k in neg if ratio * p <= 100 * s <= 100 * p][:n_neg]
            out += [(i, j, r + 1, k, p, s) for r, (s, k) in enumerate(near)]
    return sorted(out, key=str)


def random_rows(seed, n=300, d=12):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(d)] for _ in range(6)]
    rows = [(i, [c + r.gauss(0, .6) for c in r.choice(centres)], r.randrange(4)) for i in range(n)]
    rows += [(n + i, [x * 40 for x in rows[i][1]], rows[i][2]) for i in range(20)]           # long vectors
    rows += [(n + 50 + i, rows[7][1], 1) for i in range(60)]                                  # one hot vector
    rows += [(n + 200, None, 1), (n + 201, [1.0] * d, None), (n + 202, [None] + [1.0] * (d - 1), 1), (n + 203, [math.nan] * d, 2), (n + 204, [math.inf] * d, 2),
             (None, rows[3][1], 1), (n + 205, [], 1), (n + 210, [0.0] * d, 1), (n + 206, rows[0][1][:5], 2), (10, rows[10][1], rows[10][2]), (20, rows[21][1], rows[20][2])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(op12, "GROUP_BLOCKS", 2)
    monkeypatch.setattr(op12, "FIRST_ROWS", 6)
    rows = random_rows(seed)
    got = op12.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, block_rows=16, anchor_rows=7).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 10)


def test_large_components_are_scored_in_integers(spark):
    r = random.Random(5)
    rows = [(i, [float(r.randrange(-2 ** 20, 2 ** 20)) for _ in range(3)], i % 2) for i in range(40)]
    got = op12.hard_negatives(table(spark, rows), F.col("vec_id") % 5 == 0).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 5)


def test_no_rows_and_no_anchors(spark):
    assert op12.hard_negatives(table(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    rows = [(i, [1.0, 2.0], i % 2) for i in range(1, 9)]
    assert op12.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0).collect() == []
    assert op12.hard_negatives(table(spark, [(0, [1.0], 1)]), F.col("vec_id") % 10 == 0).collect() == []


def test_ranges_lose_nothing_and_prune():
    r = np.random.default_rng(3)
    data = r.normal(size=(400, 8))  # one bucket: equal lengths
    data = np.floor(4096 * data / np.linalg.norm(data, axis=1, keepdims=True))
    order = np.argsort(op12._units(data)[0], axis=0).T.astype(np.uint16)
    block = op12._Block({"n": 400, "dim": 8, "ids": np.arange(400).tobytes(), "labels": np.zeros(400, dtype=np.int64).tobytes(), "data": data.tobytes(), "orders": order.tobytes()})
    kept, asked = 0, 0
    for q in data[:50]:
        unit, length = q / np.linalg.norm(q), float(np.linalg.norm(q))
        score = data @ q
        for wanted in np.quantile(score, [.5, .9, 1.]):
            rows = block.candidates(unit, length, float(wanted), np.argsort(-np.abs(unit))[:4])
            if rows is not None:
                assert set(np.flatnonzero(score >= wanted)) <= set(rows)
                kept += len(rows)
    assert kept < 50 * 2 * 400 * .8


def test_packs_are_of_one_bucket_and_bounded(spark):
    v = op12.prepare(table(spark, random_rows(4)))
    got = op12.blocks(v, 9).collect()
    assert sum(b.n for b in got) == v.count() and max(b.n for b in got) <= 9
    for b in got:
        lengths = np.sqrt((np.frombuffer(b.data).reshape(b.n, b.dim) ** 2).sum(axis=1))
        assert lengths.max() <= lengths.min() * op12.BUCKET_RATIO * 1.0001 or b.bucket == -1
        assert [k for k, _ in groupby(np.frombuffer(b.labels, dtype=np.int64))] == sorted(set(np.frombuffer(b.labels, dtype=np.int64)))
