from __future__ import annotations

import math

import duckdb
import numpy as np

from wayfare.llm import topk


def brute(rows, k, every):
    good = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in (i for i in good if i % every == 0):
        scored = sorted((-sum(a * b for a, b in zip(good[q], good[c], strict=False)), c) for c in good if c != q)
        out |= {(q, r, c, -s) for r, (s, c) in enumerate(scored[:k], 1)}
    return out


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SEED", 32)
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(0, 0.3, 40).tolist()) for k in range(400)]
    rows += [(1000, [1.0] * 40), (1020, [1.0] * 40), (1001, None), (1040, [float("nan")] * 40), (1060, [None] + [1.0] * 39), (None, [9.0] * 40), (1080, []), (1002, [0.5] * 7), (-20, [0.1] * 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnRenamed("x", "y").selectExpr("*", "1 as score", "2 as rank").repartition(3)
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute(as_float, 20, 20)
    assert set(map(tuple, topk.top_k(df).collect())) == want
    # many blocks of queries and candidates, of which a task keeps two
    monkeypatch.setattr(topk, "HELD", 2)
    assert set(map(tuple, topk.top_k(df, block_bytes=500).collect())) == want
    few = df.where("vec_id < 5")
    assert set(map(tuple, topk.top_k(few).collect())) == brute(as_float[:5] + [as_float[-1]], 20, 20)
    assert topk.top_k(df.limit(0)).count() == 0


def test_large_values(spark):
    rows = [(0, [1e6, -2e6]), (1, [3e6, 1e6]), (2, [1e7, 1e7]), (3, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert set(map(tuple, topk.top_k(df).collect())) == brute(rows, 20, 20)


def test_against_sql(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(k, rng.normal(0, 0.3, 12).tolist()) for k in range(150)] + [(200, [float("inf")] * 12), (220, None)], "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(con.sql(topk.SQL).fetchall())


def test_repeated_queries(spark):
    """Rows that repeat a query's id are one query, the largest; as candidates each counts."""
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, got.collect())) == [(0, 1, 3, 2 * 64 * 64), (0, 2, 3, 2 * 64 * 64)]


def test_bounds_prune():
    """Of 2,000 clustered vectors fewer than half of the dimension blocks are evaluated, and the result is exact."""
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (20, 64))
    x = np.floor(64 * (centres[rng.integers(0, 20, 2000)] + rng.normal(0, 0.15, (2000, 64)))).astype(np.int64)
    ids = np.arange(2000)
    best = topk.Best(ids[::20], x[::20], 20)
    for lo in range(0, 2000, 500):
        best.add(ids[lo : lo + 500], x[lo : lo + 500])
    assert best.evaluated < 0.5 * best.possible
    for at, i in enumerate(best.ids):
        s = x @ x[i]
        want = sorted((-int(s[c]), c) for c in range(2000) if c != i)[:20]
        assert [(-int(a), int(b)) for a, b in zip(best.score[at], best.vec[at], strict=True)] == want
