import math

import numpy as np
from pyspark.sql import functions as F

from conftest import SF001
from omics_spark.llm import pivot_topk as P
from omics_spark.llm.common import table


def brute(rows, k):
    good = {}
    for i, v in sorted((i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)):
        good.setdefault(i, [math.floor(1024 * float(x)) for x in v])
    out = []
    for q in good:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out += [(q, n + 1, i, max(-1 << 63, min((1 << 63) - 1, -s))) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def got(df, k=10, **kw):
    return sorted(tuple(r) for r in P.topk(P.scaled(df), F.col("vec_id") % 100 == 0, k=k, **kw).collect())


def test_against_brute_force(spark):
    df = table(spark, SF001, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert got(df) == brute(rows, 10)
    assert got(df, k=3, block_values=64 * 7, query_values=64) == brute(rows, 3)


def test_ties_nulls_repeats_lengths_and_large_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (200, None), (300, [nan, 1.0]), (400, [1.0, inf]), (500, [1.0, None]), (None, [1.0, 1.0]),
            (600, [1.0]), (7, [2.0, 2.0]), (8, [2.0, 2.0]), (8, [2.0, 2.0]), (9, [2.0, 2.0]), (10, [-1.0, -0.0001]), (11, [5.0]),
            (700, []), (12, []), (13, [1e30, -1e30]), (14, [3e12, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, v string, block int")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got(df, k=4) == brute(exact, 4)
    assert got(df.limit(0)) == []


def test_one_common_vector(spark):
    df = spark.range(2000).select(F.col("id").alias("vec_id"), F.array(F.lit(0.5), F.lit(-0.25)).cast("array<float>").alias("embedding"))
    rows = got(df, k=2, block_values=500)
    assert rows[:2] == [(0, 1, 1, 512 * 512 + 256 * 256), (0, 2, 2, 512 * 512 + 256 * 256)]


def test_bounds_skip_candidates():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 400, (20, 8))
    x = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 5, (4000, 8)))
    ids = np.arange(4000)
    rows, scored = P.block_topk(ids, x, ids[:20], x[:20], P.choose_pivots(x[:500]), 5)
    want = [sorted((-int(s), int(i)) for i, s in enumerate(x @ q) if i != n)[:5] for n, q in enumerate(x[:20])]
    assert [(-s, i) for _, i, s in rows] == [p for w in want for p in w]
    assert scored < 0.5 * 20 * 4000
