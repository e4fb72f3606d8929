"""A third of all rows on one key: results stay exact (brute force)."""

import random

from pyspark.sql import functions as F

from omics_spark.operators import intervals as IV
from omics_spark.operators.alignments import sort_alignments
from omics_spark.operators.topk import top_k
from omics_spark.operators.windows import bh_qvalues


def _rows():
    rnd = random.Random(13)
    rows = [("c1", 1000, 1000 + rnd.randrange(1, 40)) for _ in range(600)]          # hot locus
    rows += [("c1", s, s + rnd.randrange(1, 40)) for s in (rnd.randrange(0, 20000) for _ in range(1200))]
    return rows


def test_merge_and_depth_with_hot_locus(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "contig string, start_pos bigint, end_pos bigint")
    merged = sorted((r.start_pos, r.end_pos, r.n_members) for r in IV.merge_intervals(df, width=512).collect())
    ivs = sorted((s, e) for _, s, e in rows)
    out, cur = [], None
    for s, e in ivs:
        if cur and s <= cur[1]:
            cur[1], cur[2] = max(cur[1], e), cur[2] + 1
        else:
            if cur:
                out.append(tuple(cur))
            cur = [s, e, 1]
    out.append(tuple(cur))
    assert merged == out
    depth = {(r.start_pos, r.end_pos): r.depth for r in IV.depth_segments(df, width=512).collect()}
    cov = [0] * 20100
    for _, s, e in rows:
        for p in range(s, e):
            cov[p] += 1
    for (s, e), d in depth.items():
        assert all(cov[p] == d for p in range(s, e))
    assert sum(e - s for s, e in depth) == sum(1 for c in cov if c > 0)


def test_sort_ordinals_with_hot_position(spark):
    rows = [(r[0], r[1] + 1, i) for i, r in enumerate(_rows())]
    df = spark.createDataFrame(rows, "contig string, pos bigint, rid int")
    got = [(r.pos, r.rid, r.ordinal) for r in sort_alignments(df).collect()]
    want = [(p, rid, i + 1) for i, (_, p, rid) in enumerate(sorted(rows, key=lambda t: (t[1], t[2])))]
    assert got == want


def test_top_k_and_bh_on_hot_group(spark):
    rnd = random.Random(4)
    rows = [("hot", i, rnd.random()) for i in range(900)] + [(f"g{i % 30}", i, rnd.random()) for i in range(900, 1800)]
    df = spark.createDataFrame(rows, "g string, id int, s double")
    top = {(r.g, r.id) for r in top_k(df, ["g"], [F.col("s"), F.col("id")], 3).collect()}
    want = set()
    for g in {r[0] for r in rows}:
        want |= {(g, i) for g2, i, _ in sorted((r for r in rows if r[0] == g), key=lambda t: (t[2], t[1]))[:3]
                 for g2 in [g]}
    assert top == want
    q = bh_qvalues(df.withColumnRenamed("s", "p"), "p", ["g"])
    # q >= p up to rounding (p * m / m need not give back p exactly)
    assert q.count() == len(rows) and q.where("q > 1 or q < p - 1e-12").count() == 0
