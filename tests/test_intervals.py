"""Hand-worked interval cases and invariants (brute force on small data)."""

import random

from pyspark.sql import functions as F

from omics_spark.operators import intervals as IV

SCHEMA = "contig string, start_pos bigint, end_pos bigint"


def _df(spark, rows, extra=""):
    return spark.createDataFrame(rows, SCHEMA + extra)


def test_merge_book_ended_and_gap(spark):
    df = _df(spark, [("c", 0, 10), ("c", 10, 20), ("c", 25, 30), ("d", 5, 6)])
    got = sorted(tuple(r) for r in IV.merge_intervals(df).collect())
    assert got == [("c", 0, 20, 2), ("c", 25, 30, 1), ("d", 5, 6, 1)]
    got = sorted(tuple(r) for r in IV.merge_intervals(df, gap=5).collect())
    assert got == [("c", 0, 30, 3), ("d", 5, 6, 1)]


def test_merge_across_blocks_matches_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for _ in range(400):
        s = rnd.randrange(0, 5000)
        rows.append(("c", s, s + rnd.randrange(1, 60)))
    df = _df(spark, rows)
    # tiny blocks force carries across many blocks
    got = sorted((r.start_pos, r.end_pos) for r in IV.merge_intervals(df, width=64).collect())
    cur, out = None, []
    for s, e in sorted((s, e) for _, s, e in rows):
        if cur and s <= cur[1]:
            cur[1] = max(cur[1], e)
        else:
            if cur:
                out.append(tuple(cur))
            cur = [s, e]
    out.append(tuple(cur))
    assert got == out


def test_intersect_once_per_pair_and_bookends(spark):
    a = spark.createDataFrame([("c", 0, 100, 1), ("c", 100, 200, 2)], SCHEMA + ", a_id int")
    b = spark.createDataFrame([("c", 50, 150, 9), ("c", 200, 300, 8)], SCHEMA + ", b_id int")
    got = sorted((r.a_id, r.b_id, r.start_pos, r.end_pos) for r in IV.intersect_intervals(a, b, bin_size=16).collect())
    assert got == [(1, 9, 50, 100), (2, 9, 100, 150)]


def test_subtract_plus_intersect_covers_a(spark):
    a = spark.createDataFrame([("c", 0, 100, 1), ("x", 5, 9, 2)], SCHEMA + ", a_id int")
    b = _df(spark, [("c", 10, 20), ("c", 15, 30), ("c", 90, 120)])
    pieces = sorted((r.a_id, r.start_pos, r.end_pos) for r in IV.subtract_intervals(a, b).collect())
    assert pieces == [(1, 0, 10), (1, 30, 90), (2, 5, 9)]


def test_restrict_semi_and_anti_partition_rows(spark):
    df = spark.createDataFrame([("c", 0, 5, 1), ("c", 5, 300, 2), ("c", 400, 401, 3)], SCHEMA + ", rid int")
    regions = _df(spark, [("c", 4, 6), ("c", 250, 260)])
    semi = sorted(r.rid for r in IV.restrict_to_intervals(df, regions, "semi", bin_size=32).collect())
    anti = sorted(r.rid for r in IV.restrict_to_intervals(df, regions, "anti", bin_size=32).collect())
    assert semi == [1, 2] and anti == [3]


def test_depth_segments(spark):
    df = _df(spark, [("c", 0, 10), ("c", 5, 15), ("c", 5, 15)])
    got = sorted(tuple(r) for r in IV.depth_segments(df, width=4).collect())
    assert got == [("c", 0, 5, 1), ("c", 5, 10, 3), ("c", 10, 15, 2)]


def test_complement_with_lengths(spark):
    df = _df(spark, [("c", 10, 20), ("c", 30, 40)])
    lens = spark.createDataFrame([("c", 50), ("e", 7)], "contig string, length bigint")
    got = sorted(tuple(r) for r in IV.complement_intervals(df, lens).collect())
    assert got == [("c", 0, 10), ("c", 20, 30), ("c", 40, 50), ("e", 0, 7)]


def test_restrict_keeps_identical_rows_spanning_bins(spark):
    # two identical rows crossing several bins: both come out once each
    df = spark.createDataFrame([("c", 10, 200, 1), ("c", 10, 200, 1), ("c", 500, 700, 2)], SCHEMA + ", rid int")
    regions = _df(spark, [("c", 150, 160), ("c", 40, 60)])
    semi = sorted(r.rid for r in IV.restrict_to_intervals(df, regions, "semi", bin_size=32).collect())
    anti = sorted(r.rid for r in IV.restrict_to_intervals(df, regions, "anti", bin_size=32).collect())
    assert semi == [1, 1] and anti == [2]
