"""Statistics functions against exact values, search and mapping checks."""

import math
import random

from pyspark.sql import functions as F

from omics_spark.functions import stats as ST
from omics_spark.operators.spatial import connected_components, grid_edges, grid_id
from omics_spark.operators.windows import bh_qvalues
from omics_spark.plans.homology import best_segment_np, kadane, map_reads
from omics_spark.functions.seq import chars, revcomp


def _one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_poisson_upper_known_value(spark):
    assert abs(_one(spark, ST.poisson_upper(F.lit(12), F.lit(4.0))) - 0.0009152291) < 1e-9
    assert _one(spark, ST.poisson_upper(F.lit(0), F.lit(4.0))) == 1.0


def test_binom_and_hypergeom_exact(spark):
    k, n, p = 7, 20, 0.2
    exact = sum(math.comb(n, j) * p ** j * (1 - p) ** (n - j) for j in range(k, n + 1))
    assert abs(_one(spark, ST.binom_upper(F.lit(k), F.lit(n), F.lit(p))) - exact) < 1e-9
    K, N, d, kk = 30, 200, 40, 12
    exact = sum(math.comb(K, j) * math.comb(N - K, d - j) for j in range(kk, min(d, K) + 1)) / math.comb(N, d)
    assert abs(_one(spark, ST.hypergeom_upper(F.lit(kk), F.lit(d), F.lit(K), F.lit(N))) - exact) < 1e-9


def test_bh_matches_naive(spark):
    rnd = random.Random(3)
    ps = [round(rnd.random(), 3) for _ in range(300)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "id int, p double")
    got = {r.id: r.q for r in bh_qvalues(df, "p").collect()}
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    m = len(ps)
    q = [0.0] * m
    run = 1.0
    for rank in range(m, 0, -1):
        i = order[rank - 1]
        run = min(run, ps[i] * m / rank)
        q[i] = run
    # ties share the value of their last rank
    by_p = {}
    for i in range(m):
        by_p[ps[i]] = min(by_p.get(ps[i], 1.0), q[i])
    for i in range(m):
        assert abs(got[i] - by_p[ps[i]]) < 1e-12


def test_kadane_numpy_matches_column_version(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(200):
        n = rnd.randint(0, 25)
        rows.append(("".join(rnd.choice("AC") for _ in range(n)), "".join(rnd.choice("AC") for _ in range(n))))
    df = spark.createDataFrame(rows, "a string, b string")
    sc = F.zip_with(chars(F.col("a")), chars(F.col("b")), lambda x, y: F.when(x == y, 1).otherwise(-1))
    for r in df.select("a", "b", kadane(sc).alias("k")).collect():
        hof = (r.k.score, r.k.start, r.k.end, r.k.ident) if r.k.score > 0 and r.a else (0, -1, -1, 0)
        assert hof == best_segment_np(r.a, r.b, 1, -1)


def test_planted_reads_map_home(spark):
    rnd = random.Random(11)
    genome = {f"g{i}": "".join(rnd.choice("ACGT") for _ in range(600)) for i in range(3)}
    reads = []
    for i in range(40):
        g = rnd.choice(list(genome))
        off = rnd.randrange(0, 550)
        s = genome[g][off: off + 50]
        if i % 2:
            s = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        reads.append((f"r{i}", s, g, off, i % 2))
    rd = spark.createDataFrame([(r[0], r[1]) for r in reads], "read_id string, seq string")
    gd = spark.createDataFrame(list(genome.items()), "contig string, seq string")
    got = {r.read_id: r for r in map_reads(rd, gd, k=15).collect()}
    for rid, _, g, off, rev in reads:
        r = got[rid]
        assert (r.contig, r.pos, r.flag) == (g, off + 1, 16 if rev else 0)
        assert r.nm == 0 and r.cigar == "50M"


def test_connected_components_brute_force(spark):
    rnd = random.Random(2)
    on = {(y, x) for y in range(12) for x in range(12) if rnd.random() < 0.45}
    df = spark.createDataFrame([(0, 0, y, x) for y, x in on], "image_id int, z int, y int, x int")
    df = df.withColumn("id", grid_id(df))
    comps = connected_components(df.select("id"), grid_edges(df))
    ncomp = comps.select("label").distinct().count()
    # flood fill
    seen, count = set(), 0
    for c in on:
        if c in seen:
            continue
        count += 1
        stack = [c]
        while stack:
            y, x = stack.pop()
            if (y, x) in seen or (y, x) not in on:
                continue
            seen.add((y, x))
            stack += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    assert ncomp == count


def test_batched_segments_match_per_row():
    from omics_spark.plans.homology import best_segments_batch
    rnd = random.Random(21)
    for _ in range(100):
        qs, ss = [], []
        for _ in range(rnd.randint(1, 15)):
            n = rnd.randint(0, 30)
            qs.append("".join(rnd.choice("ACG") for _ in range(n)))
            ss.append("".join(rnd.choice("ACG") for _ in range(n + rnd.randint(0, 2))))
        got = [tuple(int(v) for v in r) for r in best_segments_batch(qs, ss, 2, -3)]
        assert got == [best_segment_np(a, b, 2, -3) for a, b in zip(qs, ss)]
