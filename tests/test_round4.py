"""Steps that grow with what they read: backgrounds, k-mer counts, searches."""

import random

from pyspark.sql import functions as F

from omics_spark.operators.windows import local_background


def test_background_means_over_block_edges(spark):
    rng = random.Random(5)
    bins = {c: {b: rng.randint(1, 9) for b in rng.sample(range(n), n // 4)} for c, n in (("a", 900), ("b", 40), ("c", 1))if n > 3} | {"c": {0: 7}}
    df = spark.createDataFrame([(c, b, v) for c, x in bins.items() for b, v in x.items()] + [(None, 3, 1), ("a", None, 5)], "contig string, bin long, count long")
    want = {}
    for c, x in bins.items():
        top = max(x)
        for b in range(top + 1):
            spans = [range(max(b - h, 0), min(b + h, top) + 1) for h in (3, 20)]
            want[c, b] = (x.get(b, 0), *[sum(x.get(i, 0) for i in s) / len(s) for s in spans])
    got = {(r["contig"], r["bin"]): (r["count"], r["bg_3"], r["bg_20"]) for r in local_background(df, [3, 20], width=64).collect()}
    assert got == want
    few = {(r["contig"], r["bin"]): (r["count"], r["bg_3"], r["bg_20"]) for r in local_background(df, [3, 20], dense=False, width=64).collect()}
    assert few == {k: v for k, v in want.items() if v[0]}


def test_background_shuffles_counts_not_the_grid(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 400_000, 2)], "contig string, bin long, count long")
    x = local_background(df, [10, 100])
    assert x.agg(F.count("*"), F.sum("count")).first()[:] == (400_001, 3)
    assert "Join" not in x._jdf.queryExecution().optimizedPlan().toString()


def test_kmers_are_counted_by_id(spark):
    from omics_spark.functions.seq import revcomp
    from omics_spark.operators import kmers as K

    rng = random.Random(6)
    rows = [(rng.choice([1, 2, 3, None]), "".join(rng.choice("ACGTNacgtu") for _ in range(rng.randint(0, 300)))) for _ in range(20)]
    rows += [(1, "ACGT-ACé TACG"), (2, "ACé TAA"), (4, None), (5, "A"), (6, "XYZXYZ")]
    df = spark.createDataFrame(rows, "seq_id int, seq string")
    for k in (1, 3, 8, 12):
        for canonical in (False, True):
            x = K.explode_kmers(df, k)
            x = x.withColumn("kmer", F.least("kmer", revcomp(F.col("kmer")))) if canonical else x
            want = x.groupBy("kmer", "id").count().groupBy("kmer").agg(F.sum("count").alias("a"), F.count("*").alias("b"))
            assert sorted(K.kmer_counts(df, k, canonical=canonical).collect()) == sorted(want.collect())
    plan = K.kmer_counts(df, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan      # no row a k-mer


def test_motif_tails_are_worked_out_once_a_pair_of_counts(spark):
    from math import comb

    from omics_spark.functions import stats as ST
    from omics_spark.plans import peaks as P

    rows = [(k, d, m, t) for t in (1, 7, 60, 900) for d in (0, t // 3, t) for m in (0, t // 2, t) for k in (0, 1, t // 6, t // 3, t)]
    df = spark.createDataFrame([*rows, (None, 1, 1, 1)], "k long, d long, m long, t long")
    for r in df.withColumn("p", ST.hypergeom_upper(*map(F.col, "kdmt"))).collect():
        if r["k"] is None:
            assert r["p"] is None
            continue
        k, d, m, t = r[:4]
        exact = sum(comb(m, j) * comb(t - m, d - j) for j in range(k, min(d, m) + 1) if d - j <= t - m) / comb(t, d)
        assert abs(r["p"] - exact) < 1e-9, r
    seen, whole = [], P.hypergeom_upper
    P.hypergeom_upper = lambda *a: seen.append(1) or whole(*a)
    try:
        seqs = spark.createDataFrame([(i, "ACGTTGCAAC" * 3) for i in range(30)], "seq_id int, seq string")
        got = P.motif_enrichment(seqs.where("seq_id < 10"), seqs.where("seq_id >= 10"))
    finally:
        P.hypergeom_upper = whole
    assert got.count() and {(r["t_hits"], r["b_hits"], round(r["p"], 9)) for r in got.collect()} == {(10, 20, 1.0)}
    assert "pandas" not in got._jdf.queryExecution().optimizedPlan().toString().lower() and len(seen) == 1


def test_effect_tables_come_from_one_scan(spark):
    from omics_spark.sources import fixtures as FX

    sf = "/root/testdata/sf0.001"
    for name in FX.ONE_SCAN:
        one = FX.view(spark, sf, name)
        args = {d: FX.view(spark, sf, d) for d in FX._deps(name)}
        union = spark.sql(FX.VIEWS[name][0].replace("{S}", "string"), **args)
        assert one.columns == union.columns and sorted(one.collect()) == sorted(union.collect())
        assert one._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_windows_are_scored_in_portions(monkeypatch):
    import pandas as pd

    from omics_spark.plans import homology as H

    rng = random.Random(7)
    seqs = [["".join(rng.choice("ACGT") for _ in range(n)) for _ in range(6)] for n in (60, 60, 400)]
    diags = [[{"strand": s, "diag": d, "n_seeds": 1} for s in "+-" for d in range(-50, 390, 7)] for _ in range(6)]
    sizes, whole = [], H.best_segments_batch
    monkeypatch.setattr(H, "best_segments_batch", lambda q, *a: sizes.append(sum(map(len, q))) or whole(q, *a))
    for share in (1.0, 0.8):
        got = []
        for letters in (1 << 20, 500):
            monkeypatch.setattr(H, "WINDOW_LETTERS", letters)
            sizes.clear()
            got.append(list(H.pair_udf(1, -1, share).func(pd.Series(diags), *map(pd.Series, seqs))))
            assert max(sizes) <= letters + 60
        assert got[0] == got[1] and all(got[0])
