"""Findings of round 3 on growth: arms, searches, k-mers and intervals."""
import random

import pytest
from pyspark.sql import functions as F

from omics_spark.functions.seq import kmers, revcomp
from omics_spark.operators import pairing as P
from omics_spark.operators.kmers import kmer_join, kmer_rows
from omics_spark.plans import homology as H


@pytest.mark.parametrize("pairs", [P.WATSON_CRICK, {**P.WATSON_CRICK, **P.WOBBLE}])
def test_few_runs_leave_a_square_for_the_rim(pairs):
    """What goes on in another square has a whole word in this one."""
    rng = random.Random(5)
    seq = "".join(rng.choice("ACGU") for _ in range(3 * 128)).encode()
    words = P.Words(pairs, 4)
    squares = [(seq[a:a + 131], seq[b:b + 131], a, b) for a in (0, 128, 256) for b in range(a, 384, 128)]
    runs = P.word_runs(squares, words, 128, 4, 3)
    on_rim = sum(int((P.square_runs(x[:128], y[:128], a, b, P._codes(pairs), 4, 3)[:, 4] != 0).sum()) for x, y, a, b in squares)
    assert 0 < (runs[:, 4] != 0).sum() < on_rim / 8
    whole = P.word_runs([(seq, seq, 0, 0)], words, 512, 4, 3)       # one square: nothing goes on
    assert len(whole) and not whole[:, 4].any()
    assert sorted(map(tuple, whole[:, :4].tolist())) == sorted(
        tuple(r[:4]) for r in P.square_runs(seq, seq, 0, 0, P._codes(pairs), 4, 3).tolist() if r[2] >= 4)


def test_windows_alone_are_scored(spark):
    """of a long subject only the letters under a query reach the scoring, and no pair holds all of its diagonals."""
    rng = random.Random(6)
    seq = "".join(rng.choice("ACGT") for _ in range(30_000))
    minus = seq[20_000:20_060].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    q = spark.createDataFrame([("a", seq[500:560]), ("b", minus), ("c", "GG" + seq[:40]), ("d", seq[-30:] + "TTTT")], "seq_id string, seq string")
    s = spark.createDataFrame([(1, seq), (2, seq[:700])], "seq_id long, seq string")
    seeds = kmer_join(q, s, 11)
    pairs = H.pair_segments(seeds, q.select(F.col("seq_id").alias("q_id"), F.col("seq").alias("q_plus"), revcomp(F.col("seq")).alias("q_minus")),
                            s.select(F.col("seq_id").alias("s_id"), F.col("seq").alias("s_s")))
    assert "collect_list" not in pairs._jdf.queryExecution().toString()
    got = {(r["q_id"], r["s_id"]): (r["strand"], r["raw_score"], r["q_start"], r["s_start"]) for r in pairs.collect() if r["raw_score"] > 20}
    assert got == {("a", 1): ("+", 60, 0, 500), ("a", 2): ("+", 60, 0, 500), ("b", 1): ("-", 60, 0, 20_000), ("c", 1): ("+", 40, 2, 0), ("c", 2): ("+", 40, 2, 0), ("d", 1): ("+", 30, 0, 29_970)}


@pytest.mark.parametrize("k", [1, 8, 63, 64, 65, 200])
def test_kmers_become_rows_without_an_array_of_them(spark, k):
    """the same k-mers as the column, from pieces."""
    rng = random.Random(k)
    seqs = [(n, "".join(rng.choice("ACGTé") for _ in range(n))) for n in (0, 1, 7, 8, 63, 64, 65, 71, 72, 128, 135, 700)]
    df = spark.createDataFrame([*seqs, (9999, None)], "id long, seq string")
    rows = kmer_rows(df, "seq", k)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten" not in plan and "struct" not in plan
    whole = df.select("id", F.explode(kmers(F.col("seq"), k)).alias("k")).select("id", "k.pos", "k.kmer")
    got = sorted(map(tuple, rows.collect()))
    assert got == sorted(map(tuple, whole.collect())) and rows.schema["pos"].dataType == whole.schema["pos"].dataType
    assert got == [(n, i, s[i:i + k]) for n, s in seqs for i in range(len(s) - k + 1)]
