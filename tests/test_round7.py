"""Findings of round 3 on growth, third session: reads against a genome of repeats."""
import random

import pytest
from pyspark.sql import functions as F

from omics_spark.functions.seq import revcomp
from omics_spark.operators import kmers as K
from omics_spark.operators.topk import top_k
from omics_spark.plans import homology as H


def best_two(df):
    return sorted(map(str, top_k(df, ["q_id"], [F.col("n_seeds").desc(), F.col("s_id"), F.col("strand"), F.col("diag")], 2).collect()))


@pytest.fixture(scope="module")
def repeats(spark):
    """Reads and a genome of repeats, with ids that are null or come twice, odd letters and empty texts."""
    rng = random.Random(3)

    def letters(n, of="ACGT"):
        return "".join(rng.choice(of) for _ in range(n))

    unit = letters(40)
    genome = [("c1", letters(300) + unit * 6 + "N" + letters(50)), ("c2", unit * 3 + letters(200)), ("c1", unit * 2 + letters(90)), (None, letters(80) + unit),
              ("é", letters(30) + "A" * 24 + unit), ("c3", None), ("c4", "ACG"), ("", letters(500, "AC"))]
    reads = [("a", "A" * 50), ("n", None), ("e", ""), ("u", unit * 2), ("x", "AC\0GT" + unit + "é" + unit)]
    for i in range(60):
        seq, at = rng.choice([s for _, s in genome if s]) * 2, rng.randrange(40)
        reads.append((f"r{i}", seq[at:at + rng.randrange(5, 70)]))
    r = spark.createDataFrame(reads, "q string, seq string").withColumn("seq", F.when(F.col("q") > "r5", revcomp("seq")).otherwise(F.col("seq")))
    return r.select(F.struct("q").alias("q"), "seq"), spark.createDataFrame(genome, "s string, seq string")


@pytest.mark.parametrize("k", [3, 11])
@pytest.mark.parametrize("bounds", [(1 << 24, 1 << 25, 1 << 16, 1 << 21), (200, 500, 7, 100), (1 << 24, 1 << 25, 1 << 16, 130)])
def test_diagonals_are_counted_where_seeds_are_found(repeats, monkeypatch, k, bounds):
    """the same best diagonals as counts of all seeds give, however sequences are cut and dealt out."""
    q, s = repeats
    for name, value in zip(("INDEXED", "ASKED", "SPAN", "SEEDS"), bounds, strict=True):
        monkeypatch.setattr(K, name, value)
    seeds = K.kmer_join(q, s, k, q_id="q", s_id="s")
    every = seeds.groupBy("q_id", "s_id", "strand", (F.col("s_pos") - F.col("q_pos")).alias("diag")).agg(F.count(F.lit(1)).alias("n_seeds"))
    want = best_two(every)
    found = K.best_diagonals(q, s, k, 2, "q", "s", tasks=3)
    assert [x.dataType for x in found.schema] == [x.dataType for x in every.select(*found.columns).schema]
    assert best_two(found) == want and len(want) > 60
    if bounds[0] > 200:     # one block: two rows a read, not one a seed
        assert found.count() == len(want) < seeds.count() / 10


def test_map_reads_moves_no_seeds(repeats, monkeypatch):
    """mapping joins no seeds, and finds reads as before."""
    q, s = repeats
    args = q.select(F.col("q.q").alias("read_id"), "seq"), s.where("s is not null").dropDuplicates(["s"]).withColumnRenamed("s", "contig")
    masked = sorted(map(str, H.map_reads(*args, k=11, max_freq=1 << 40).collect()))      # the way with all seeds
    monkeypatch.setattr(H, "kmer_join", None)
    assert sorted(map(str, H.map_reads(*args, k=11).collect())) == masked


def test_hits_of_orfs_carry_no_titles(spark, monkeypatch):
    """a hit's row holds one flag of its title; only the best hit of an ORF gets the text, cut as ever."""
    from omics_spark.plans.sequences import annotate_genome

    rng = random.Random(8)
    codons = [a + b + c for a in "ACG" for b in "ACG" for c in "ACG"]
    orf = "ATG" + "".join(rng.choice(codons) for _ in range(40)) + "TAA"
    contigs = spark.createDataFrame([("c", "TAA" + orf)], "contig string, seq string")
    protein = [r["protein"] for r in forward_orfs(contigs)]
    library = spark.createDataFrame([(1, protein[0], "another " + "x" * 500), (2, protein[0][:30], "of Rarus " + "y" * 500), (3, protein[0], None)],
                                    "seq_id long, seq string, title string")
    widths, search = [], H.similarity_search

    def watched(queries, subjects, *args, title, **named):
        hits = search(queries, subjects, *args, title=title, **named)
        widths.append(hits.agg(F.max(F.length("title"))).first()[0])
        return hits

    monkeypatch.setattr(H, "similarity_search", watched)
    for genus, product in (("rarus", None), ("", ("another " + "x" * 500)[:80]), ("nowhere", None)):
        rows = [r for r in annotate_genome(contigs, library, genus=genus, min_aa=30).collect() if r["strand"] == "+" and r["score"]]
        # a title that is null is told from none of the two, and comes first where a genus is sought
        assert [r["product"] for r in rows] == [product or "hypothetical protein"]
    assert max(widths) <= 5
    rows = annotate_genome(contigs, library.where("title is not null"), genus="rarus", min_aa=30).collect()
    assert ("of Rarus " + "y" * 500)[:80] in [r["product"] for r in rows]


def forward_orfs(contigs):
    from omics_spark.plans.sequences import find_orfs
    return find_orfs(contigs, 30).where("strand = '+'").collect()
