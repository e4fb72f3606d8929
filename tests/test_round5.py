"""Layouts and shuffles that grow with the input only."""

import glob
import statistics

from pyspark.sql import functions as F

from omics_spark.operators import alignments as AL
from omics_spark.operators.windows import median_center


def test_reads_over_one_place_are_counted_together(spark):
    """Letters of a locus meet in one task before they are shuffled."""
    reads = spark.range(4000, numPartitions=8).selectExpr(
        "if(id % 2 = 0, 'tumor', 'normal') sample", "concat('c', id % 3) contig", "id % 7 + 1 pos", "0 flag", "'4M' cigar",
        "'ACGT' seq", "'IIII' qual")
    p = AL.pileup(reads).withColumn("part", F.spark_partition_id())
    assert p.count() == 16_000
    spread = p.groupBy("contig").agg(F.countDistinct("part").alias("n")).collect()
    assert [r["n"] for r in spread] == [1, 1, 1]
    counts = AL.pileup_counts(reads)
    assert counts.agg(F.sum("depth")).first()[0] == 16_000 and counts.where("mean_bq != 40").count() == 0


def test_small_contigs_have_one_folder(spark, tmp_path):
    """folders grow with contigs, not with the bins of contigs of few reads."""
    reads = spark.range(600).selectExpr("id", "concat('chr', id % 20) contig", "id * 7000 + 1 pos", "'50M' cigar")
    path = AL.write_indexed(reads, str(tmp_path / "x"), bin_size=100_000)
    assert len(glob.glob(f"{path}/contig=*/level=*/bin=*")) == 20
    got = AL.read_region(spark, path, "chr3:700,001-2,000,000", bin_size=100_000)
    assert {r["id"] for r in got.collect()} == {i for i in range(600) if i % 20 == 3 and i * 7000 + 50 > 700_000 and i * 7000 < 2_000_000}
    assert got.inputFiles() and all("contig=chr3/" in f for f in got.inputFiles())
    assert AL.read_region(spark, path, "chr77:1-50", bin_size=100_000).count() == 0


def test_crowded_contigs_keep_their_bins(spark, tmp_path):
    reads = spark.range(40_000).selectExpr("id", "'c' contig", "id * 100 + 1 pos", "'50M' cigar")
    path = AL.write_indexed(reads, str(tmp_path / "x"), bin_size=1_000_000)
    assert len(glob.glob(f"{path}/contig=c/level=0/bin=*")) == 4


def test_rows_to_centre_are_worked_out_once(spark):
    """the passes for the medians do not go back to the reads."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(1000).selectExpr("id % 2 g", "cast(id * id as double) v").mapInArrow(look, "g long, v double")
    got = median_center(df, "v", ["g"], "c").collect()
    assert seen.value == 1000 and len(got) == 1000
    for g in (0, 1):
        mid = statistics.median(r["v"] for r in got if r["g"] == g)
        assert all(r["c"] == r["v"] - mid for r in got if r["g"] == g)
