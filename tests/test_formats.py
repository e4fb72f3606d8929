"""Readers and writers on tiny hand-made files, and the pipe operators."""

import os
import tempfile

from pyspark.sql import functions as F

from omics_spark.operators.pipe import pipe_groups, pipe_lines
from omics_spark.sources import formats as FM

D = os.path.join(os.path.dirname(__file__), "data")


def test_read_fasta(spark):
    rows = {r.seq_id: r for r in FM.read_fasta(spark, f"{D}/tiny.fa").collect()}
    assert rows["s1"].seq == "ACGTAC" and rows["s1"].description == "s1 first record"
    assert rows["s2"].seq == "GGGG"
    assert rows["s3"].seq == ""


def test_read_fastq_quality_starting_with_at(spark):
    rows = {r.read_id: r for r in FM.read_fastq(spark, f"{D}/tiny.fq").collect()}
    assert rows["r1"].seq == "ACGT" and rows["r1"].qual == "@III"
    assert rows["r2"].qual == "II"


def test_read_sam(spark):
    rows = {r.qname: r for r in FM.read_sam(spark, f"{D}/tiny.sam", sample="t").collect()}
    assert len(rows) == 2
    q1 = rows["q1"]
    assert (q1.flag, q1.contig, q1.pos, q1.mapq, q1.cigar, q1.pnext, q1.tlen) == (99, "chr1", 10, 60, "20M5D30M", 200, 240)
    assert q1.tags["NM"] == "1" and q1.tags["SA"].startswith("chr2,5")
    assert rows["q2"].tags == {} and rows["q2"].sample == "t"


def test_read_vcf(spark):
    rows = FM.read_vcf(spark, f"{D}/tiny.vcf").orderBy("pos").collect()
    a, b = rows
    assert a.qual is None and a.alts == ["G", "T"] and a.id == "rs1"
    assert a.info["DP"] == "10" and "SOMATIC" in a.info and a.info["SOMATIC"] is None
    assert a.genotypes[1].sample == "S2" and a.genotypes[0].fields["AD"] == "5,5"
    assert b.qual == 50.0 and b.id is None


def test_read_bed(spark):
    rows = FM.read_bed(spark, f"{D}/tiny.bed").orderBy("contig", "start_pos").collect()
    assert len(rows) == 3
    assert rows[0].name is None and rows[1].strand == "-" and rows[1].score == 7.0
    assert rows[2].extra == ["3.2", "-1", "2", "5"]


def test_read_gff(spark):
    rows = FM.read_gff(spark, f"{D}/tiny.gff3").orderBy("start_pos").collect()
    assert rows[0].start_pos == 10 and rows[0].end_pos == 200 and rows[0].attributes["Name"] == "abc"
    assert rows[1].phase == 0 and rows[1].attributes["Parent"] == "g1"


def test_read_atoms_models(spark):
    rows = FM.read_atoms(spark, f"{D}/lig.pdb").orderBy("pose_id", "atom_id").collect()
    assert [r.pose_id for r in rows] == [1, 1, 2, 2]
    assert rows[0].mol_id == "lig" and rows[1].element == "O" and rows[2].x == 4.0


def test_vcf_write_read_roundtrip(spark):
    out = tempfile.mkdtemp(prefix="vcfw-")
    v = spark.createDataFrame([("chr2", 5, "A", "G", None, "PASS", 3), ("chr1", 9, "C", "T", 30.0, "PASS", 7)],
                              "contig string, pos bigint, ref string, alt string, qual double, filter string, dp int")
    FM.write_vcf(v, out + "/v", info_cols=["dp"])
    lines = [r.value for r in spark.read.text(out + "/v").collect()]
    assert lines[0] == "##fileformat=VCFv4.2" and lines[-3].startswith("#CHROM")
    assert lines[-2].startswith("chr1\t9") and lines[-1].split("\t")[5] == "."
    back = FM.read_vcf(spark, out + "/v").orderBy("contig").collect()
    assert back[0].info["DP"] == "7" and back[1].qual is None


def test_list_and_preview(spark):
    d = tempfile.mkdtemp(prefix="lst-")
    open(f"{d}/a.txt", "w").write("\n".join(f"line {i}" for i in range(100)) + "\n")
    os.mkdir(f"{d}/subdir")
    files = FM.list_files(spark, d).collect()
    assert [(f.name, f.is_dir) for f in files] == [("a.txt", False), ("subdir", True)] and files[0].size > 0
    assert FM.list_files(spark, d + "/missing").count() == 0
    prev = FM.preview_lines(FM.read_lines(spark, f"{d}/a.txt"), 5).orderBy("line_no").collect()
    assert [p.value for p in prev] == [f"line {i}" for i in range(5)] and prev[0].truncated


def test_pipe_lines_header_every_partition(spark):
    df = spark.createDataFrame([(f"x{i}",) for i in range(8)], "value string").repartition(2)
    out = pipe_lines(df, ["grep", "-c", ""], header=["#h"]).collect()
    counts = [int(r.value) for r in out]
    assert len(counts) == 2 and sum(counts) == 8 + 2   # the header reached both partitions


def test_pipe_groups_whole_groups(spark):
    df = spark.createDataFrame([("a", i, f"{i}") for i in range(5)] + [("b", 1, "9")],
                               "k string, o int, value string")
    out = {r.k: r.value for r in pipe_groups(df, ["k"], ["tail", "-n", "1"], order=["o"]).collect()}
    assert out == {"a": "4", "b": "9"}


def test_read_fastq_across_many_splits(spark):
    d = tempfile.mkdtemp(prefix="fq-")
    recs = [(f"r{i}", "ACGT" * (i % 7 + 1), "@" + "I" * (4 * (i % 7 + 1) - 1)) for i in range(3000)]
    with open(f"{d}/big.fq", "w") as fh:
        for rid, s, q in recs:
            fh.write(f"@{rid}\n{s}\n+\n{q}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = FM.read_fastq(spark, f"{d}/big.fq")
        assert df.rdd.getNumPartitions() >= 1
        got = {(r.read_id, r.seq, r.qual) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == set(recs)
