"""Cases that fixed limits, caps or short cuts would get wrong."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from omics_spark.functions.seq import codons, kmers, translate_codons
from omics_spark.functions.stats import match_mismatch_parameters
from omics_spark.operators import intervals as IV
from omics_spark.operators.pipe import pipe_lines
from omics_spark.operators.windows import bh_qvalues
from omics_spark.plans.homology import genome_tiles, map_reads, similarity_search
from omics_spark.plans.somatic import reference_bases
from omics_spark.plans.structures import label_regions
from omics_spark.plans.sv import split_evidence
from omics_spark.session import checkpoint_dir
from omics_spark.sources import formats as FM

CODE = random.Random(5)
GENE = "".join(CODE.choice("ACGT") for _ in range(300))


def letters(seed, n):
    rnd = random.Random(seed)
    return "".join(rnd.choice("ACGT") for _ in range(n))


def test_many_identical_subjects_all_hit(spark):
    q = spark.createDataFrame([(1, GENE)], "seq_id int, seq string")
    s = spark.createDataFrame([(i, GENE) for i in range(101)], "seq_id int, seq string")
    assert similarity_search(q, s, max_hits=500).count() == 101


def test_blastx_gives_max_hits_a_query(spark):
    protein = [(i, translated) for i, translated in enumerate([letters(i, 5) + "MKLVWERTYPASDFGHIKLMNPQRST" for i in range(12)])]
    back = {"M": "ATG", "K": "AAA", "L": "CTG", "V": "GTT", "W": "TGG", "E": "GAA", "R": "CGT", "T": "ACC", "Y": "TAT", "P": "CCG",
            "A": "GCT", "S": "TCT", "D": "GAT", "F": "TTT", "G": "GGT", "H": "CAT", "I": "ATT", "N": "AAC", "Q": "CAG"}
    dna = "".join(back[a] for a in "MKLVWERTYPASDFGHIKLMNPQRST")
    q = spark.createDataFrame([(1, dna)], "seq_id int, seq string")
    s = spark.createDataFrame(protein, "seq_id int, seq string")
    hits = similarity_search(q, s, "blastx", max_hits=5).collect()
    assert len(hits) == 5 and {h["query"] for h in hits} == {1} and {h["q_frame"] for h in hits} == {1}
    back_hits = similarity_search(s, q, "tblastn", max_hits=5).collect()
    assert len(back_hits) == 12 and {h["subject"] for h in back_hits} == {1}


def test_ungapped_parameters():
    lam, k = match_mismatch_parameters(0.25)
    assert abs(lam - 1.0986) < 1e-4 and abs(k - 1 / 3) < 1e-9


def test_long_windows_and_reads_come_whole(spark):
    seq = letters(1, 9000)
    genome = spark.createDataFrame([("c", seq)], "contig string, seq string")
    loci = spark.createDataFrame([("c", 1500)], "contig string, pos0 int")
    assert reference_bases(loci, genome, length=3000).first()["ref_base"] == seq[1500:4500]
    assert reference_bases(loci, genome, length=F.lit(2500)).first()["ref_base"] == seq[1500:4000]
    reads = spark.createDataFrame([("r", seq[700:3200])], "read_id string, seq string")
    r = map_reads(reads, genome).first()
    assert (r["pos"], r["cigar"], r["nm"]) == (701, "2500M", 0)


def test_kmers_codons_and_tiles_of_long_sequences(spark):
    for n in (0, 1, 4, 5, 511, 512, 513, 516, 1030, 3000):
        s = letters(n, n)
        r = spark.createDataFrame([(s,)], "s string").select(kmers(F.col("s"), 5).alias("k"), kmers(F.col("s"), 1).alias("one"), codons(F.col("s"), 1).alias("c"),
                                                              kmers(F.col("s"), 600).alias("big")).first()
        assert [(x["pos"], x["kmer"]) for x in r["k"]] == [(i, s[i:i + 5]) for i in range(n - 4)]
        assert [x["kmer"] for x in r["one"]] == list(s)
        assert [x["kmer"] for x in r["big"]] == [s[i:i + 600] for i in range(n - 599)]
        assert r["c"] == [s[i:i + 3] for i in range(1, n - 2, 3)]
    s = letters(9, 2345)
    t = genome_tiles(spark.createDataFrame([("c", s)], "contig string, seq string"), 100, 250).orderBy("tile").collect()
    assert [x["tile_seq"] for x in t] == [s[i:i + 350] for i in range(0, 2345, 100)]


def test_sequence_work_is_linear_in_length(spark):
    def seconds(n):
        df = spark.createDataFrame([("c", letters(2, n))], "contig string, seq string")
        best = []
        for _ in range(2):
            t = time.time()
            df.select(F.size(kmers(F.col("seq"), 12)), F.length(translate_codons(F.col("seq")))).collect()
            genome_tiles(df).agg(F.sum(F.length("tile_seq"))).collect()
            best.append(time.time() - t)
        return min(best)

    seconds(10_000)
    assert seconds(800_000) < 6 * seconds(200_000) + 2


def test_greedy_keeps_what_does_not_overlap(spark):
    def got(rows):
        df = spark.createDataFrame(rows, "contig string, start_pos bigint, end_pos bigint, score int, name string")
        return sorted(r["name"] for r in IV.greedy_nonoverlap(df, "score", ["name"]).collect())

    assert got([("c", 0, 10, 1, "a"), ("c", 10, 20, 2, "b")]) == ["a", "b"]          # book-ended
    assert got([("c", 0, 10, 2, "a"), ("c", 5, 15, 3, "b"), ("c", 12, 20, 1, "c"), ("c", 15, 30, 1, "d")]) == ["b", "d"]  # a chain
    assert got([("c", 9, 9, 1, "empty"), ("c", 0, 9, 1, "a"), ("c", 0, 9, 1, "a")]) == ["a", "empty"]
    rnd = random.Random(3)
    rows = [(f"c{i % 2}", s, s + rnd.randint(1, 900), rnd.randint(0, 20), f"{i:03}") for i in range(400) for s in [rnd.randint(0, 20_000)]]
    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[4])):
        if all(k[0] != r[0] or k[2] <= r[1] or r[2] <= k[1] for k in kept):
            kept.append(r)
    assert got(rows) == sorted(k[4] for k in kept)


def test_null_p_stays(spark):
    df = spark.createDataFrame([(1, 0.01), (2, None), (3, 0.04)], "id int, p double")
    assert {r["id"]: r["q"] for r in bh_qvalues(df).collect()} == {1: 0.02, 2: None, 3: 0.04}


def test_restrict_after_a_shuffle(spark):
    rows = [("c", 100 * i, 100 * i + 50 + 9000 * (i % 3 == 0), i) for i in range(200)]
    df = spark.createDataFrame(rows, "contig string, start_pos bigint, end_pos bigint, id int").repartition(7)
    regions = spark.createDataFrame([("c", 5000, 5100), ("c", 15_000, 15_020)], "contig string, start_pos bigint, end_pos bigint")
    want = {i for c, s, e, i in rows if any(s < b and a < e for a, b in ((5000, 5100), (15_000, 15_020)))}
    assert {r["id"] for r in IV.restrict_to_intervals(df, regions, "semi").collect()} == want
    assert {r["id"] for r in IV.restrict_to_intervals(df, regions, "anti").collect()} == set(range(200)) - want


def test_far_pixels_are_two_objects(spark):
    df = spark.createDataFrame([(0, 16384, 0, 1.0), (1, 0, 0, 1.0), (0, 0, 1, 1.0), (0, 1, 1, 1.0)], "y int, x int, image_id int, value double")
    got = label_regions(df).collect()
    assert sorted((r["image_id"], r["area"]) for r in got) == [(0, 1), (0, 1), (1, 2)]


def test_a_deep_image_leaves_flat_ones_alone(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 1.0), (1, 0, 0, 1, 1.0), (0, 0, 0, 2, 1.0)], "z int, y int, x int, image_id int, value double")
    got = {r["image_id"]: round(r["diameter"], 3) for r in label_regions(df).collect()}
    assert got == {0: 1.128, 1: 1.241, 2: 1.128}


def test_split_reads_by_clipped_side(spark):
    rows = [("del_l", 1000, 0, "30M20S", "c,5000,+,30S20M,60,0;"), ("del_r", 5000, 0, "30S20M", "c,1000,+,30M20S,60,0;"),
            ("dup", 5000, 0, "30M20S", "c,1000,+,30S20M,60,0;"), ("two", 1000, 0, "30M20S", "c,5000,+,30S20M,60,0;d,7,-,9S41M,60,0;"), ("none", 1, 0, "50M", None)]
    df = spark.createDataFrame([(q, "c", p, f, c, s) for q, p, f, c, s in rows], "qname string, contig string, pos bigint, flag int, cigar string, sa string")
    got = sorted((r["qname"], r["sv_type"]) for r in split_evidence(df).collect())
    assert got == [("del_l", "DEL"), ("del_r", "DEL"), ("dup", "DUP"), ("two", "BND"), ("two", "DEL")]


def test_vcf_short_fields_repeated_info_and_samples_by_file(spark, tmp_path):
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    (tmp_path / "a.vcf").write_text(head + "SA\n1\t5\t.\tA\tC\t9\tPASS\tDP=3;DP=4;FLAG\tGT:DP:GQ\t./.\n")
    (tmp_path / "b.vcf").write_text(head + "SB\tSC\n1\t6\t.\tA\tC\t.\tPASS\t.\tGT\t0/1\t1/1\n")
    a, b = FM.read_vcf(spark, str(tmp_path)).orderBy("pos").collect()
    assert [g["sample"] for g in a["genotypes"]] == ["SA"] and a["genotypes"][0]["fields"] == {"GT": "./.", "DP": None, "GQ": None}
    assert a["info"] == {"DP": "3", "FLAG": None}
    assert [(g["sample"], g["fields"]["GT"]) for g in b["genotypes"]] == [("SB", "0/1"), ("SC", "1/1")]
    only = FM.read_vcf(spark, str(tmp_path / "a.vcf")).first()
    assert only["genotypes"] == a["genotypes"]


def test_sam_tag_types_and_order(spark, tmp_path):
    lines = ["r1\t0\tchr10\t7\t60\t5M\t*\t0\t0\tACGTA\tIIIII\tNM:i:1\tRG:Z:x", "r2\t0\tchr2\t9\t60\t5M\t*\t0\t0\tACGTA\tIIIII",
             "r3\t4\t*\t0\t0\t*\t*\t0\t0\tACGTA\tIIIII", "r4\t0\tother\t1\t60\t5M\t*\t0\t0\tACGTA\tIIIII"]
    (tmp_path / "x.sam").write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "out")
    FM.write_sam(FM.read_sam(spark, str(tmp_path / "x.sam")), out, [("chr2", 100), ("chr10", 100)])
    body = []
    for f in sorted(os.listdir(out)):
        if f.startswith("part-"):
            body += open(f"{out}/{f}").read().splitlines()
    assert [x.split("\t")[0] for x in body if not x.startswith("@")] == ["r2", "r1", "r4", "r3"]
    assert "NM:i:1" in body[-3].split("\t") + body[-4].split("\t") + body[-2].split("\t")


def test_pipe_sees_the_workers_environment(spark):
    df = spark.range(5).selectExpr("cast(id as string) as value").coalesce(1)
    got = [r["value"] for r in pipe_lines(df, ["sh", "-c", 'echo "$PATH|$OWN"; cat'], header=["h"], env={"OWN": "x"}).collect()]
    assert got[0] == f"{os.environ['PATH']}|x" and got[1:] == ["h", "0", "1", "2", "3", "4"]
    assert [r["value"] for r in pipe_lines(df, ["head", "-n", "1"]).collect()] == ["0"]
    with pytest.raises(Exception, match="non-zero exit|returned"):
        pipe_lines(df, ["false"]).collect()


def test_no_local_checkpoint_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_a_feature_planted_twice_is_found_twice(spark):
    from omics_spark.plans.homology import annotate_plasmid

    plasmid = letters(21, 400) + GENE[:80] + letters(22, 300) + GENE[:80] + letters(23, 200)
    p = spark.createDataFrame([(1, plasmid)], "seq_id int, seq string")
    f = spark.createDataFrame([(7, GENE[:80])], "feature_id int, seq string")
    starts = [r["start_pos"] for r in annotate_plasmid(p, f).collect()]
    assert len(starts) == 2 and all(any(abs(x - at) < 8 for x in starts) for at in (400, 780))


def test_genus_is_preferred_wherever_the_title_names_it(spark):
    from omics_spark.plans.sequences import annotate_genome

    protein = "MKLVWERTYPASDFGHIKLMNPQRSTKLVWERTYPASDFG"
    back = dict(zip("MKLVWERTYPASDFGHINQ", "ATG AAA CTG GTT TGG GAA CGT ACC TAT CCG GCT TCT GAT TTT GGT CAT ATT AAC CAG".split()))
    dna = "CC" + "".join(back[a] for a in protein) + "TAA" + "CC"
    contigs = spark.createDataFrame([("c", dna)], "contig string, seq string")
    rows = [(i, protein, f"protein {i}") for i in range(60)] + [(99, protein, "x" * 100 + " of Rarus")]
    db = spark.createDataFrame(rows, "seq_id int, seq string, title string")
    top = [r for r in annotate_genome(contigs, db, genus="rarus", min_aa=30).collect() if r["strand"] == "+" and r["score"]]
    assert top and top[0]["product"] == "x" * 80


def test_read_region_finds_reads_from_far_away(spark):
    from omics_spark.operators import alignments as AL

    rows = [("far", "chr1", 101, "10M3000000N10M"), ("near", "chr1", 2_999_990, "50M"), ("past", "chr1", 3_000_300, "50M"),
            ("short", "chr1", 101, "50M"), ("other", "chr2", 101, "10M3000000N10M"), ("flat", "chr1", 3_000_050, None)]
    path = AL.write_indexed(spark.createDataFrame(rows, "qname string, contig string, pos int, cigar string"),
                            AL.scratch_path(spark, "far-reads"))
    got = AL.read_region(spark, path, "chr1:3,000,001-3,000,200")
    assert sorted(r["qname"] for r in got.collect()) == ["far", "flat", "near"]
    assert got.columns == ["qname", "pos", "cigar", "contig"]
    assert "level" in got._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
