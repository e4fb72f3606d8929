"""Operators against plain versions and hand-made cases: breakpoint pairs,
split codons, indels, medians, greedy chains, streamed groups, ORFs and FASTA
over tiles, indexed reads, packed k-mers, large statistics, file listings."""

import glob
import itertools
import math
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from omics_spark.functions import stats as ST
from omics_spark.functions.seq import identity_distance_error
from omics_spark.operators import alignments as AL
from omics_spark.operators import intervals as IV
from omics_spark.operators import kmers as K
from omics_spark.operators.pipe import pipe_groups
from omics_spark.operators.topk import quota_sample
from omics_spark.operators.windows import group_medians
from omics_spark.plans import somatic as SO
from omics_spark.plans import sv as SV
from omics_spark.plans.homology import annotate_plasmid, map_reads
from omics_spark.plans.peaks import background_windows, motif_enrichment_in_peaks
from omics_spark.plans.sequences import find_orfs, orfs_of_tiles
from omics_spark.plans.structures import screen_poses
from omics_spark.sources import formats as FM


def letters(seed, n, alphabet="ACGT"):
    rng = random.Random(seed)
    return "".join(rng.choice(alphabet) for _ in range(n))


# ------------------------------------------------------------- P15


def linked(points, gap):
    """Sets of points that links of both ends reach."""
    left, found = set(points), []
    while left:
        group, new = set(), [left.pop()]
        while new:
            p = new.pop()
            group.add(p)
            near = {q for q in left if abs(p[0] - q[0]) <= gap and abs(p[1] - q[1]) <= gap}
            left -= near
            new += near
        found.append(frozenset(group))
    return set(found)


@pytest.mark.parametrize("gap,spread", [(5, 60), (6, 60), (1, 14), (20, 300)])
def test_breakpoint_clusters_are_the_components(spark, gap, spread):
    rng = random.Random(gap)
    points = list({(rng.randint(0, spread), rng.randint(0, spread)) for _ in range(90)})
    ev = spark.createDataFrame([("DEL", "a", a, "a", b) for a, b in points], "sv_type string, contig string, pos1 long, contig2 string, pos2 long")
    got = {}
    for r in SV.cluster_breakpoints(ev, gap).collect():
        got.setdefault(r["cluster"], set()).add((r["pos1"], r["pos2"]))
    assert {frozenset(g) for g in got.values()} == linked(points, gap)


def test_events_that_share_an_end_and_both_views_of_a_pair(spark):
    rows = [(f"d{i}", "a", 1000 + i, 97, "a", 5000 + i) for i in range(3)] + [(f"e{i}", "a", 1001 + i, 97, "a", 9000 + i) for i in range(4)]
    rows += [("x", "a", 100, 97, "b", 700), ("y", "b", 705, 97, "a", 90)]
    pairs = spark.createDataFrame(rows, "qname string, contig string, pos long, flag int, rnext string, pnext long")
    got = {(r["sv_type"], r["contig"], r["contig2"], r["start"], r["end"], r["support"]) for r in SV.structural_variants(pairs).collect()}
    assert got == {("DEL", "a", "a", 1000, 5002, 3), ("DEL", "a", "a", 1001, 9003, 4), ("BND", "a", "b", 90, 705, 2)}


# ------------------------------------------------------------- P14


@pytest.mark.parametrize("strand", ["+", "-"])
def test_codons_over_exon_edges(spark, strand):
    # the coding sequence ATG GCA TGG TAA in parts of 4, 1, 2 and 5 letters
    coding, sizes = "ATGGCATGGTAA", [4, 1, 2, 5]
    genome, parts, at, used = ["C"] * 60, [], 5, 0
    for n in sizes:
        for i in range(n):
            genome[at + i] = coding[used + i]
        parts.append((at, at + n))
        at, used = at + n + 3, used + n
    genome = "".join(genome)
    if strand == "-":
        genome = genome.translate(str.maketrans("ACGT", "TGCA"))[::-1]
        parts = [(60 - b, 60 - a) for a, b in parts]
    g = spark.createDataFrame([("c", genome)], "contig string, seq string")
    models = spark.createDataFrame([("c", a, b, strand, "CDS", "gene") for a, b in parts], "contig string, start_pos long, end_pos long, strand string, feature string, gene_id string")
    places = [p for a, b in (parts if strand == "+" else parts) for p in range(a, b)]
    order = sorted(places, reverse=strand == "-")
    code = {"ATG": "M", "GCA": "A", "TGG": "W", "TAA": "*"}
    rows = [("c", p + 1, genome[p], {"A": "C", "C": "G", "G": "T", "T": "A"}[genome[p]]) for p in order]
    got = {r["pos"]: r for r in SO.annotate_effects(spark.createDataFrame(rows, "contig string, pos long, ref string, alt string"), models, g).collect()}
    from omics_spark.functions.seq import codon_table
    table = codon_table()
    for t, (_, pos, _, alt) in enumerate(rows):
        base = alt if strand == "+" else alt.translate(str.maketrans("ACGT", "TGCA"))
        codon = coding[t - t % 3:t - t % 3 + 3]
        changed = codon[:t % 3] + base + codon[t % 3 + 1:]
        assert got[pos]["aa_change"] == f"{code[codon]}>{table[changed]}", (strand, t)


# ------------------------------------------------------------- P12


def test_indels_in_homopolymers_are_called_once(spark):
    genome = letters(1, 40) + "C" + "A" * 230 + "G" + letters(2, 60)
    at = 41                                     # first A
    rows = []
    for i, cut in enumerate((41, 90, 150, 200, 268)):      # the same deletion of AA and insertion of A, written at many places
        head = cut - 30
        rows.append(("tumor", "c", 31, 0, f"{cut - 30}M2D{60}M", genome[30:cut] + genome[cut + 2:cut + 62]))
        rows.append(("tumor", "c", 31, 16, f"{cut - 30}M1I{60}M", genome[30:cut] + "A" + genome[cut:cut + 60]))
        rows.append(("normal", "c", 31, 0, f"{head}M", genome[30:cut]))
    reads = spark.createDataFrame([(*r, "I" * len(r[5])) for r in rows], "sample string, contig string, pos long, flag int, cigar string, seq string, qual string")
    g = spark.createDataFrame([("c", genome)], "contig string, seq string")
    calls = SO.somatic_calls(reads.where("sample = 'tumor'").drop("sample"), reads.where("sample = 'normal'").drop("sample"), g).collect()
    got = {(r["pos"], r["ref"], r["alt"], r["t_alt"], r["n_alt"], r["t_alt_fwd"]) for r in calls}
    assert got == {(at, "CAA", "C", 5, 0, 5), (at, "C", "CA", 5, 0, 0)}


def test_left_alignment_against_all_equal_writings(spark):
    rng = random.Random(3)
    genome = letters(4, 80, "AC")
    rows, want = [], []
    for i in range(60):
        at, n = rng.randint(1, 70), rng.randint(1, 4)
        if i % 2:
            letters_, result = genome[at:at + n], genome[:at] + genome[at + n:]
            spots = [(a, genome[a:a + n]) for a in range(0, 81 - n) if genome[:a] + genome[a + n:] == result]
        else:
            letters_ = letters(i, n, "AC")
            result = genome[:at] + letters_ + genome[at:]
            spots = [(a, result[a:a + n]) for a in range(0, 81) if genome[:a] + result[a:a + n] + genome[a:] == result]
        rows.append((i, "c", at, letters_))
        want.append((i, *min(spots)))
    g = spark.createDataFrame([("c", genome)], "contig string, seq string")
    df = spark.createDataFrame(rows, "id int, contig string, at long, letters string")
    got = sorted((r["id"], r["at"], r["letters"]) for r in SO.left_aligned(df, g, context=7).collect())
    assert got == sorted(want)


# ------------------------------------------------------------- E8, E9


def test_exact_medians_of_many_groups(spark):
    rng = random.Random(2)
    groups = {"many": [rng.gauss(0, 1) for _ in range(5001)], "ties": [1.0] * 40 + [2.0] * 40, "wide": [10.0 ** e * s for e in range(-300, 300, 7) for s in (1, -1)],
              "one": [5.0], "close": [1.0 + i * 2 ** -52 for i in range(100)], "zeros": [0.0, -0.0, 0.0, 3.0], "two": [-1e308, 1e308 / 3]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("none", None)]
    got = {r["g"]: r["_med"] for r in group_medians(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    assert got == {g: statistics.median(v) if len(v) % 2 else (lambda a, b: a + (b - a) * 0.5)(*sorted(v)[len(v) // 2 - 1:len(v) // 2 + 1]) for g, v in groups.items()}


def greedy(hits, length=None):
    """Names taken: best score first, then name."""
    taken = []

    def places(s, e):
        return {p % length if length else p for p in range(s, e)}

    for s, e, score, name in sorted(hits, key=lambda h: (-h[2], h[3])):
        if not any(places(s, e) & t for t, _ in taken):
            taken.append((places(s, e), name))
    return sorted(n for _, n in taken)


@pytest.mark.parametrize("island", [100_000, 7])
def test_greedy_choice_in_islands_and_rounds(spark, island):
    rng = random.Random(island)
    hits = [(s := rng.randint(0, 900), s + rng.randint(1, 30), rng.randint(0, 20), f"h{i:03}") for i in range(250)]
    df = spark.createDataFrame([("c", *h) for h in hits], "contig string, start_pos long, end_pos long, score int, name string")
    assert sorted(r["name"] for r in IV.greedy_nonoverlap(df, "score", ["name"], island=island).collect()) == greedy(hits)


def test_a_long_chain_takes_no_rounds(spark):
    df = spark.range(30_000).selectExpr("'c' contig", "id * 10 start_pos", "id * 10 + 15 end_pos", "-id score", "id name")
    got = IV.greedy_nonoverlap(df, "score", ["name"], max_rounds=1).agg(F.count("*"), F.sum("name")).first()
    assert tuple(got) == (15_000, sum(range(0, 30_000, 2)))


@pytest.mark.parametrize("island", [100_000, 5])
def test_greedy_choice_on_a_circle(spark, island):
    rng = random.Random(9)
    hits = [(s := rng.randint(0, 199), s + rng.randint(1, 40), rng.randint(0, 9), f"h{i:03}") for i in range(60)]
    df = spark.createDataFrame([("c", *h, 200) for h in hits], "contig string, start_pos long, end_pos long, score int, name string, n long")
    assert sorted(r["name"] for r in IV.greedy_nonoverlap(df, "score", ["name"], island=island, circle="n").collect()) == greedy(hits, 200)


def test_plasmid_hits_over_the_origin(spark):
    whole = letters(11, 400)
    plasmid = whole[20:] + whole[:20]
    features = [("ori", whole[:120]), ("inside", whole[10:60]), ("far", whole[200:260])]
    got = {r["feature"]: (r["start_pos"], r["end_pos"], r["wraps"]) for r in annotate_plasmid(
        spark.createDataFrame([(1, plasmid)], "seq_id int, seq string"), spark.createDataFrame(features, "feature_id string, seq string")).collect()}
    assert got == {"ori": (380, 100, True), "far": (180, 240, False)}


# ------------------------------------------------------------- U2


def test_groups_stream_and_may_stop_early(spark):
    df = spark.range(60_000).selectExpr("case when id % 3 = 0 then 'hot' else cast(id % 40 as string) end k", "id", "cast(id as string) value")
    got = {r["k"]: r["value"] for r in pipe_groups(df, ["k"], ["head", "-n", "1"], order=["id"]).collect()}
    want = {r["k"]: str(r["m"]) for r in df.groupBy("k").agg(F.min("id").alias("m")).collect()}
    assert got == want
    counts = {r["k"]: int(r["value"]) for r in pipe_groups(df, ["k"], ["wc", "-l"], order=["id"]).collect()}
    assert counts["hot"] == 20_000 and sum(counts.values()) == 60_000
    with pytest.raises(Exception):
        pipe_groups(df, ["k"], ["false"], order=["id"]).count()


# ------------------------------------------------------------- P10, A4


def brute_orfs(seq, min_aa):
    from omics_spark.functions.seq import codon_table
    table, out = codon_table(), []
    for strand in "+-":
        s = seq if strand == "+" else seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]
        for frame in range(3):
            aa = "".join(table.get(s[i:i + 3], "X") for i in range(frame, len(s) - 2, 3))
            at = 0
            for part in aa.split("*")[:-1]:
                m = part.find("M")
                if m >= 0 and len(part) - m >= min_aa:
                    a, b = frame + 3 * (at + m), frame + 3 * (at + len(part)) + 3
                    a, b = (a, b) if strand == "+" else (len(s) - b, len(s) - a)
                    out.append((strand, frame, a, b, part[m:]))
                at += len(part) + 1
    return sorted(out)


def test_orfs_over_tiles(spark):
    seqs = {"a": letters(21, 6000), "b": letters(22, 1000, "ACGTN"), "c": "ATG" + "GCT" * 900 + "TAA", "d": "AT", "e": ""}
    df = spark.createDataFrame(list(seqs.items()), "contig string, seq string")
    got = {}
    for r in find_orfs(df, 8).collect():
        got.setdefault(r["contig"], []).append((r["strand"], r["frame"], r["start_pos"], r["end_pos"], r["protein"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: b for k, s in seqs.items() if (b := brute_orfs(s, 8))}


def test_a_genome_is_read_in_tiles_from_its_lines(spark, tmp_path):
    seqs = {"chr1": letters(31, 5000), "chr2": letters(32, 61), "empty": "", "chr3": letters(33, 120)}
    with open(tmp_path / "g.fa", "w") as f:
        for name, s in seqs.items():
            f.write(f">{name} some words\n" + "".join(s[i:i + 60] + "\r\n" for i in range(0, len(s), 60)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        for width, overlap in ((90, 0), (60, 25), (7, 2)):
            got = {(r["contig"], r["tile"]): r["tile_seq"] for r in FM.fasta_tiles(spark, str(tmp_path / "g.fa"), width, overlap).collect()}
            assert got == {(n, i // width): s[i:i + width + overlap] for n, s in seqs.items() for i in range(0, len(s), width)}
        tiles = FM.fasta_tiles(spark, str(tmp_path / "g.fa"), 510, 2)
        lengths = spark.createDataFrame([(n, len(s)) for n, s in seqs.items()], "contig string, length long")
        got = sorted((r["strand"], r["frame"], r["start_pos"], r["end_pos"], r["protein"]) for r in orfs_of_tiles(tiles, lengths, 510, 10).where("contig = 'chr1'").collect())
        assert got == brute_orfs(seqs["chr1"], 10)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


# ------------------------------------------------------------- A13, G1


def test_one_bin_a_read_and_regions_find_all(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "c", rng.randint(1, 60_000), f"10M{rng.choice([1, 1, 50, 3000, 40_000])}N10M") for i in range(400)]
    reads = spark.createDataFrame(rows, "id int, contig string, pos long, cigar string")
    path = AL.write_indexed(reads, str(tmp_path / "x"), bin_size=500)
    folders = glob.glob(f"{path}/contig=c/level=*/bin=*")
    assert len(folders) <= 60_000 * 8 / 7 / 500 + 400 / 8 + 8 and sum(len(glob.glob(f + "/*.parquet")) for f in folders) == len(folders)
    for region in ("c:100-200", "c:30,000-30,001", "c:59000", "c", "d:1-5"):
        contig, s, e = AL.parse_region(region)
        found = AL.read_region(spark, path, region, bin_size=500)
        want = {i for i, c, p, cig in rows if c == contig and p - 1 + 20 + int(cig[3:-4]) > s and (e is None or p - 1 < e)}
        assert {r["id"] for r in found.collect()} == want
    plan = AL.read_region(spark, path, "c:100-200", bin_size=500)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_unplaced_reads_are_numbered_over_many_tasks(spark):
    df = spark.range(5000).selectExpr("case when id % 5 = 0 then 'chr1' end contig", "case when id % 5 = 0 then id div 50 end pos", "id rid")
    got = AL.sort_alignments(df, tie=["rid"]).collect()
    placed = [r for r in got if r["contig"] == "chr1"]
    assert [r["ordinal"] for r in placed] == list(range(1, 1001)) and placed == got[:1000]
    assert [(r["rid"], r["ordinal"]) for r in got[1000:]] == list(zip((i for i in range(5000) if i % 5), range(1, 4001)))


# ------------------------------------------------------------- C4, P1


def test_packed_kmers_are_the_string_kmers(spark):
    seqs = [(1, letters(41, 700)), (2, letters(42, 30, "ACGTN").lower()), (3, ""), (4, "ACG"), (5, None)]
    df = spark.createDataFrame(seqs, "seq_id int, seq string")
    for k in (1, 5, 16, 21):
        strings = {(r["id"], r["strand"], r["pos"]): r["kmer"] for r in K.explode_kmers(df, k, both_strands=True).collect()}
        packed = {(r["id"], r["strand"], r["pos"]): r["kmer"] for r in K.packed_kmers(df, k, both_strands=True).collect()}
        assert strings.keys() == packed.keys()
        assert len(set(strings.values())) == len(set(packed.values())) == len(set(zip(strings.values(), (packed[p] for p in strings))))
    both = [sorted(map(tuple, K.kmer_join(df, df, k).collect())) for k in (20, 25)]
    assert {x for x in both[1]} <= {x for x in both[0]}


def test_mates_and_shared_ids_are_mapped_one_by_one(spark):
    genome = letters(51, 3000)
    reads = [("r", 1, genome[100:160]), ("r", 2, genome[900:960]), ("s", 1, genome[500:560]), ("s", 1, genome[1500:1560]), ("t", 1, genome[7:67]), ("t", 1, genome[7:67])]
    got = sorted((r["read_id"], r["mate"], r["pos"]) for r in map_reads(
        spark.createDataFrame(reads, "read_id string, mate int, seq string"), spark.createDataFrame([("c", genome)], "contig string, seq string")).collect())
    assert got == [("r", 1, 101), ("r", 2, 901), ("s", 1, 501), ("s", 1, 1501), ("t", 1, 8), ("t", 1, 8)]


# ------------------------------------------------------------- F7-F9


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_tails_of_large_counts(spark):
    # against normal limits and exact small sums
    assert abs(value(spark, ST.poisson_upper(F.lit(4_000_000_000), F.lit(4e9))) - 0.5) < 1e-4
    assert abs(value(spark, ST.binom_upper(F.lit(500_000_000), F.lit(1_000_000_000), F.lit(0.5))) - 0.5) < 1e-4
    assert abs(value(spark, ST.hypergeom_upper(F.lit(250_000_000), F.lit(500_000_000), F.lit(500_000_000), F.lit(1_000_000_000))) - 0.5) < 1e-4
    for n, p in ((30, 0.3), (40, 0.9)):
        for k in range(0, n + 2):
            exact = sum(math.comb(n, j) * p ** j * (1 - p) ** (n - j) for j in range(k, n + 1))
            assert abs(value(spark, ST.binom_upper(F.lit(k), F.lit(n), F.lit(p))) - exact) < 1e-9
    for k, d, m, t in itertools.product((0, 1, 5, 9, 12), (10, 25), (12, 28), (30,)):
        exact = sum(math.comb(m, j) * math.comb(t - m, d - j) for j in range(k, min(d, m) + 1) if t - m >= d - j) / math.comb(t, d)
        assert abs(value(spark, ST.hypergeom_upper(F.lit(k), F.lit(d), F.lit(m), F.lit(t))) - exact) < 1e-9


def test_lengths_that_differ_are_an_error(spark):
    assert value(spark, identity_distance_error(F.lit("ACG"), F.lit("AC"))) == "Sequences must be aligned: lengths 3 and 2 differ."
    assert value(spark, identity_distance_error(F.lit("AC"), F.lit("AT"))) is None


# ------------------------------------------------------------- P9


def test_quota_sample_is_exact_and_repeatable(spark):
    df = spark.range(20_000).selectExpr("id", "case when id % 10 < 9 then 0 else id % 3 end g")
    quotas = spark.createDataFrame([(0, 700), (1, 5), (2, 10_000)], "g int, quota long")
    got = [sorted((r["g"], r["id"]) for r in quota_sample(df.repartition(n), ["g"], F.col("id").cast("string"), quotas).collect()) for n in (1, 13)]
    assert got[0] == got[1]
    counts = {g: len([1 for h, _ in got[0] if h == g]) for g in (0, 1, 2)}
    assert counts == {0: 700, 1: 5, 2: df.where("g = 2").count()}


def test_background_keeps_off_peaks_and_inside_contigs(spark):
    genome = spark.createDataFrame([("c", letters(61, 4000)), ("d", letters(62, 150))], "contig string, seq string")
    motif = "ACGTTGCA"
    rows = [("c", a, a + 100) for a in (50, 900, 1300, 2500, 3890)] + [("d", 10, 60)]
    seq = list(letters(61, 4000))
    for _, a, b in rows[:5]:
        seq[(a + b) // 2:(a + b) // 2 + 8] = motif
    genome = spark.createDataFrame([("c", "".join(seq)), ("d", letters(62, 150))], "contig string, seq string")
    peaks = spark.createDataFrame(rows, "contig string, start_pos long, end_pos long")
    back = background_windows(peaks, genome, 200, (-400, 400, 800)).collect()
    assert back and all(len(r["seq"]) == 200 and r["end_pos"] <= 4000 and not any(r["contig"] == c and r["start_pos"] < b and a < r["end_pos"] for c, a, b in rows) for r in back)
    top = motif_enrichment_in_peaks(peaks, genome, 200, 8, shifts=(-400, 400, 800)).where("rank <= 3").collect()
    assert motif in {r["kmer"] for r in top} and top[0]["n_target"] == 6


# ------------------------------------------------------------- P18


def test_poses_meet_their_own_receptor(spark):
    atoms = [(k, i, "C", 3.0 * i, 0.0, 0.0) for k in (1, 2) for i in range(3)]
    receptor = spark.createDataFrame([a for a in atoms if a[0] == 1 or a[1] == 0], "rid int, atom_id long, element string, x double, y double, z double")
    poses = spark.createDataFrame([(k, "lig", 0, 0, "C", 0.0, 3.0, 0.0) for k in (1, 2)], "rid int, ligand string, pose_id int, atom_id int, element string, x double, y double, z double")
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0)], "rid int, cx double, cy double, cz double")
    got = {r["rid"]: r["contacts"] for r in screen_poses(poses, receptor, boxes, on="rid").collect()}
    assert got == {1: 3, 2: 1}


# ------------------------------------------------------------- A2, A3, A7


def test_folders_are_listed(spark, tmp_path):
    (tmp_path / "b.txt").write_text("hello")
    (tmp_path / "a").mkdir()
    got = [(r["name"], r["size"], r["is_dir"]) for r in FM.list_files(spark, str(tmp_path)).collect()]
    assert got == [("a", None, True), ("b.txt", 5, False)]
    assert FM.list_files(spark, str(tmp_path / "none")).count() == 0


def test_preview_in_file_order(spark, tmp_path):
    for name, n in (("b", 40), ("a", 3)):
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(n)))
    rows = FM.preview_lines(FM.read_lines(spark, str(tmp_path)), 5).orderBy("line_no").collect()
    assert [r["value"] for r in rows] == ["a0", "a1", "a2", "b0", "b1"] and all(r["truncated"] for r in rows)


def test_genotypes_and_info_round_trip(spark, tmp_path):
    path = os.path.join(os.path.dirname(__file__), "data", "tiny.vcf")
    first = FM.read_vcf(spark, path)
    FM.write_vcf(first, str(tmp_path / "out"))
    def plain(df):
        return sorted(str(r.asDict(recursive=True)) for r in df.collect())
    assert plain(FM.read_vcf(spark, str(tmp_path / "out"))) == plain(first)


# ------------------------------------------------------------- P11


def best_hit(q, s, k):
    """(raw, identities, length) of the best ungapped segment on a diagonal with k equal letters in a row."""
    best = None
    for diag in range(-len(q) + 1, len(s)):
        cells = [(i, q[i] == s[i + diag]) for i in range(max(0, -diag), min(len(q), len(s) - diag))]
        if not any(all(same for _, same in cells[a:a + k]) for a in range(len(cells) - k + 1)):
            continue
        for a in range(len(cells)):
            raw = 0
            for b in range(a, len(cells)):
                raw += 1 if cells[b][1] else -1
                if best is None or raw > best[0]:
                    best = raw, sum(same for _, same in cells[a:b + 1]), b - a + 1
    return best


def test_genome_annotation_against_all_hits(spark):
    from omics_spark.plans.homology import PROT_K, PROT_LAMBDA
    from omics_spark.plans.sequences import annotate_genome

    genome = letters(71, 900)
    orfs = brute_orfs(genome, 20)
    assert len(orfs) >= 2
    first = orfs[0][4]
    title = "a title of more than eighty letters, so that the genus stands far behind its cut end: Genus here"
    db = [(1, first[2:30], "plain"), (2, first[4:18] + "WWWWWW", title), (3, orfs[1][4][1:12] + "K" * 9, "other"), (4, "MKMKMKMK", "none")]
    got = {(r["strand"], r["start_pos"], r["end_pos"]): (r["product"], r["score"], r["pct"]) for r in annotate_genome(
        spark.createDataFrame([("c", genome)], "contig string, seq string"), spark.createDataFrame(db, "seq_id int, seq string, title string"), genus="Genus", min_aa=20).collect()}
    want = {}
    for strand, _, a, b, protein in orfs:
        hits = [("Genus" not in t, -round((PROT_LAMBDA * h[0] - math.log(PROT_K)) / math.log(2), 1), i, t, round(100 * h[1] / h[2], 1))
                for i, s, t in db if (h := best_hit(protein, s, 5))]
        want[strand, a, b] = (min(hits)[3][:80], -min(hits)[1], min(hits)[4]) if hits else ("hypothetical protein", None, None)
    assert got == want and title[:80] in {p for p, _, _ in got.values()}
