"""Structural variants and copy number: P15 structural_variants, P16
copy_number_profile (with C7, H2, E5, E7, E8, F12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import reads as R
from ..functions.seq import gc_fraction
from ..functions.stats import copy_number
from ..operators.alignments import bin_coverage, target_coverage
from ..operators.spatial import connected_components
from ..operators.variants import evidence_union
from ..operators.windows import change_points, median_center
from ..session import cut_lineage

# Fixed values (our specification choices): SV evidence defaults.
MAX_INSERT = 1000
MIN_SUPPORT = 2
CLUSTER_GAP = 500


def discordant_evidence(pairs: DataFrame, max_insert: int = MAX_INSERT) -> DataFrame:
    """Read-pair evidence from first-in-pair records (mate fields rnext,
    pnext): mate on another contig -> BND; both reads on one strand -> INV;
    forward-reverse with a span above ``max_insert`` -> DEL; reverse before
    forward -> DUP. One row per abnormal pair."""
    f = F.col("flag")
    rev = R.flag_has(f, R.REVERSE)
    mrev = R.flag_has(f, R.MATE_REVERSE)
    other = (F.col("rnext") != F.col("contig")) & (F.col("rnext") != "=")
    span = F.col("pnext") - F.col("pos")
    kind = (F.when(other, "BND").when(rev == mrev, "INV")
            .when(~rev & (span > max_insert), "DEL")
            .when(rev & ~mrev & (span > 0) & (span > max_insert), "DUP")
            .when(~rev & (span < 0), "DUP"))
    x = pairs.where(R.flag_has(f, R.PAIRED) & R.flag_lacks(f, R.UNMAPPED) & R.flag_lacks(f, R.MATE_UNMAPPED)
                    & R.flag_lacks(f, R.SECONDARY) & R.flag_lacks(f, R.SUPPLEMENTARY)
                    & (R.flag_has(f, R.READ1) | R.flag_lacks(f, R.READ2)))
    x = x.withColumn("sv_type", kind).where(F.col("sv_type").isNotNull())
    c2 = F.when(F.col("rnext") == "=", F.col("contig")).otherwise(F.col("rnext"))
    return x.select("qname", "sv_type", "contig", F.col("pos").alias("pos1"), c2.alias("contig2"),
                    F.col("pnext").alias("pos2"), F.lit("discordant").alias("evidence"))


def split_evidence(reads: DataFrame, sa_col: str = "sa", cigar_col: str = "cigar", read_len: int = 50) -> DataFrame:
    """Split-read evidence from every entry of the SAM ``SA`` tag
    (contig,pos,strand,CIGAR,mapq,nm;...).

    On one strand the read's clipped side tells which piece comes first: a
    read clipped at its end goes on in the other piece, one clipped at its
    start comes from it. A first piece that lies before the second is a
    deletion, else a duplication. Without a CIGAR of its own (no
    ``cigar_col``, or no clip in it) the side is taken from the other piece's
    CIGAR, and without that from ``read_len``."""
    entry = F.explode(F.filter(F.split(F.col(sa_col), ";"), lambda e: e != ""))
    own = F.col(cigar_col) if cigar_col in reads.columns else F.lit(None).cast("string")
    x = reads.where(F.col(sa_col).isNotNull()).select("qname", "contig", "pos", "flag", own.alias("c1"), entry.alias("_e"))
    part = F.split("_e", ",")
    x = x.select("qname", "contig", "pos", "flag", "c1", part.getItem(0).alias("c2"), part.getItem(1).cast("bigint").alias("p2"),
                 part.getItem(2).alias("s2"), F.get(part, 3).alias("cig2"))

    def clip(cigar: str, side: str) -> Column:
        return F.coalesce(F.regexp_extract(cigar, side, 1).try_cast("int"), F.lit(0))

    head, tail = r"^(\d+)[SH]", r"(\d+)[SH]$"
    lead = clip("c1", tail) - clip("c1", head)          # > 0: this piece comes first
    lead = F.when(lead != 0, lead).otherwise(clip("cig2", head) - clip("cig2", tail))
    strand1 = F.when(R.flag_has(F.col("flag"), R.REVERSE), "-").otherwise("+")
    kind = (F.when(F.col("c2") != F.col("contig"), "BND").when(F.col("s2") != strand1, "INV")
            .when(lead > 0, F.when(F.col("p2") > F.col("pos"), "DEL").otherwise("DUP"))
            .when(lead < 0, F.when(F.col("p2") < F.col("pos"), "DEL").otherwise("DUP"))
            .when(F.col("p2") > F.col("pos") + read_len, "DEL").otherwise("DUP"))
    return x.select("qname", kind.alias("sv_type"), "contig", F.col("pos").alias("pos1"),
                    F.col("c2").alias("contig2"), F.col("p2").alias("pos2"), F.lit("split").alias("evidence"))


def ordered_ends(evidence: DataFrame) -> DataFrame:
    """Evidence with its smaller end (contig, then position) first, so both
    views of one breakpoint pair are the same."""
    swap = (F.col("contig") > F.col("contig2")) | ((F.col("contig") == F.col("contig2")) & (F.col("pos1") > F.col("pos2")))
    turned = {a: F.when(swap, F.col(b)).otherwise(F.col(a)) for a, b in (("contig", "contig2"), ("pos1", "pos2"), ("contig2", "contig"), ("pos2", "pos1"))}
    return evidence.select(*[turned.get(c, F.col(c)).alias(c) for c in evidence.columns])


KIND = ["sv_type", "contig", "contig2"]


def cluster_breakpoints(evidence: DataFrame, gap: int = CLUSTER_GAP) -> DataFrame:
    """``cluster`` of each piece of evidence: pieces of one type and pair of
    contigs are linked if both their ends are within ``gap``, and a cluster
    is what links reach.

    Points are counted into square cells of half a gap. All points of a cell
    and of touching cells are linked; cells one further apart are linked if
    their extremes are near, or, at a corner, the outermost points of either
    cell. So links arise between cells, never between all points, and the
    clusters are the components of the cells."""
    gap = max(1, gap)
    size = (gap + 1) // 2
    points = cut_lineage(evidence.select(*KIND, "pos1", "pos2").distinct()
                         .withColumns({"x": F.floor(F.col("pos1") / size), "y": F.floor(F.col("pos2") / size)}))
    # of each column of a cell the outermost points
    rows = points.groupBy(*KIND, "x", "y", "pos1").agg(F.min("pos2").alias("low"), F.max("pos2").alias("high"))
    cells = cut_lineage(rows.groupBy(*KIND, "x", "y").agg(
        F.min("pos1").alias("left"), F.max("pos1").alias("right"), F.min("low").alias("low"), F.max("high").alias("high"))
        .withColumn("id", F.concat_ws(":", *KIND, F.col("x").cast("string"), F.col("y").cast("string"))))
    steps = [(dx, dy) for dx in range(3) for dy in range(-2, 3) if dx > 0 or dy > 0]
    moves = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps]))
    a = cells.select(*KIND, F.col("id").alias("src"), F.col("right").alias("a_right"), F.col("low").alias("a_low"),
                     F.col("high").alias("a_high"), "x", "y", moves.alias("m"))
    a = a.select(*KIND, "src", "a_right", "a_low", "a_high", F.col("m.dx").alias("dx"), F.col("m.dy").alias("dy"),
                 (F.col("x") + F.col("m.dx")).alias("x"), (F.col("y") + F.col("m.dy")).alias("y"))
    near = a.join(cells.withColumnRenamed("id", "dst"), [*KIND, "x", "y"])
    across = (F.col("dx") < 2) | (F.col("left") - F.col("a_right") <= gap)
    along = (F.abs("dy") < 2) | F.when(F.col("dy") > 0, F.col("low") - F.col("a_high") <= gap).otherwise(F.col("a_low") - F.col("high") <= gap)
    near = near.where(across & along).select(*KIND, "src", "dst", "dx", "dy", "x", "y")
    corner = (F.col("dx") == 2) & (F.abs("dy") == 2)
    ours = rows.select(*KIND, F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("pos1").alias("a1"), F.col("low").alias("al"), F.col("high").alias("ah"))
    corners = (near.where(corner).withColumns({"ax": F.col("x") - F.col("dx"), "ay": F.col("y") - F.col("dy")})
               .join(ours, [*KIND, "ax", "ay"]).join(rows, [*KIND, "x", "y"])
               .where((F.col("pos1") - F.col("a1") <= gap)
                      & F.when(F.col("dy") > 0, F.col("low") - F.col("ah") <= gap).otherwise(F.col("al") - F.col("high") <= gap)))
    edges = near.where(~corner).select("src", "dst").unionByName(corners.select("src", "dst").distinct())
    edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    labels = connected_components(cells.select("id"), edges).withColumnRenamed("label", "cluster")
    found = cells.select(*KIND, "x", "y", "id").join(labels, "id").select(*KIND, "x", "y", "cluster")
    tagged = evidence.withColumns({"x": F.floor(F.col("pos1") / size), "y": F.floor(F.col("pos2") / size)})
    return tagged.join(found, [*KIND, "x", "y"]).drop("x", "y")


def structural_variants(pairs: DataFrame | None = None, split: DataFrame | None = None,
                        max_insert: int = MAX_INSERT, min_support: int = MIN_SUPPORT,
                        cluster_gap: int = CLUSTER_GAP) -> DataFrame:
    """Discordant-pair and split-read evidence (either optional, H2),
    ends put in one order, clustered by both ends together (see
    :func:`cluster_breakpoints`), calls with at least ``min_support`` pieces
    of evidence. Columns: sv_type, contig, contig2, start, end, support,
    n_discordant, n_split."""
    ev = evidence_union(discordant_evidence(pairs, max_insert) if pairs is not None else None,
                        split_evidence(split) if split is not None else None)
    ev = cluster_breakpoints(ordered_ends(ev), cluster_gap)
    calls = ev.groupBy(*KIND, "cluster").agg(
        F.min("pos1").alias("start"), F.max("pos2").alias("end"),
        F.count(F.lit(1)).alias("support"),
        F.sum(F.when(F.col("evidence") == "discordant", 1).otherwise(0)).cast("bigint").alias("n_discordant"),
        F.sum(F.when(F.col("evidence") == "split", 1).otherwise(0)).cast("bigint").alias("n_split"))
    return calls.where(F.col("support") >= min_support).drop("cluster")


def copy_number_profile(tumor: DataFrame, normal: DataFrame, targets: DataFrame | None = None,
                        bin_size: int = 1000, genome: DataFrame | None = None,
                        w: int = 5, threshold: float = 0.5) -> DataFrame:
    """Read counts per target (or per fixed bin when no targets),
    log2((t+1)/(n+1)) centred on its median (E8), optionally corrected by
    the median of its GC decile (genome needed), segmented by change points
    (E7); per segment the mean log2 and copy number (F12).
    Columns: contig, segment, start_pos, end_pos, n_bins, mean_log2, cn."""
    if targets is not None:
        t = target_coverage(tumor, targets).select("contig", "start_pos", "end_pos", F.col("n_reads").alias("t"))
        n = target_coverage(normal, targets).select("contig", "start_pos", "end_pos", F.col("n_reads").alias("n"))
        bins = t.join(n, ["contig", "start_pos", "end_pos"], "full").fillna(0, ["t", "n"])
        # targets are not on a grid: number them along each contig by start
        from ..operators.alignments import sort_alignments
        ranked = sort_alignments(bins.select("contig", F.col("start_pos").alias("pos"), "end_pos", "t", "n"),
                                 tie=["end_pos", "t", "n"])
        bins = ranked.select("contig", F.col("pos").alias("start_pos"), "end_pos", "t", "n",
                             (F.col("ordinal") - 1).alias("bin"))
    else:
        t = bin_coverage(tumor, bin_size).select("contig", "start_pos", "end_pos", F.col("n_reads").alias("t"))
        n = bin_coverage(normal, bin_size).select("contig", "start_pos", "end_pos", F.col("n_reads").alias("n"))
        bins = t.join(n, ["contig", "start_pos", "end_pos"], "full").fillna(0, ["t", "n"])
        bins = bins.withColumn("bin", F.floor(F.col("start_pos") / bin_size).cast("bigint"))
    x = bins.withColumn("log2", F.log2((F.col("t") + 1.0) / (F.col("n") + 1.0))).withColumn("_all", F.lit(0))
    x = median_center(x, "log2", ["_all"])
    if genome is not None:
        from .somatic import reference_bases
        x = reference_bases(x, genome, "start_pos", (F.col("end_pos") - F.col("start_pos")).cast("int"), "_gseq")
        x = x.withColumn("_dec", F.least(F.floor(gc_fraction(F.col("_gseq")) * 10), F.lit(9)).cast("int"))
        x = median_center(x, "log2", ["_dec"]).drop("_gseq", "_dec")
    x = cut_lineage(x.drop("_all"))
    seg = change_points(x.select("contig", "bin", "log2"), "log2", w, threshold)
    x = x.join(seg.select("contig", "bin", "segment"), ["contig", "bin"], "inner")
    out = x.groupBy("contig", "segment").agg(
        F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"),
        F.count(F.lit(1)).alias("n_bins"), F.round(F.avg("log2"), 4).alias("mean_log2"))
    return out.withColumn("cn", copy_number(F.col("mean_log2")))
