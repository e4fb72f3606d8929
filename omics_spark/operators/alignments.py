"""Alignment (read) operators: B6 view, D1 flagstat, D2 coverage, D3 pileup,
G1 global sort, C7 mate pairing, A13 indexed layout.

Reads carry SAM columns: contig, pos (1-based), flag, mapq, cigar and
optionally rnext, pnext, seq, qual, qname.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import reads as R
from ..session import checkpoint_dir
from .blocks import numbered
from .intervals import bin_of, explode_bins, intersect_intervals

_REGION = re.compile(r"^([^:]+)(?::([\d,]+)(?:-([\d,]+))?)?$")


def parse_region(region: str) -> tuple[str, int, int | None]:
    """'chr1:1,001-2,000' (1-based inclusive) -> ('chr1', 1000, 2000) 0-based half-open."""
    m = _REGION.match(region.strip())
    if not m:
        raise ValueError(f"bad region {region!r}")
    contig, s, e = m.group(1), m.group(2), m.group(3)
    start = int(s.replace(",", "")) - 1 if s else 0
    end = int(e.replace(",", "")) if e else None
    return contig, start, end


def ref_span(pos: str = "pos", cigar: str = "cigar") -> tuple[Column, Column]:
    """0-based half-open reference span of an alignment."""
    s = F.col(pos) - 1
    return s, s + F.greatest(R.cigar_ref_len(F.col(cigar)), F.lit(1).cast("bigint"))


def view_alignments(reads: DataFrame, require: int = 0, exclude: int = 0,
                    min_mapq: int = 0, region: str | None = None) -> DataFrame:
    """Records with all ``require`` bits, none of ``exclude``, MAPQ at
    least ``min_mapq`` and (optionally) overlapping ``region``. Plain
    predicates: pushed to the scan for stored reads."""
    f = F.col("flag")
    cond = (f.bitwiseAND(F.lit(require)) == F.lit(require)) & (f.bitwiseAND(F.lit(exclude)) == 0)
    if min_mapq:
        cond &= F.col("mapq") >= min_mapq
    if region:
        contig, start, end = parse_region(region)
        s, e = ref_span()
        cond &= (F.col("contig") == contig) & (e > start)
        if end is not None:
            cond &= s < end
    return reads.where(cond)


def flagstat(reads: DataFrame) -> DataFrame:
    """One global row of flag counts (samtools flagstat categories).
    One aggregate; Spark does partial sums per task then one tiny merge."""
    f = F.col("flag")

    def has(bit: int) -> Column:
        return R.flag_has(f, bit)

    def cnt(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0)).cast("bigint")

    primary = ~has(R.SECONDARY) & ~has(R.SUPPLEMENTARY)
    paired = primary & has(R.PAIRED)
    mapped = ~has(R.UNMAPPED)
    both = paired & mapped & ~has(R.MATE_UNMAPPED)
    rnext = F.col("rnext") if "rnext" in reads.columns else F.lit(None).cast("string")
    other = both & rnext.isNotNull() & (rnext != "=") & (rnext != F.col("contig"))
    return reads.agg(
        F.count(F.lit(1)).alias("total"),
        cnt(primary).alias("primary"),
        cnt(has(R.SECONDARY)).alias("secondary"),
        cnt(has(R.SUPPLEMENTARY)).alias("supplementary"),
        cnt(has(R.DUPLICATE)).alias("duplicates"),
        cnt(mapped).alias("mapped"),
        cnt(primary & mapped).alias("primary_mapped"),
        cnt(paired).alias("paired"),
        cnt(paired & has(R.READ1)).alias("read1"),
        cnt(paired & has(R.READ2)).alias("read2"),
        cnt(paired & has(R.PROPER) & mapped).alias("properly_paired"),
        cnt(both).alias("both_mapped"),
        cnt(paired & mapped & has(R.MATE_UNMAPPED)).alias("singletons"),
        cnt(other).alias("mate_other_contig"),
        cnt(other & (F.col("mapq") >= 5)).alias("mate_other_contig_q5"),
    )


def aligned_blocks(reads: DataFrame) -> DataFrame:
    """One row per aligned (M/=/X) block: reference [start_pos, end_pos)
    and the offset of its first base in the read (``read_off``)."""
    x = reads.withColumn("_blk_", F.explode(R.cigar_blocks(F.col("cigar"))))
    return (x.withColumn("start_pos", F.col("pos") - 1 + F.col("_blk_.ref_off"))
             .withColumn("end_pos", F.col("start_pos") + F.col("_blk_.len"))
             .withColumn("read_off", F.col("_blk_.read_off"))
             .drop("_blk_"))


def _counted(reads: DataFrame) -> DataFrame:
    f = F.col("flag")
    return reads.where(R.flag_lacks(f, R.UNMAPPED) & R.flag_lacks(f, R.SECONDARY)
                       & R.flag_lacks(f, R.SUPPLEMENTARY))


def bin_coverage(reads: DataFrame, bin_size: int = 1000) -> DataFrame:
    """Per (contig, bin): reads whose reference span touches the bin
    (once per read) and aligned bases inside it. Mapped primary reads.

    The CIGAR is taken apart once a read; one aggregation (one shuffle,
    combined map-side)."""
    r = _counted(reads).select("contig", "pos", R.cigar_blocks(F.col("cigar")).alias("_bl"),
                               F.greatest(R.cigar_ref_len(F.col("cigar")), F.lit(1).cast("bigint")).alias("_len"))
    first, last = (F.col("pos") - 1), (F.col("pos") - 2 + F.col("_len"))
    lo = bin_of(first, bin_size)

    def inside(b: Column) -> Column:
        """Aligned bases of the read in bin ``b``."""
        return F.aggregate("_bl", F.lit(0).cast("bigint"), lambda acc, x: acc + F.greatest(
            F.lit(0), F.least(F.col("pos") - 1 + x["ref_off"] + x["len"], (b + 1) * bin_size)
            - F.greatest(F.col("pos") - 1 + x["ref_off"], b * bin_size)))

    # a read gives each bin that its span touches one row, with its bases there
    x = r.select("contig", F.explode(F.transform(F.sequence(lo, bin_of(last, bin_size)), lambda b: F.struct(b.alias("bin"), inside(b).alias("bases")))).alias("_x"))
    return (x.groupBy("contig", F.col("_x.bin").alias("_bin"))
            .agg(F.count(F.lit(1)).alias("n_reads"), F.sum("_x.bases").cast("bigint").alias("bases"))
            .select("contig", (F.col("_bin") * bin_size).alias("start_pos"),
                    ((F.col("_bin") + 1) * bin_size).alias("end_pos"), "n_reads", "bases"))


def target_coverage(reads: DataFrame, targets: DataFrame, key: str = "region_id") -> DataFrame:
    """D2 on targets: reads overlapping each target and aligned bases in it.
    Targets without reads come out with zeros."""
    r = _counted(reads)
    s, e = ref_span()
    t = targets.select("contig", "start_pos", "end_pos", key)
    span_hits = intersect_intervals(r.select("contig", s.alias("start_pos"), e.alias("end_pos")), t) \
        .select(key, F.lit(1).alias("r"), F.lit(0).cast("bigint").alias("b"))
    block_hits = intersect_intervals(aligned_blocks(r).select("contig", "start_pos", "end_pos"), t) \
        .select(key, F.lit(0).alias("r"), (F.col("end_pos") - F.col("start_pos")).cast("bigint").alias("b"))
    sums = (span_hits.unionByName(block_hits).groupBy(key)
            .agg(F.sum("r").cast("bigint").alias("n_reads"), F.sum("b").cast("bigint").alias("bases")))
    return (t.join(sums, key, "left")
            .select("contig", "start_pos", "end_pos", key,
                    F.coalesce("n_reads", F.lit(0).cast("bigint")).alias("n_reads"),
                    F.coalesce("bases", F.lit(0).cast("bigint")).alias("bases")))


def sort_alignments(reads: DataFrame, contig_order: DataFrame | None = None,
                    tie: list[str] | None = None) -> DataFrame:
    """G1: global order by (contig rank, pos), unplaced reads last, with a
    1-based ``ordinal`` inside each contig (ties by the ``tie`` columns).

    ``contig_order`` (contig, rank) gives the header order; by default
    contigs sort by name. Ordinals come from a range shuffle (see
    :func:`blocks.numbered`): neither a contig, a deep position nor all
    unplaced reads are gathered into one task. The final ``orderBy`` is a
    range shuffle too.
    """
    tie = tie or [c for c in reads.columns if c not in ("contig", "pos")]
    x = reads.withColumn("contig", F.coalesce(F.col("contig"), F.lit("*")))
    unplaced = F.col("contig") == "*"
    if contig_order is not None:
        x = x.join(contig_order.select("contig", F.col("rank").cast("bigint").alias("_rank")),
                   "contig", "left")
    else:
        x = x.withColumn("_rank", F.lit(0).cast("bigint"))
    big = F.lit(1 << 62).cast("bigint")
    x = x.withColumn("_rank", F.when(unplaced, big).otherwise(F.coalesce("_rank", big - 1)))
    return numbered(x, ["_rank", "contig"], ["pos", *tie]).orderBy("_rank", "contig", "ordinal").drop("_rank")


def mate_join(reads: DataFrame, name: str = "qname") -> DataFrame:
    """First and second read of each template side by side, by one
    ``groupBy(qname)`` with conditional ``max_by`` (no self-join). Columns
    ``r1_*`` / ``r2_*``; a missing mate gives nulls."""
    f = F.col("flag")
    cols = [c for c in reads.columns if c != name]
    is1 = R.flag_has(f, R.READ1) | R.flag_lacks(f, R.PAIRED)
    is2 = R.flag_has(f, R.READ2)
    prim = R.flag_lacks(f, R.SECONDARY) & R.flag_lacks(f, R.SUPPLEMENTARY)
    rec = F.struct(*[F.col(c) for c in cols])
    g = reads.where(prim).groupBy(name).agg(
        F.max_by(F.when(is1, rec), F.when(is1, F.lit(1))).alias("_r1"),
        F.max_by(F.when(is2, rec), F.when(is2, F.lit(1))).alias("_r2"))
    return g.select(name, *[F.col(f"_r1.{c}").alias(f"r1_{c}") for c in cols],
                    *[F.col(f"_r2.{c}").alias(f"r2_{c}") for c in cols])


#: A level's bins are this many times as wide as those of the level below.
FAN = 8
LEVELS = 12
#: Reads that a folder holds on average at least, if its contig has as many.
FOLDER_READS = 10_000
#: Contigs whose folder is named as they are, and read as text.
_PLAIN = re.compile(r"(?!(NaN|Infinity)$)[A-Za-z_][A-Za-z_0-9.]*")


def write_indexed(reads: DataFrame, path: str, bin_size: int = 1_000_000) -> str:
    """Parquet laid out by contig and by one bin a read, so region reads
    prune folders (the role of a BAM index). Bins come in levels, each FAN
    times as wide as the one below; a read goes into the narrowest bin that
    holds all of its span. So however far reads span, there are no more
    folders than bins of the genome and an eighth on top. A contig with few
    reads for its bins begins at a higher level, so many small contigs give
    about a folder each, not one for each of their bins."""
    s, e = ref_span()
    sizes = reads.groupBy("contig").agg(F.count(F.lit(1)).alias("_n"), F.max(e).alias("_end"))
    wide = [F.when(F.col("_n") * float(bin_size * FAN ** v) >= F.col("_end") * float(FOLDER_READS), F.lit(v)) for v in range(LEVELS)]
    sizes = sizes.select("contig", F.coalesce(*wide, F.lit(0)).alias("_base"))
    fits = [F.floor(s / (bin_size * FAN ** v)) == F.floor((e - 1) / (bin_size * FAN ** v)) for v in range(LEVELS)]
    level = F.greatest(F.coalesce(*[F.when(f, F.lit(v)) for v, f in enumerate(fits)], F.lit(LEVELS)), F.col("_base"))
    width = F.pow(F.lit(float(FAN)), F.col("level")) * bin_size
    at = F.when(F.col("level") == LEVELS, F.lit(0)).otherwise(F.floor(s / width)).cast("bigint")
    placed = reads.join(sizes, "contig", "left").withColumn("level", level).drop("_base")
    (placed.select(*[c for c in reads.columns if c != "level"], "level").withColumn("bin", at)
          .repartition("contig", "level", "bin")
          .write.mode("overwrite").partitionBy("contig", "level", "bin").parquet(path))
    return path


def read_region(spark: SparkSession, path: str, region: str, bin_size: int = 1_000_000) -> DataFrame:
    """Reads overlapping ``region`` from a :func:`write_indexed` layout
    of the same ``bin_size``: on each level only the bins that the region
    touches are scanned. Only the contig's own folders are listed."""
    contig, start, end = parse_region(region)
    own = f"{path.rstrip('/')}/contig={contig}"
    try:
        df = spark.read.option("basePath", path).parquet(own if _PLAIN.fullmatch(contig) else path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.read.parquet(path)    # a contig without reads
    asked = F.col("level") == LEVELS
    for v in range(LEVELS):
        width = bin_size * FAN ** v
        bins = F.col("bin") >= start // width
        if end is not None:
            bins &= F.col("bin") <= (end - 1) // width
        asked |= (F.col("level") == v) & bins
    df = df.where((F.col("contig") == contig) & asked)
    s, e = ref_span()
    df = df.where(e > start)
    if end is not None:
        df = df.where(s < end)
    return df.drop("level", "bin")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Letters of a contig whose reads :func:`by_place` deals out together.
PLACE = 1 << 14


def by_place(reads: DataFrame) -> DataFrame:
    """``reads`` dealt out by the place they start at, so that reads over one
    locus meet in few tasks and their letters are combined there, before they
    are shuffled. Large parts are cut by Spark, so no place is one task's."""
    return reads.withColumn("_place", bin_of(F.col("pos"), PLACE)).hint("rebalance", "contig", "_place").drop("_place")


def pileup(reads: DataFrame, placed: bool = False) -> DataFrame:
    """One row per aligned read base: contig, pos0 (0-based), base, bq,
    strand (+/-) and sample if present. Mapped primary non-duplicate reads,
    dealt out by :func:`by_place` unless they are ``placed`` already."""
    x = _letters(reads, [c for c in ("sample",) if c in reads.columns], placed)
    return x.select(*[c for c in ("sample",) if c in reads.columns], "contig", "pos0", F.col("_x.b").alias("base"), (F.ascii("_x.q") - 33).alias("bq"),
                    F.when(F.col("_rev"), "-").otherwise("+").alias("strand"))


def _letters(reads: DataFrame, keep: list[str], placed: bool) -> DataFrame:
    """One row per aligned read base: pos0 and ``_x`` (letter b, quality
    letter q). The letters of an aligned block are taken apart at once."""
    r = _counted(reads).where(R.flag_lacks(F.col("flag"), R.DUPLICATE))
    if not placed:
        used = [c for c in (*keep, "contig", "pos", "flag", "cigar", "seq", "qual") if c in r.columns]
        r = by_place(r.select(*used))
    b = aligned_blocks(r)
    at, n = (F.col("read_off") + 1).cast("int"), (F.col("end_pos") - F.col("start_pos")).cast("int")
    qual = F.col("qual") if "qual" in reads.columns else F.lit(None).cast("string")

    def letters(c: Column) -> Column:
        return F.split(F.substring(c, at, n), "")

    pairs = F.arrays_zip(letters(F.col("seq")).alias("b"), F.coalesce(letters(qual), F.array().cast("array<string>")).alias("q"))
    b = b.select(*keep, "contig", "start_pos", R.flag_has(F.col("flag"), R.REVERSE).alias("_rev"), F.posexplode(pairs).alias("_i", "_x"))
    return b.withColumn("pos0", F.col("start_pos") + F.col("_i"))


def pileup_counts(reads: DataFrame) -> DataFrame:
    """D3: per (sample, contig, pos0, base, strand): depth and mean base
    quality. Partial aggregation keeps a deep locus from piling into one
    task's memory."""
    p = pileup(reads)
    keys = [c for c in ("sample",) if c in p.columns] + ["contig", "pos0", "base", "strand"]
    return p.groupBy(*keys).agg(F.count(F.lit(1)).alias("depth"),
                                F.round(F.avg("bq"), 4).alias("mean_bq"))
