"""ChIP-seq: P8 call_peaks and P9 motif_enrichment.

call_peaks: tags extended to the fragment length -> treatment and control
counts per bin (one aggregation) -> local lambda = max(genome background,
1 kb and 10 kb control means (E6)) scaled to the treatment depth ->
Poisson upper tail on distinct (count, lambda) pairs only (F8) -> BH
q-values (E2) -> significant bins merged (E3) -> summit and narrowPeak
columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seq import gc_fraction
from ..functions.stats import effective_genome_size, hypergeom_upper, log10_poisson_upper
from ..operators.intervals import merge_intervals, restrict_to_intervals
from ..operators.kmers import kmer_counts
from ..operators.windows import bh_qvalues, local_background
from ..operators.topk import quota_sample, top_k
from ..operators.intervals import intersect_intervals
from ..session import cut_lineage


def extend_tags(tags: DataFrame, d: int) -> DataFrame:
    """5' ends -> fragments of length d in the read direction."""
    s = F.when(F.col("strand") == "-", F.col("start_pos") - d + 1).otherwise(F.col("start_pos"))
    return tags.withColumn("start_pos", F.greatest(s, F.lit(0)).cast("bigint")) \
               .withColumn("end_pos", F.col("start_pos") + d)


def call_peaks(treatment: DataFrame, control: DataFrame, genome_size: str = "hs",
               q_cutoff: float = 0.05, d: int = 200, bin_size: int = 50) -> DataFrame:
    """P8 (control required). narrowPeak-like columns: contig, start_pos,
    end_pos, name, score, strand, signal, p_value (-log10), q_value (-log10),
    peak (summit offset), plus summit count."""
    if control is None:
        raise ValueError("call_peaks needs a control sample")
    gsize = treatment.sparkSession.range(1).select(
        effective_genome_size(F.lit(genome_size)).alias("g")).first()["g"]
    if gsize is None:
        raise ValueError(f"bad genome size {genome_size!r}")
    t = extend_tags(treatment, d).withColumn("_t", F.lit(1)).withColumn("_c", F.lit(0))
    c = extend_tags(control, d).withColumn("_t", F.lit(0)).withColumn("_c", F.lit(1))
    cols = ["contig", "start_pos", "end_pos", "_t", "_c"]
    frags = cut_lineage(t.select(*cols).unionByName(c.select(*cols)))   # read twice
    lo = F.floor(F.col("start_pos") / bin_size)
    hi = F.floor((F.col("end_pos") - 1) / bin_size)
    binned = frags.withColumn("bin", F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint"))))
    # bin-level table (bounded by genome size / bin size), read several times
    # below: checkpointed once into the shared folder instead of recomputed
    counts = cut_lineage(binned.groupBy("contig", "bin").agg(F.sum("_t").cast("bigint").alias("t_count"),
                                                             F.sum("_c").cast("bigint").alias("c_count")))
    totals = frags.agg(F.sum("_t").alias("nt"), F.sum("_c").alias("nc")).first()
    nt, nc = float(totals["nt"] or 0), float(totals["nc"] or 0)
    ratio = nt / nc if nc else 1.0
    lam_bg = nt * d / gsize                       # expected fragments covering a base
    k1, k10 = 500 // bin_size, 5000 // bin_size   # +-500 bp and +-5 kb in bins
    bg = local_background(counts.select("contig", "bin", F.col("c_count").alias("count")), [k1, k10], dense=False)
    x = counts.join(bg.select("contig", "bin", F.col(f"bg_{k1}").alias("l1"), F.col(f"bg_{k10}").alias("l10")),
                    ["contig", "bin"], "left")
    lam = F.greatest(F.lit(lam_bg), F.coalesce(F.col("l1"), F.lit(0.0)) * ratio,
                     F.coalesce(F.col("l10"), F.lit(0.0)) * ratio)
    x = x.withColumn("lam", F.round(lam, 6)).where(F.col("t_count") > 0)
    pairs = x.select("t_count", "lam").distinct()        # p-values once per distinct pair
    pairs = pairs.withColumn("log10p", log10_poisson_upper(F.col("t_count"), F.col("lam")))
    x = x.join(pairs, ["t_count", "lam"], "inner").withColumn("p", F.pow(F.lit(10.0), F.col("log10p")))
    x = cut_lineage(bh_qvalues(cut_lineage(x), "p", None, "q"))
    sig = x.where(F.col("q") <= q_cutoff).select(
        "contig", (F.col("bin") * bin_size).alias("start_pos"), ((F.col("bin") + 1) * bin_size).alias("end_pos"),
        "t_count", "lam", "log10p", "q")
    peaks = merge_intervals(sig.select("contig", "start_pos", "end_pos"))
    # summit: the significant bin with the highest count in each merged peak
    tagged = intersect_intervals(sig, peaks.select("contig", F.col("start_pos"), F.col("end_pos")),
                                 bin_size=1 << 16, a_prefix="s_", b_prefix="p_")
    best = tagged.groupBy("contig", "p_start_pos", "p_end_pos").agg(
        F.max_by(F.struct("s_start_pos", "t_count", "lam", "log10p", "q"),
                 F.struct("t_count", (-F.col("s_start_pos")).alias("o"))).alias("b"))
    return best.select(
        "contig", F.col("p_start_pos").alias("start_pos"), F.col("p_end_pos").alias("end_pos"),
        F.concat(F.lit("peak_"), F.col("contig"), F.lit("_"), F.col("p_start_pos").cast("string")).alias("name"),
        F.least(F.lit(1000), F.round(-10 * F.log10(F.greatest(F.col("b.q"), F.lit(1e-300)))).cast("int")).alias("score"),
        F.lit(".").alias("strand"),
        F.round(F.col("b.t_count") / F.col("b.lam"), 3).alias("signal"),
        F.round(-F.col("b.log10p"), 3).alias("p_value"),
        F.round(-F.log10(F.greatest(F.col("b.q"), F.lit(1e-300))), 3).alias("q_value"),
        (F.col("b.s_start_pos") - F.col("p_start_pos") + bin_size // 2).alias("peak"),
        F.col("b.t_count").alias("summit_count"))


def peak_windows(peaks: DataFrame, genome: DataFrame, size: int = 200) -> DataFrame:
    """Genome letters of the ``size`` window centred on each peak, moved
    inside its contig (a shorter contig is its own window), via genome tiles:
    (contig, start_pos, end_pos, seq), each window once."""
    centre = F.floor((F.col("start_pos") + F.col("end_pos")) / 2)
    at = F.greatest(F.least(centre - size // 2, F.col("_len") - size), F.lit(0)).cast("bigint")
    return _letters(peaks.join(_lengths(genome), "contig").select("contig", at.alias("start_pos")).distinct(), genome, size)


def background_windows(peaks: DataFrame, genome: DataFrame, size: int = 200,
                       shifts: tuple[int, ...] = (-3000, -1500, 1500, 3000)) -> DataFrame:
    """The same windows moved by each of ``shifts``, those wholly inside
    their contig that overlap no peak (C3 anti join), each once."""
    centre = F.floor((F.col("start_pos") + F.col("end_pos")) / 2)
    moved = (peaks.join(_lengths(genome), "contig")
             .select("contig", "_len", F.explode(F.array(*[(centre - size // 2 + s).cast("bigint") for s in shifts])).alias("start_pos"))
             .where((F.col("start_pos") >= 0) & (F.col("start_pos") + size <= F.col("_len")))
             .select("contig", "start_pos").distinct().withColumn("end_pos", F.col("start_pos") + size))
    return _letters(restrict_to_intervals(moved, peaks, "anti").drop("end_pos"), genome, size)


def _lengths(genome: DataFrame) -> DataFrame:
    return genome.select("contig", F.length("seq").alias("_len"))


def _letters(windows: DataFrame, genome: DataFrame, size: int) -> DataFrame:
    from .somatic import reference_bases
    return (reference_bases(windows, genome, "start_pos", size, "seq")
            .withColumn("end_pos", F.col("start_pos") + F.length("seq")).select("contig", "start_pos", "end_pos", "seq"))


def gc_decile(seq: str = "seq") -> Column:
    return F.least(F.floor(gc_fraction(F.col(seq)) * 10), F.lit(9)).cast("int")


def motif_enrichment_in_peaks(peaks: DataFrame, genome: DataFrame, size: int = 200, k: int = 8, ratio: int = 2, top: int = 25,
                              shifts: tuple[int, ...] = (-3000, -1500, 1500, 3000)) -> DataFrame:
    """P9 from peaks (contig, start_pos, end_pos) and a genome (contig, seq):
    windows round the peaks against shifted windows that no peak overlaps,
    ``ratio`` of these for each target of the same GC decile (all, where there
    are fewer; taken by a hash, so the choice is repeatable). Columns as
    :func:`motif_enrichment`."""
    name = F.concat_ws(":", "contig", F.col("start_pos").cast("string"))
    targets = cut_lineage(peak_windows(peaks, genome, size).withColumns({"seq_id": name, "dec": gc_decile()}))
    quotas = targets.groupBy("dec").agg((F.count(F.lit(1)) * ratio).alias("quota"))
    pool = background_windows(peaks, genome, size, shifts).withColumns({"seq_id": name, "dec": gc_decile()})
    chosen = cut_lineage(quota_sample(pool, ["dec"], F.col("seq_id"), quotas))
    return motif_enrichment(targets, chosen, k, top=top, gc_match=False)


def motif_enrichment(targets: DataFrame, background: DataFrame, k: int = 8,
                     id_col: str = "seq_id", top: int = 25, gc_match: bool = True) -> DataFrame:
    """P9 core: canonical k-mers counted once per sequence (D6) in target
    and background sets; background restricted to the GC deciles seen in
    the targets; hypergeometric upper tail (F9) + BH (E2); top motifs by p.
    Columns: kmer, t_hits, b_hits, n_target, n_background, fold, p, q, rank."""
    t = targets.select(F.col(id_col).alias("sid"), F.upper("seq").alias("seq"))
    b = background.select(F.col(id_col).alias("sid"), F.upper("seq").alias("seq"))
    if gc_match:
        t = t.withColumn("_dec", gc_decile())
        t = cut_lineage(t)      # both sets are counted, and their k-mers too
        b = cut_lineage(b.withColumn("_dec", gc_decile()).join(t.select("_dec").distinct(), "_dec", "left_semi"))
    n_t = t.count()
    n_b = b.count()
    kt = kmer_counts(t, k, "sid", "seq", canonical=True).select("kmer", F.col("n_sequences").alias("t_hits"))
    kb = kmer_counts(b, k, "sid", "seq", canonical=True).select("kmer", F.col("n_sequences").alias("b_hits"))
    x = kt.join(kb, "kmer", "left").fillna(0, ["b_hits"])
    x = cut_lineage(x.withColumn("n_target", F.lit(n_t)).withColumn("n_background", F.lit(n_b)))
    # tails once per distinct pair of counts: few bytes and much work, so spread by number
    pairs = x.select("t_hits", "b_hits").distinct().repartition(4 * x.sparkSession.sparkContext.defaultParallelism)
    pairs = pairs.withColumn("p", hypergeom_upper(F.col("t_hits"), F.lit(n_t), F.col("t_hits") + F.col("b_hits"), F.lit(n_t + n_b)))
    x = x.join(cut_lineage(pairs), ["t_hits", "b_hits"]).select(*x.columns, "p")
    x = x.withColumn("fold", F.round((F.col("t_hits") / F.lit(max(n_t, 1)))
                                     / ((F.col("b_hits") + 1) / F.lit(max(n_b, 1) + 1)), 3))
    x = bh_qvalues(x, "p", None, "q")
    one = x.withColumn("_g", F.lit(0))          # a single ranking over all k-mers
    return top_k(one, ["_g"], [F.col("p"), F.col("kmer")], top, salt_cols=["kmer"]).drop("_g")
