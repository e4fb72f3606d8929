"""Genomic interval operators.

Intervals are rows with ``contig``, ``start_pos``, ``end_pos`` (0-based,
half-open). Overlap is ``a.start < b.end and b.start < a.end``; book-ended
intervals do not overlap.

Range joins are rewritten as equi-joins on (contig, bin): each interval is
exploded into the fixed-size bins it touches and the overlap predicate is
checked inside the bin. A pair is kept only in the bin holding the start of
the overlap, so it comes out once. The bin size follows the data (a high
percentile of interval length) when asked (``bin_size="auto"``), else
DEFAULT_BIN. Spark then picks sort-merge or
shuffle-hash per bin key; AQE splits skewed bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import BLK, DEFAULT_WIDTH, after, before, block_carry, in_block, pos_blocks

COORDS = ("contig", "start_pos", "end_pos")
MIN_BIN, MAX_BIN = 64, 1 << 22
# Default bin: a few times a read / peak length, small against genes. An
# interval of length L lands in L/4096 + 1 bins, so long features cost
# rows linearly and no broadcast is needed. ``bin_size="auto"`` measures
# the inputs instead (one extra pass over each side).
DEFAULT_BIN = 4096


def _bin_size(bin_size, *dfs: DataFrame) -> int:
    if bin_size == "auto":
        return auto_bin(*dfs)
    return int(bin_size or DEFAULT_BIN)


def auto_bin(*dfs: DataFrame, q: float = 0.95) -> int:
    """Bin size from the data: the q-quantile of interval length (one small
    aggregate per side), clamped to [MIN_BIN, MAX_BIN]."""
    best = MIN_BIN
    for df in dfs:
        row = df.agg(F.percentile_approx(F.col("end_pos") - F.col("start_pos"), q, 1000)
                     .alias("p")).first()
        if row is not None and row["p"] is not None:
            best = max(best, int(row["p"]))
    return int(min(MAX_BIN, best))


def bin_of(pos: Column, size: int) -> Column:
    return F.floor(pos / F.lit(size)).cast("bigint")


def explode_bins(df: DataFrame, size: int, start: str = "start_pos",
                 end: str = "end_pos", name: str = "_bin") -> DataFrame:
    """One row per bin touched by [start, end)."""
    last = F.greatest(F.col(end) - 1, F.col(start))
    return df.withColumn(name, F.explode(F.sequence(bin_of(F.col(start), size),
                                                    bin_of(last, size))))


def _prefixed(df: DataFrame, prefix: str, taken: set[str]) -> DataFrame:
    out = []
    for c in df.columns:
        if c == "contig":
            out.append(F.col(c))
        elif c in ("start_pos", "end_pos") or c in taken:
            out.append(F.col(c).alias(prefix + c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def intersect_intervals(a: DataFrame, b: DataFrame, bin_size: int | str | None = None,
                        a_prefix: str = "a_", b_prefix: str = "b_") -> DataFrame:
    """One row per overlapping (a, b) pair.

    Output: contig, start_pos/end_pos = the overlap, a's and b's coordinates
    as ``a_start_pos`` ... and all other columns of both sides (b's columns
    that clash with a's get ``b_``).
    """
    size = _bin_size(bin_size, a, b)
    a2 = _prefixed(a, a_prefix, set())
    b2 = _prefixed(b, b_prefix, set(a.columns) - set(COORDS))
    as_, ae = a_prefix + "start_pos", a_prefix + "end_pos"
    bs, be = b_prefix + "start_pos", b_prefix + "end_pos"
    ax = explode_bins(a2, size, as_, ae).alias("_a")
    bx = explode_bins(b2, size, bs, be).alias("_b")
    cond = ((F.col("_a.contig") == F.col("_b.contig")) & (F.col("_a._bin") == F.col("_b._bin"))
            & (F.col(f"_a.{as_}") < F.col(f"_b.{be}")) & (F.col(f"_b.{bs}") < F.col(f"_a.{ae}"))
            & (F.col("_a._bin") == bin_of(F.greatest(F.col(f"_a.{as_}"), F.col(f"_b.{bs}")), size)))
    j = ax.join(bx, cond, "inner")
    payload_a = [F.col(f"_a.{c}") for c in a2.columns if c != "contig"]
    payload_b = [F.col(f"_b.{c}") for c in b2.columns if c != "contig"]
    return j.select(
        F.col("_a.contig").alias("contig"),
        F.greatest(F.col(f"_a.{as_}"), F.col(f"_b.{bs}")).alias("start_pos"),
        F.least(F.col(f"_a.{ae}"), F.col(f"_b.{be}")).alias("end_pos"),
        *payload_a, *payload_b)


def _with_span(df: DataFrame, start: Column | None, end: Column | None) -> DataFrame:
    s = start if start is not None else F.col("start_pos")
    e = end if end is not None else F.col("end_pos")
    return df.withColumn("_s", s).withColumn("_e", e)


def restrict_to_intervals(df: DataFrame, regions: DataFrame, how: str = "semi",
                          start: Column | None = None, end: Column | None = None,
                          bin_size: int | str | None = None) -> DataFrame:
    """Rows of ``df`` overlapping any region (``how='semi'``) or none
    (``how='anti'``), each row at most once. ``start``/``end`` give the row's
    0-based half-open span (default its start_pos/end_pos).

    Rows inside one bin (almost all) take a plain binned semi/anti join;
    of rows spanning several bins the distinct spans are exploded, tested
    and joined back, so no row needs an id.
    """
    assert how in ("semi", "anti")
    x = _with_span(df, start, end)
    r = regions.select("contig", F.col("start_pos").alias("_rs"), F.col("end_pos").alias("_re"))
    size = _bin_size(bin_size, r.select("contig", F.col("_rs").alias("start_pos"),
                                        F.col("_re").alias("end_pos")))
    rx = explode_bins(r, size, "_rs", "_re")
    one = bin_of(F.col("_s"), size) == bin_of(F.greatest(F.col("_e") - 1, F.col("_s")), size)

    def overlap(left: DataFrame) -> Column:
        return ((left["contig"] == rx["contig"]) & (left["_bin"] == rx["_bin"])
                & (left["_s"] < rx["_re"]) & (rx["_rs"] < left["_e"]))

    single = x.where(one).withColumn("_bin", bin_of(F.col("_s"), size))
    out_single = single.join(rx, overlap(single), "left_semi" if how == "semi" else "left_anti")

    multi = x.where(~one)
    span = ["contig", "_s", "_e"]
    mx = explode_bins(multi.select(*span).distinct(), size, "_s", "_e")
    hit = mx.join(rx, overlap(mx), "left_semi").select(*span).distinct()
    out_multi = multi.join(hit, span, "left_semi" if how == "semi" else "left_anti")
    cols = df.columns
    return out_single.select(*cols).unionByName(out_multi.select(*cols))


def island_starts(df: DataFrame, gap: int = 0, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Distinct (contig, start_pos) of ``df`` with ``_e`` (max end), ``_n``
    (rows) and ``_island``: the first start of its gaps-and-islands group
    (overlapping, book-ended or closer than ``gap``).

    Rows sharing a start are collapsed first (map-side), then a running max
    of ends in two block passes (see ``blocks``): a start opens an island
    when it lies beyond every earlier end (+gap) of the contig.
    """
    keys = ["contig"]
    # the collapsed table feeds the row pass and both carries: written once
    # to the shared folder instead of re-scanned and re-shuffled per branch
    s = cut_lineage(df.groupBy("contig", "start_pos").agg(F.max("end_pos").alias("_e"),
                                                          F.count(F.lit(1)).alias("_n")))
    b = pos_blocks(s, "start_pos", width)
    c1 = block_carry(b, keys, {"bmax": F.max("_e")}, {"c_end": F.max("bmax").over(before(keys))})
    w = in_block(keys, ["start_pos"])
    y = b.join(c1, keys + [BLK], "left")
    prev_end = F.greatest(F.col("c_end"),
                          F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    y = y.withColumn("_new", prev_end.isNull() | (F.col("start_pos") > prev_end + F.lit(gap)))
    y = y.withColumn("_isl", F.max(F.when(F.col("_new"), F.col("start_pos")))
                     .over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c2 = block_carry(y, keys, {"bstart": F.max(F.when(F.col("_new"), F.col("start_pos")))},
                     {"c_isl": F.max("bstart").over(before(keys))})
    y = y.join(c2, keys + [BLK], "left").withColumn("_island", F.coalesce("_isl", "c_isl"))
    return y.select("contig", "start_pos", "_e", "_n", "_island")


def island_members(df: DataFrame, gap: int = 0, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Each row of ``df`` tagged with ``_island`` (see :func:`island_starts`),
    joined back on (contig, start_pos); AQE splits a hot start if needed."""
    isl = island_starts(df, gap, width).select("contig", "start_pos", "_island")
    return df.join(isl, ["contig", "start_pos"], "inner")


def merge_intervals(df: DataFrame, gap: int = 0, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Union of overlapping or book-ended intervals (or closer than
    ``gap``) per contig: contig, start_pos, end_pos, n_members."""
    y = island_starts(df, gap, width)
    return (y.groupBy("contig", "_island")
            .agg(F.min("start_pos").alias("start_pos"), F.max("_e").alias("end_pos"),
                 F.sum("_n").cast("bigint").alias("n_members"))
            .drop("_island"))


def complement_intervals(df: DataFrame, contig_lengths: DataFrame | None = None,
                         width: int = DEFAULT_WIDTH) -> DataFrame:
    """Uncovered gaps [prev_end, next_start) per contig, from 0. With
    ``contig_lengths`` (contig, length) also the tail gap and empty contigs."""
    m = cut_lineage(merge_intervals(df, width=width).select(*COORDS))
    keys = ["contig"]
    b = pos_blocks(m, "start_pos", width)
    c = block_carry(b, keys, {"bmax": F.max("end_pos")},
                    {"c_end": F.max("bmax").over(before(keys))})
    w = in_block(keys, ["start_pos"])
    y = b.join(c, keys + [BLK], "left")
    prev = F.coalesce(F.lag("end_pos").over(w), F.col("c_end"), F.lit(0).cast("bigint"))
    gaps = (y.withColumn("_p", prev)
            .where(F.col("start_pos") > F.col("_p"))
            .select("contig", F.col("_p").alias("start_pos"), F.col("start_pos").alias("end_pos")))
    if contig_lengths is None:
        return gaps
    last = m.groupBy("contig").agg(F.max("end_pos").alias("_last"))
    lens = contig_lengths.select("contig", F.col("length").cast("bigint").alias("_len"))
    tails = (lens.join(last, "contig", "left")
             .select("contig", F.coalesce("_last", F.lit(0).cast("bigint")).alias("start_pos"),
                     F.col("_len").alias("end_pos"))
             .where(F.col("end_pos") > F.col("start_pos")))
    return gaps.unionByName(tails)


def subtract_intervals(a: DataFrame, b: DataFrame, bin_size: int | None = None) -> DataFrame:
    """The parts of each A row not covered by any B interval (strand
    ignored). A row is cut into pieces; wholly covered rows vanish; rows on
    contigs without B come out unchanged (their complement is the whole
    contig, up to the largest A end).

    subtract(A, B) = intersect(A, complement(B)): the complement of B is a
    property of B alone, so no per-A-row window is needed.
    """
    a_max = a.groupBy("contig").agg((F.max("end_pos") + 1).alias("length"))
    gaps = complement_intervals(b, a_max)
    pieces = intersect_intervals(a, gaps, bin_size=bin_size, a_prefix="_a_", b_prefix="_g_")
    return pieces.select(*a.columns)


def depth_segments(df: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Runs of constant coverage depth > 0 (bedGraph): contig,
    start_pos, end_pos, depth.

    +1/-1 events are pre-aggregated per position (hot loci collapse
    map-side), then a running sum over position in two block passes.
    """
    ev = cut_lineage(
        df.select("contig", F.col("start_pos").alias("pos"), F.lit(1).alias("d"))
          .unionByName(df.select("contig", F.col("end_pos").alias("pos"), F.lit(-1).alias("d")))
          .groupBy("contig", "pos").agg(F.sum("d").alias("d"))
          .where(F.col("d") != 0))
    keys = ["contig"]
    b = pos_blocks(ev, "pos", width)
    c = block_carry(b, keys, {"bsum": F.sum("d"), "bmin": F.min("pos")},
                    {"c_sum": F.sum("bsum").over(before(keys)),
                     "c_next": F.min("bmin").over(after(keys))})
    w = in_block(keys, ["pos"])
    y = b.join(c, keys + [BLK], "left")
    depth = F.coalesce(F.col("c_sum"), F.lit(0)) + F.sum("d").over(
        w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.coalesce(F.lead("pos").over(w), F.col("c_next"))
    return (y.select("contig", F.col("pos").alias("start_pos"), nxt.alias("end_pos"),
                     depth.cast("bigint").alias("depth"))
            .where((F.col("depth") > 0) & F.col("end_pos").isNotNull()))


#: Hits of one island (what overlaps links) that one task chooses from.
ISLAND = 100_000


def _choose(groups: int, given: int):
    """The greedy choice over rows in order of their group (the first
    ``groups`` columns) and rank: of each the ``given`` columns that follow, if
    it is taken. The last ones are a hash of what ranks a row, of equal ones
    the first is left, and its spans: one, and a second over the origin of a
    circle. A span without an end takes no room."""
    from bisect import bisect_left, insort

    import pyarrow as pa

    def chosen(batches):
        taken: list[tuple] = []
        now = last = None

        def free(s, e):
            at = bisect_left(taken, (s, e))
            return not any(s < b and a < e for a, b in taken[max(0, at - 1):at + 1])

        for batch in batches:
            keep = []
            columns = [c.to_pylist() for c in batch.columns[groups + given:]]
            for group, rank, s1, e1, s2, e2 in zip(zip(*(c.to_pylist() for c in batch.columns[:groups])), *columns, strict=True):
                if group != now:
                    now, last = group, None
                    taken.clear()
                ok = (rank, s1, e1) != last
                last = rank, s1, e1
                if ok and e1 is not None:
                    if ok := free(s1, e1) and (s2 is None or free(s2, e2)):
                        insort(taken, (s1, e1))
                        if s2 is not None:
                            insort(taken, (s2, e2))
                keep.append(ok)
            yield batch.select(list(range(groups, groups + given))).filter(pa.array(keep, pa.bool_()))
    return chosen


def greedy_nonoverlap(hits: DataFrame, score: str = "score", tie: list[str] | None = None,
                      bin_size: int | str | None = "auto", max_rounds: int = 10_000, island: int = ISLAND,
                      circle: str | None = None) -> DataFrame:
    """Hits taken from the best score down, each if it overlaps none
    taken before (book-ended hits do not overlap). ``tie`` columns
    (ascending), then the coordinates, break score ties; of hits equal in all
    of these one is kept. ``circle`` names the length of a hit's circular
    contig: it starts inside it and, if it ends beyond, goes on from 0.

    Hits are written once; those of a contig of up to ``island`` hits are
    shuffled and sorted once and chosen from in one task, so a chain of hits
    with falling scores takes no rounds. Those of larger contigs are cut into
    islands that no overlap links, and up to ``island`` hits of one are chosen
    from in the same way. Of larger islands, rounds take
    hits that are the best of every bin they touch (no better hit overlaps
    them; the best hit left is always among them), drop what overlaps them
    and cut what is left into islands again. The best of a bin is an
    aggregate, and no pairs of hits arise but those with a hit taken."""
    tie = tie or []
    names = hits.columns
    order = F.struct((-F.col(score)).alias("s"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(tie)],
                     F.col("start_pos").alias("a"), F.col("end_pos").alias("b"))
    start, end = F.col("start_pos").cast("bigint"), F.col("end_pos").cast("bigint")
    one = F.array(F.struct(start.alias("s"), end.alias("e")))
    if circle is None:
        spans = one
    else:
        length = F.col(circle).cast("bigint")
        spans = F.when(end <= length, one).otherwise(F.array(
            F.struct(start.alias("s"), length.alias("e")), F.struct(F.lit(0).cast("bigint").alias("s"), F.least(end - length, length).alias("e"))))
    hits = cut_lineage(hits)
    crowded = cut_lineage(hits.groupBy("contig").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > island).select("contig"))
    none = crowded.isEmpty()
    few = hits if none else hits.join(crowded, "contig", "left_anti")
    few = few.where("contig is not null and start_pos is not null").withColumns({"_s": spans, "_group": F.col("contig")})
    flat = [F.get("_s", i)[x].alias(f"_{x}{i}") for i in (0, 1) for x in "se"]
    rank = [-F.col(score), *[F.col(c) for c in dict.fromkeys([*tie, "start_pos", "end_pos", *names])]]
    small = (few.repartition("contig").sortWithinPartitions("contig", *rank)
             .select("_group", *names, F.xxhash64(*rank[:1], *tie, "start_pos", "end_pos"), *flat)
             .mapInArrow(_choose(1, len(names)), hits.schema))
    if none:
        return small
    kept = [small]
    # of hits equal in all of the order one is left
    left = cut_lineage(hits.join(crowded, "contig", "left_semi").withColumns({"_k": order, "_spans": spans}).groupBy("contig", "_k")
                       .agg(F.min(F.struct(*names, "_spans")).alias("_h")).select("_k", "_h.*"))
    size = _bin_size(bin_size, left)
    by = ["s", *[f"t{i}" for i in range(len(tie))], "a", "b"]
    for _ in range(max_rounds):
        pieces = left.select("contig", "_k", F.explode("_spans").alias("_p")).select(
            "contig", "_k", F.col("_p.s").alias("start_pos"), F.col("_p.e").alias("end_pos"))
        members = island_members(pieces, gap=0).groupBy("contig", "_k").agg(F.min("_island").alias("_island"), F.max("_island").alias("_other"))
        if circle is not None:   # what lies at the end of a circle is linked to what lies at its start
            joined = members.where("_other > _island").groupBy("contig", F.col("_other").alias("_island")).agg(F.min("_island").alias("_to"))
            members = members.drop("_other").join(joined, ["contig", "_island"], "left").withColumn("_island", F.coalesce("_to", "_island"))
        members = cut_lineage(members.select("contig", "_k", "_island"))
        sizes = members.groupBy("contig", "_island").agg(F.count(F.lit(1)).alias("_n"))
        tagged = cut_lineage(left.join(members.join(sizes, ["contig", "_island"]), ["contig", "_k"]))
        # a hit alone in its island is taken; the others stream by, island by island
        alone = tagged.where("_n = 1")
        some = tagged.where((F.col("_n") > 1) & (F.col("_n") <= island)).select("contig", "_island", "_spans", F.struct("contig", "_k").alias("_row"), "_k.*")
        kind = some.schema["_row"].dataType.simpleString()
        taken = (some.repartition("contig", "_island").sortWithinPartitions("contig", "_island", *by)
                 .select("contig", "_island", "_row", F.xxhash64(*by), *[F.get("_spans", i)[x].alias(f"_{x}{i}") for i in (0, 1) for x in "se"])
                 .mapInArrow(_choose(2, 1), f"_row {kind}").select("_row.*"))
        chosen = tagged.join(taken, ["contig", "_k"], "left_semi").unionByName(alone)
        kept.append(cut_lineage(chosen.select(*names)))
        left = tagged.where(F.col("_n") > island).drop("_n", "_island")
        if left.isEmpty():
            break
        e = explode_bins(left.withColumn("_p", F.explode("_spans")).withColumns({"_a": F.col("_p.s"), "_b": F.col("_p.e")}), size, "_a", "_b")
        top = e.groupBy("contig", "_bin").agg(F.min("_k").alias("_top"))
        best = cut_lineage(e.join(top, ["contig", "_bin"]).groupBy("contig", "_k")
                           .agg(F.every(F.col("_k") == F.col("_top")).alias("_all"),
                                F.min(F.struct(*names, "_spans")).alias("_h")).where("_all"))
        kept.append(best.select("_h.*").select(*names))
        span = explode_bins(best.select("contig", F.explode("_h._spans").alias("_p"), F.col("_k").alias("_hk"))
                            .select("contig", "_hk", F.col("_p.s").alias("_hs"), F.col("_p.e").alias("_he")), size, "_hs", "_he")
        gone = (e.join(span, ["contig", "_bin"])
                .where(((F.col("_a") < F.col("_he")) & (F.col("_hs") < F.col("_b"))) | (F.col("_k") == F.col("_hk")))
                .select("contig", "_k").distinct())
        left = cut_lineage(left.join(gone, ["contig", "_k"], "left_anti"))
        if left.isEmpty():
            break
    else:
        raise RuntimeError(f"hits did not settle in {max_rounds} rounds")
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out
