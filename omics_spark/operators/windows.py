"""Window-style operators that must not collapse onto one task: E2
Benjamini-Hochberg q-values, E6 local background means, E5 position
clustering, E7 change points, E8 median centring.

Each replaces a whole-partition window with per-key pre-aggregation plus
block carries (see ``blocks``) or equi-joins on a fixed grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import BLK, after, before, block_carry, in_block

_LIN = 1 << 20


def p_block(p: Column) -> Column:
    """Monotone block key for p in [0, 1]: linear steps of 2^-20 above
    2^-20, 1/64-octave steps below, 0 for p = 0 (so a pile of tiny
    p-values still spreads over many blocks)."""
    lin = F.lit(2 * _LIN) + F.floor(p * _LIN)
    small = F.floor((F.log2(p) + 1100.0) * 64.0)
    return (F.when(p <= 0, F.lit(0)).when(p >= 1.0 / _LIN, lin).otherwise(small)).cast("bigint")


def bh_qvalues(df: DataFrame, p: str = "p", partition: list[str] | None = None,
               out: str = "q") -> DataFrame:
    """Benjamini-Hochberg q = min over ranks >= r of p*m/rank, capped
    at 1, per ``partition`` (tied p-values share the q of their last rank).
    Rows with a null p stay, with a null q, and count as no test.

    Rows collapse to distinct (partition, p) with counts; cumulative counts
    (prefix sum) and the suffix minimum run in block passes, so neither a
    huge group nor a pile of equal p-values lands on one task."""
    keys = list(partition or [])
    if not keys:   # one global group: a constant key keeps every step a keyed join
        return bh_qvalues(df.withColumn("_all", F.lit(0)), p, ["_all"], out).drop("_all")
    # the distinct p-values feed the counts, both carries and the join back
    d = cut_lineage(df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("_c")))
    m = d.groupBy(*keys).agg(F.sum("_c").alias("_m"))
    d = d.withColumn(BLK, p_block(F.col(p)))
    c1 = block_carry(d, keys, {"n": F.sum("_c")}, {"c_n": F.sum("n").over(before(keys))})
    d = d.join(c1, keys + [BLK], "left")
    w = in_block(keys, [p]).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_r", F.coalesce(F.col("c_n"), F.lit(0)) + F.sum("_c").over(w))
    d = d.join(m, keys, "inner")
    d = d.withColumn("_v", F.col(p) * F.col("_m") / F.col("_r"))
    c2 = block_carry(d, keys, {"vmin": F.min("_v")}, {"c_min": F.min("vmin").over(after(keys))})
    d = d.join(c2, keys + [BLK], "left")
    suffix = F.min("_v").over(in_block(keys, [p]).rowsBetween(0, Window.unboundedFollowing))
    d = d.withColumn(out, F.least(F.lit(1.0), F.least(suffix, F.coalesce(F.col("c_min"), F.lit(float("inf"))))))
    return df.join(d.select(*keys, p, out), keys + [p], "left")


def dense_bins(counts: DataFrame, bin_col: str = "bin", value: str = "count",
               keys: list[str] | None = None) -> DataFrame:
    """Fill a per-contig bin grid 0..max(bin) with zeros where absent."""
    keys = keys or ["contig"]
    # in two steps, so that no row holds a contig's whole grid
    size = 1 << 16
    blocks = counts.groupBy(*keys).agg(F.max(bin_col).cast("bigint").alias("_mx")).withColumn(
        "_g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_mx") / size).cast("bigint"))))
    last = F.least(F.col("_mx"), (F.col("_g") + 1) * size - 1)
    grid = blocks.select(*keys, F.explode(F.sequence(F.col("_g") * size, last)).alias(bin_col))
    return grid.join(counts.select(*keys, bin_col, value), keys + [bin_col], "left") \
               .fillna(0, [value])


def prefix_sums(grid: DataFrame, bin_col: str = "bin", value: str = "count",
                keys: list[str] | None = None, width: int = 1 << 16) -> DataFrame:
    """Inclusive prefix sum ``_S`` of ``value`` along ``bin_col`` per key,
    in two block passes."""
    keys = keys or ["contig"]
    g = grid.withColumn(BLK, F.floor(F.col(bin_col) / width).cast("bigint"))
    c = block_carry(g, keys, {"s": F.sum(value)}, {"c_s": F.sum("s").over(before(keys))})
    g = g.join(c, keys + [BLK], "left")
    w = in_block(keys, [bin_col]).rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("_S", F.coalesce(F.col("c_s"), F.lit(0)) + F.sum(value).over(w)).drop(BLK, "c_s")


#: Bins of a contig that one task looks at together, and rows put into one Arrow batch.
BACKGROUND_BINS = 1 << 14
ROWS = 1 << 18


def local_background(counts: DataFrame, half_widths: list[int], bin_col: str = "bin",
                     value: str = "count", keys: list[str] | None = None, dense: bool = True,
                     width: int = BACKGROUND_BINS) -> DataFrame:
    """For each bin the mean ``value`` over bins within +-h (clipped to
    the contig's grid, 0 to its last bin), one column ``bg_<h>`` per half
    width (in bins). Bins without counts come out too, with 0, unless
    ``dense`` is off. One row of ``counts`` a (keys, bin).

    Only the counts are shuffled, once: to blocks of ``width`` bins, those
    near a block's edge to both sides of it. A task lays a block at a time
    out as an array; window sums are differences of its prefix sums."""
    keys = keys or ["contig"]
    reach = max(half_widths)
    c = counts.where(F.col(bin_col) >= 0).dropna(subset=keys)
    c = c.select(*keys, F.col(bin_col).cast("bigint").alias("_bin"), F.col(value).alias("_value"), F.lit(None).cast("bigint").alias("_mx"))
    near = F.sequence(F.floor(F.greatest(F.col("_bin") - reach, F.lit(0)) / width), F.floor((F.col("_bin") + reach) / width))
    last = c.groupBy(*keys).agg(F.max("_bin").alias("_mx"))
    # a row before the counts of each block tells where the grid ends
    heads = last.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_mx") / width))).alias(BLK),
                        F.lit(None).cast("bigint").alias("_bin"), F.lit(None).cast(c.schema["_value"].dataType).alias("_value"), "_mx")
    x = heads.unionByName(c.withColumn(BLK, F.explode(near))).repartition(*keys, BLK).sortWithinPartitions(*keys, BLK, "_bin")
    whole = counts.schema[value].dataType.typeName() in ("byte", "short", "integer", "long")
    names = [*keys, bin_col, value, *[f"bg_{h}" for h in half_widths]]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        kind = np.int64 if whole else np.float64

        def block(at, blk, mx, bins, values):
            """(row, bins, values, means) of the block that starts in row ``at``."""
            lo, hi = blk * width, min((blk + 1) * width - 1, mx)
            line = np.zeros(hi - lo + 1 + 2 * reach, kind)
            inside = bins <= hi + reach
            np.add.at(line, bins[inside] - lo + reach, values[inside])
            sums = np.concatenate(([0], np.cumsum(line)))
            places = np.arange(lo, hi + 1) if dense else np.unique(bins[(bins >= lo) & (bins <= hi)])
            e = places - lo + reach
            means = [(sums[e + h + 1] - sums[e - h]) / (np.minimum(places + h, mx) - np.maximum(places - h, 0) + 1) for h in half_widths]
            return at, places, line[e], means

        def flush(table, parts):
            rows = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
            ids = [table.column(k).take(pa.array(rows)) for k in keys]
            ids = [i.combine_chunks() if isinstance(i, pa.ChunkedArray) else i for i in ids]
            columns = [np.concatenate([p[n] for p in parts]) for n in (1, 2)]
            columns += [np.concatenate([p[3][n] for p in parts]) for n in range(len(half_widths))]
            return pa.RecordBatch.from_arrays([*ids, *map(pa.array, columns)], names=names)

        def blocks(table, starts, ends):
            parts, rows = [], 0
            blk, mx = (table.column(n).take(pa.array(starts)).to_pylist() for n in (BLK, "_mx"))
            bins = pc.fill_null(table.column("_bin"), -1).to_numpy()
            values = pc.fill_null(table.column("_value"), 0).to_numpy().astype(kind)
            for a, b, k, m in zip(starts, ends, blk, mx, strict=True):
                if m is None:       # beyond the last block
                    continue
                parts.append(block(a, k, m, bins[a + 1:b], values[a + 1:b]))
                rows += len(parts[-1][1])
                if rows >= ROWS:
                    yield flush(table, parts)
                    parts, rows = [], 0
            if parts:
                yield flush(table, parts)

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            new = np.zeros(table.num_rows, bool)
            for k in (*keys, BLK):
                one = table.column(k)
                new[1:] |= pc.not_equal(one.slice(1), one.slice(0, len(one) - 1)).to_numpy()
            new[0] = True
            starts = np.flatnonzero(new)
            yield from blocks(table, starts[:-1], starts[1:])
            held = table.slice(int(starts[-1]))
        if held is not None:
            yield from blocks(held, np.array([0]), np.array([held.num_rows]))

    kinds = [f"`{k}` {counts.schema[k].dataType.simpleString()}" for k in keys]
    kinds += [f"`{bin_col}` bigint", f"`{value}` {'bigint' if whole else 'double'}", *[f"`bg_{h}` double" for h in half_widths]]
    out = x.mapInArrow(run, ", ".join(kinds))
    return out.withColumn(value, F.col(value).cast(counts.schema[value].dataType))


def cluster_positions(df: DataFrame, pos: str = "pos", max_gap: int = 500,
                      keys: list[str] | None = None, width: int = 1 << 20) -> DataFrame:
    """E5: positions of the same key closer than ``max_gap`` to the previous
    one share a cluster; ``cluster`` = first position of the cluster.
    Distinct positions first, then a running max over position blocks."""
    keys = keys or ["contig"]
    d = df.select(*keys, pos).distinct()
    d = d.withColumn(BLK, F.floor(F.col(pos) / width).cast("bigint"))
    c = block_carry(d, keys, {"bmax": F.max(pos)}, {"c_prev": F.max("bmax").over(before(keys))})
    d = d.join(c, keys + [BLK], "left")
    w = in_block(keys, [pos])
    prev = F.coalesce(F.lag(pos).over(w), F.col("c_prev"))
    d = d.withColumn("_new", prev.isNull() | (F.col(pos) - prev > max_gap))
    d = d.withColumn("_cl", F.max(F.when(F.col("_new"), F.col(pos))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c2 = block_carry(d, keys, {"bcl": F.max(F.when(F.col("_new"), F.col(pos)))},
                     {"c_cl": F.max("bcl").over(before(keys))})
    d = d.join(c2, keys + [BLK], "left").withColumn("cluster", F.coalesce("_cl", "c_cl"))
    return df.join(d.select(*keys, pos, "cluster"), keys + [pos], "inner")


#: Equal steps that a range is cut into in one pass of :func:`group_medians`.
STEPS = 4096


def group_medians(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, ``_med``): the exact median of each group, of the two middle
    values the mean; nulls are left out.

    No group is gathered: values are counted in a histogram (1/64 octaves,
    then ``STEPS`` equal steps between the smallest and largest value of the
    step that holds a middle rank), for all groups at once, until every
    middle rank stands on one value. Rows outside the steps still open drop
    out, counts are combined before they are shuffled, and what is carried
    from pass to pass is two rows a group."""
    x = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    size = F.floor(F.log2(F.abs("_v")) * 64)
    octave = F.when(F.col("_v") > 0, size + 100_000).when(F.col("_v") < 0, -size - 100_000).otherwise(0).cast("bigint")

    def pick(steps: DataFrame) -> DataFrame:
        """The step of each (group, rank) that holds the rank."""
        w = Window.partitionBy(*by, "_which").orderBy("_lo").rowsBetween(Window.unboundedPreceding, -1)
        steps = steps.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        held = (F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n"))
        return steps.where(held).select(*by, "_which", (F.col("_rank") - F.col("_before")).alias("_rank"), "_lo", "_hi")

    summary = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    first = cut_lineage(x.groupBy(*by, octave.alias("_step")).agg(*summary))
    rank = F.explode(F.array(*[F.struct(F.lit(w).alias("_which"), F.floor((F.col("_all_n") - 1 + w) / 2).alias("_rank")) for w in (0, 1)]))
    ranks = first.groupBy(*by).agg(F.sum("_n").alias("_all_n")).select(*by, rank.alias("_t")).select(*by, "_t.*")
    state = cut_lineage(pick(first.join(ranks, by)))
    while not (open_ := state.where("_lo < _hi")).isEmpty():
        spans = open_.select(*by, "_which", "_rank", F.col("_lo").alias("_a"), F.col("_hi").alias("_b"))
        step = F.least(F.floor((F.col("_v") - F.col("_a")) / (F.col("_b") - F.col("_a")) * STEPS), F.lit(STEPS - 1))
        near = x.join(spans, by).where(F.col("_v").between(F.col("_a"), F.col("_b")))
        steps = near.groupBy(*by, "_which", "_rank", step.alias("_step")).agg(*summary)
        state = cut_lineage(pick(steps).unionByName(state.where("_lo = _hi")))
    low, high = F.min("_lo"), F.max("_lo")
    return state.groupBy(*by).agg((low + (high - low) * 0.5).alias("_med"))


def median_center(df: DataFrame, value: str, by: list[str], out: str | None = None) -> DataFrame:
    """Subtract the per-group median (exact, see :func:`group_medians`)
    and join it back; the median table has one row per group. The rows are
    read in every pass for the medians and once more here: written once."""
    out = out or value
    df = cut_lineage(df)
    return df.join(group_medians(df, value, by), by, "inner").withColumn(out, F.col(value) - F.col("_med")).drop("_med")


def change_points(bins: DataFrame, value: str = "log2", w: int = 5, threshold: float = 0.5,
                  keys: list[str] | None = None, bin_col: str = "bin") -> DataFrame:
    """t = mean of the next w bins minus mean of the previous w bins
    (dense bin grid, prefix sums looked up by equi-joins); a break is where
    |t| is above ``threshold`` and a local maximum among +-w neighbours;
    ``segment`` = number of breaks at or before the bin (prefix count)."""
    keys = keys or ["contig"]
    g = prefix_sums(dense_bins(bins, bin_col, value, keys).withColumn(value, F.col(value).cast("double")),
                    bin_col, value, keys)
    mx = g.groupBy(*keys).agg(F.max(bin_col).alias("_mx"))
    # the bin grid is bounded by genome size / bin size and is read by
    # several lookups below: checkpoint it once
    g = cut_lineage(g.join(mx, keys))
    look = g.select(*keys, F.col(bin_col).alias("_lb"), F.col("_S").alias("_ls"))

    def at(df: DataFrame, offset: int, name: str) -> DataFrame:
        lk = look.select(*[F.col(k).alias(f"_{name}_{k}") for k in keys],
                         F.col("_lb").alias(f"_{name}_b"), F.col("_ls").alias(name))
        cond = [df[k] == lk[f"_{name}_{k}"] for k in keys] + [(df[bin_col] + offset) == lk[f"_{name}_b"]]
        return df.join(lk, cond, "left").drop(*[f"_{name}_{k}" for k in keys], f"_{name}_b")

    g = at(g, -1, "_s_m1")
    g = at(g, -w - 1, "_s_mw")
    g = at(g, w - 1, "_s_pw")
    ok = (F.col(bin_col) >= w) & (F.col(bin_col) + w - 1 <= F.col("_mx"))
    left = (F.col("_s_m1") - F.coalesce(F.col("_s_mw"), F.lit(0.0))) / w
    right = (F.col("_s_pw") - F.col("_s_m1")) / w
    # nine decimals, so that rounding noise of the sums decides no tie
    g = cut_lineage(g.withColumn("t", F.when(ok, F.round(right - left, 9))))
    # local maximum of |t| among +-w neighbours: compare with neighbour values by joins on a grid
    tv = g.select(*keys, F.col(bin_col).alias("_nb"), F.abs("t").alias("_nt"))
    nb = g.select(*keys, bin_col, F.explode(F.sequence(F.lit(-w), F.lit(w))).alias("_o"))
    nb = nb.where(F.col("_o") != 0).withColumn("_nb", F.col(bin_col) + F.col("_o"))
    nmax = nb.join(tv, keys + ["_nb"], "inner").groupBy(*keys, bin_col).agg(F.max("_nt").alias("_nmax"))
    g = g.join(nmax, keys + [bin_col], "left")
    brk = (F.abs("t") > threshold) & (F.abs("t") > F.coalesce(F.col("_nmax"), F.lit(-1.0)))
    g = g.withColumn("is_break", F.coalesce(brk, F.lit(False)))
    g = g.withColumn("_bk", F.col("is_break").cast("int"))
    g = prefix_sums(g.drop("_S"), bin_col, "_bk", keys).withColumnRenamed("_S", "segment")
    return g.drop("_s_m1", "_s_mw", "_s_pw", "_nmax", "_mx", "_bk")
