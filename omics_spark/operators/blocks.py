"""Ordered scans that do not put a whole contig (or any hot key) in one task.

A running aggregate "over (partition by contig order by pos)" is the usual
way to write gaps-and-islands, coverage and ordinal queries, but it sends
each contig to one task. Instead:

1. Rows are first collapsed to one row per (contig, position) with the
   aggregate the scan needs (max end, net depth change, row count), so a
   hot locus becomes one row, combined map-side.
2. Each position gets a block ``_blk = floor(pos / width)``: a pure function
   of the row, so every branch of the plan agrees on it (no dependence on
   sampling or partition ids) and a block holds at most ``width`` rows.
3. A per-(contig, block) summary is small - about genome length / width
   rows - and a window over it gives each block the carry-in from earlier
   blocks. It is joined back by (contig, block); AQE broadcasts it once it
   has measured it.
4. The row-level window runs per (contig, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BLK = "_blk"
DEFAULT_WIDTH = 1 << 20


def pos_blocks(df: DataFrame, pos: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Tag rows with ``_blk = floor(pos / width)``."""
    return df.withColumn(BLK, F.floor(F.col(pos) / F.lit(width)).cast("bigint"))


def block_carry(blocks: DataFrame, keys: list[str], aggs: dict[str, Column],
                carries: dict[str, Column]) -> DataFrame:
    """Summarise each (keys, block) with ``aggs`` then compute ``carries``
    (window expressions over :func:`before` / :func:`after`)."""
    summary = blocks.groupBy(*keys, BLK).agg(*[e.alias(k) for k, e in aggs.items()])
    for name, expr in carries.items():
        summary = summary.withColumn(name, expr)
    return summary.select(*keys, BLK, *carries.keys())


def before(keys: list[str]) -> Window:
    """Frame: all earlier blocks of the same key."""
    return (Window.partitionBy(*keys).orderBy(BLK)
            .rowsBetween(Window.unboundedPreceding, -1))


def after(keys: list[str]) -> Window:
    """Frame: all later blocks of the same key."""
    return (Window.partitionBy(*keys).orderBy(BLK)
            .rowsBetween(1, Window.unboundedFollowing))


def in_block(keys: list[str], order: list[str]) -> Window:
    """Row-level window inside one block of one key."""
    return Window.partitionBy(*keys, BLK).orderBy(*order)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """Adds ``name``: a row's place, from 1, among the rows of its ``keys``
    in ``order`` (columns; rows equal in all of them in any order).

    Rows are dealt out by ranges of (keys, order) and sorted, so neither a
    large key nor a crowded place of the order is one task's, and written.
    A row's place is its place in its partition, less the first one of its
    key there, plus what the partitions before hold of the key: a table of
    one row for each (partition, key)."""
    x = cut_lineage(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
                    .withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33).alias("_part")
    held = x.groupBy(*keys, part).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_held"))
    earlier = F.sum("_held").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select(*keys, "_part", (F.coalesce(earlier, F.lit(0)) - F.col("_first") + 1).alias("_add"))
    return (x.withColumn("_part", F.shiftright("_mid", 33)).join(held, [*keys, "_part"])
            .withColumn(name, (F.col("_mid") + F.col("_add")).cast("bigint")).drop("_part", "_mid", "_add"))
