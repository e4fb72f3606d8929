"""Shards of near equal bytes by k-d tree partitioning, in DataFrame operations.

Units are groups of equal texts. A node of the tree is split at the weighted
median of its widest dimension (weights: bytes) until it is one shard. All
nodes of a level are split together: a unit carries the number of its node, and
ranges, histograms and cuts are small tables with a row for each node, joined
by that number. A plan is as large for a hundred thousand shards as for eight,
and the driver sees only whether a level is done.

Each dimension is scaled to 0..1 over the table. A unit's position in it is a
long: the scaled value above, 31 bits of a hash of the unit below, so that
units of equal value (one source may hold a third of all rows) are split by
hash rather than kept in one leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import gapless_rank, salts_for, written

BUCKETS = 4096
#: Values of a dimension and hash bits in a position.
VALUES, HASH_BITS = 1 << 30, 31
#: A median may leave this share of its node on the wrong side.
TOLERANCE = 1e-5
#: Tables of a level's nodes are broadcast up to so many rows.
FEW = 1 << 17


def _fraction(col: Column) -> Column:
    """A categorical value as a number; nulls are a value of their own."""
    return F.pmod(F.xxhash64(col), F.lit(1 << 20)).cast("double")


def dimensions(docs: DataFrame) -> dict[str, Column]:
    """Metadata dimensions of ``documents``; missing columns are left out."""
    found = {"bytes": F.log(F.col("size").cast("double"))}
    if "source" in docs.columns:
        found["source"] = _fraction(F.col("source"))
    if "lang" in docs.columns:
        found["lang"] = _fraction(F.col("lang"))
    found["id"] = F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))
    return found


def _by_node(units: DataFrame, nodes: DataFrame, shards: int, how: str = "inner") -> DataFrame:
    """``units`` with the columns of their node; ``nodes`` has a row for each
    node of a level, so at most ``shards``."""
    return units.join(F.broadcast(nodes) if shards <= FEW else nodes, "low", how)


def medians(wide: DataFrame, shards: int) -> DataFrame:
    """(low, middle, dim, cut): for each node of ``wide`` (units with low,
    high, weight, ``widths`` scaled to 0..1 and ``places``) its widest
    dimension, the first of equals, and the place in it below which nearest to
    the weight of the shards before the middle one lies. Histograms of all
    nodes narrow in on the cuts together."""
    n = len(wide.select(F.col("widths.*")).columns)
    spread = F.array(*[F.max(f"widths.w{d}") - F.min(f"widths.w{d}") for d in range(n)])
    nodes = wide.groupBy("low", "high").agg(spread.alias("spread"), F.sum("weight").alias("total"))
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("long")
    target = F.col("total") * (F.col("middle") - F.col("low")) / (F.col("high") - F.col("low"))
    state = (nodes.withColumn("middle", middle)
             .select("low", "middle", (F.array_position("spread", F.array_max("spread")) - 1).cast("int").alias("dim"), target.alias("target"),
                     F.lit(0).cast("long").alias("a"), F.lit(VALUES << HASH_BITS).cast("long").alias("b"), F.lit(0).cast("long").alias("below"),
                     F.lit(None).cast("long").alias("cut")))
    state = written(state)
    while not (open_ := state.where("cut is null")).isEmpty():
        open_ = open_.withColumn("step", F.greatest(F.lit(1), F.floor((F.col("b") - F.col("a") + BUCKETS - 1) / BUCKETS)).cast("long"))
        at = _by_node(wide.select("low", "weight", "places"), open_.select("low", "dim", "a", "b", "step"), shards)
        at = at.withColumn("place", F.get("places", F.col("dim"))).where((F.col("place") >= F.col("a")) & (F.col("place") < F.col("b")))
        held = at.groupBy("low", F.floor((F.col("place") - F.col("a")) / F.col("step")).alias("bucket")).agg(F.sum("weight").alias("w"))
        upto = F.sum("w").over(Window.partitionBy("low").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        found = (held.withColumn("upto", upto).join(open_, "low").withColumn("upto", F.col("upto") + F.col("below"))
                 .where((F.col("upto") >= F.col("target")) & (F.col("upto") - F.col("w") < F.col("target"))))
        start = F.col("a") + F.col("bucket") * F.col("step")
        end = F.least(F.col("b"), start + F.col("step"))
        over, under = F.col("upto") - F.col("target"), F.col("target") - F.col("upto") + F.col("w")
        done = (F.col("step") == 1) | (F.col("w") <= TOLERANCE * F.col("target"))
        found = found.select("low", "middle", "dim", "target", start.alias("a"), end.alias("b"), (F.col("upto") - F.col("w")).alias("below"),
                             F.when(done, F.when(over <= under, end).otherwise(start)).alias("cut"))
        state = written(state.where("cut is not null").unionByName(found))
    return state.select("low", "middle", "dim", "cut")


def partition(units: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """``units`` (weight, unit hash ``h``, one double column for each
    dimension, other columns) with ``shard`` (0 .. shards - 1). Each level is
    written, so a lost task repeats one level at most."""
    others = [c for c in units.columns if c not in (*dims, "h")]
    ranges = units.agg(*[f(d).alias(f"{k}_{d}") for d in dims for k, f in (("low", F.min), ("high", F.max))]).first()
    if ranges[f"low_{dims[0]}"] is None:
        return units.select(*others, F.lit(0).alias("shard"))
    scaled = []
    for d in dims:
        low, width = ranges[f"low_{d}"], ranges[f"high_{d}"] - ranges[f"low_{d}"]
        scaled.append((F.col(d) - F.lit(low)) / F.lit(width) if width else F.lit(0.0))
    tie = F.pmod(F.xxhash64("h", F.lit(8)), F.lit(1 << HASH_BITS))
    at = units.select(*others, F.struct(*[c.alias(f"w{i}") for i, c in enumerate(scaled)]).alias("widths"),
                      F.array(*[F.floor(c * (VALUES - 1)) * F.lit(1 << HASH_BITS) + tie for c in scaled]).alias("places"),
                      F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("high"))
    at, most = written(at), shards
    while most > 1:
        cuts = medians(at.where("high - low > 1"), shards)
        left = F.get("places", F.col("dim")) < F.col("cut")
        moved = _by_node(at, cuts, shards, "left").withColumns({
            "low": F.when(F.col("cut").isNull() | left, F.col("low")).otherwise(F.col("middle")),
            "high": F.when(F.col("cut").isNull() | ~left, F.col("high")).otherwise(F.col("middle"))})
        at, most = written(moved.drop("middle", "dim", "cut")), -(-most // 2)
    return at.select(*others, F.col("low").cast("int").alias("shard"))


def shard(docs: DataFrame, shards: int = 8, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    Law ``bytes``: shards hold near equal bytes. With ``target_bytes`` the
    tree grows until leaves have that size. Equal texts stay in one shard, but a
    group of over a 32nd of a shard's bytes (copies may be a third of
    all rows) is cut into parts by id hash. A null text has size 1 and checksum
    0, like an empty one. Null ids, sources and languages are values like any
    other; repeated rows each get a slot. An empty table gives no rows.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"),
                       F.xxhash64("text").alias("text_hash"), *[F.col(c) for c in ("source", "lang") if c in docs.columns])
    dims = dimensions(read)
    rows = written(read.select("doc_id", "size", "text_crc32", "text_hash", *[c.alias(f"dim_{n}") for n, c in dims.items()]))
    names = [f"dim_{n}" for n in dims]
    total, n_rows = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    if target_bytes:
        shards = max(1, -(-(total or 0) // target_bytes))
    limit = max(1, (total or 0) // (shards * 32))
    # At most 32 groups a shard can be over the limit.
    hot = (rows.groupBy("text_hash").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > limit)
           .select("text_hash", F.ceil(F.col("bytes") / limit).alias("parts")))
    part = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0))
    rows = rows.join(F.broadcast(hot) if 32 * shards <= FEW else hot, "text_hash", "left").withColumn("part", part).drop("parts")
    units = written(rows.groupBy("text_hash", "part").agg(F.sum("size").alias("weight"), *[F.min(n).alias(n) for n in names])
                    .withColumn("h", F.xxhash64("text_hash", "part")))
    of_unit = partition(units, names, shards).select("text_hash", "part", "shard")
    placed = rows.drop(*names).join(of_unit, ["text_hash", "part"])
    slots = gapless_rank(placed, ["shard"], F.xxhash64("doc_id", "text_hash"), ["doc_id", "text_hash"], "slot", salts_for(n_rows or 0, least=32))
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"),
                        F.lit(None).cast("int").alias("grown_shard"))
