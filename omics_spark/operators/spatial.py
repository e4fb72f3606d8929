"""3-D and image operators: B9 box filter, C9 neighbour join, D7 label
statistics, and connected components over a grid (used by P17 / P19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def box_filter(atoms: DataFrame, centre: tuple[Column | float, Column | float, Column | float],
               size: float | Column = 20.0) -> DataFrame:
    """Points inside centre +- size/2 on all three axes (plain
    predicates: pushed to the scan for stored atoms)."""
    half = (F.lit(size) if not isinstance(size, Column) else size) / 2
    cond = None
    for axis, c in zip(("x", "y", "z"), centre):
        c = F.lit(c) if not isinstance(c, Column) else c
        term = F.abs(F.col(axis) - c) <= half
        cond = term if cond is None else cond & term
    return atoms.where(cond)


def _cells(df: DataFrame, cutoff: float) -> DataFrame:
    return (df.withColumn("_cx", F.floor(F.col("x") / cutoff).cast("bigint"))
              .withColumn("_cy", F.floor(F.col("y") / cutoff).cast("bigint"))
              .withColumn("_cz", F.floor(F.col("z") / cutoff).cast("bigint")))


def neighbours_3d(a: DataFrame, b: DataFrame, cutoff: float, keys: list[str] | None = None,
                  a_prefix: str = "a_", b_prefix: str = "b_") -> DataFrame:
    """Pairs of points within ``cutoff`` (Euclidean). Space is cut into
    cubes of side ``cutoff``; side a is exploded to its 27 neighbouring
    cubes and equi-joined with b's cube (plus optional ``keys``), then the
    distance predicate is checked. Output: both sides' columns prefixed,
    and ``dist``."""
    keys = keys or []
    ax = _cells(a, cutoff)
    ax = ax.select(*[F.col(c).alias(a_prefix + c) for c in a.columns],
                   *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                   F.explode(F.array(*[F.array(F.lit(i), F.lit(j), F.lit(k))
                                       for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])).alias("_o"),
                   "_cx", "_cy", "_cz")
    ax = ax.select("*", (F.col("_cx") + F.col("_o")[0]).alias("_nx"), (F.col("_cy") + F.col("_o")[1]).alias("_ny"),
                   (F.col("_cz") + F.col("_o")[2]).alias("_nz")).drop("_o", "_cx", "_cy", "_cz")
    bx = _cells(b, cutoff)
    bx = bx.select(*[F.col(c).alias(b_prefix + c) for c in b.columns],
                   *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                   F.col("_cx").alias("_nx"), F.col("_cy").alias("_ny"), F.col("_cz").alias("_nz"))
    on = ["_nx", "_ny", "_nz", *(f"_k{i}" for i in range(len(keys)))]
    j = ax.join(bx, on, "inner")
    d2 = ((F.col(a_prefix + "x") - F.col(b_prefix + "x")) ** 2 + (F.col(a_prefix + "y") - F.col(b_prefix + "y")) ** 2
          + (F.col(a_prefix + "z") - F.col(b_prefix + "z")) ** 2)
    j = j.where(d2 <= cutoff * cutoff).withColumn("dist", F.sqrt(d2))
    return j.drop(*on)


def label_stats(labelled: DataFrame, image: str = "image_id", label: str = "label") -> DataFrame:
    """Per (image, label): area, centroid and mean value; ``cells`` =
    number of labels in the image (joined from a per-image count)."""
    z = F.col("z") if "z" in labelled.columns else F.lit(0)
    per = labelled.groupBy(image, label).agg(
        F.count(F.lit(1)).alias("area"), F.round(F.avg("x"), 4).alias("cx"), F.round(F.avg("y"), 4).alias("cy"),
        F.round(F.avg(z), 4).alias("cz"), F.round(F.avg("value"), 4).alias("mean_value"))
    cells = per.groupBy(image).agg(F.count(F.lit(1)).alias("cells"))
    return per.join(cells, image)


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Components of an undirected graph given as ``nodes`` (id, of any
    type with an order) and ``edges`` (src, dst both ways). Each round every
    node takes the smallest label among itself and its neighbours (written),
    then its label's label (pointer jumping, written with the flag that tells
    whether anything changed), so long chains collapse quickly. All tables go
    to the shared folder: lineage stays short and executor loss recomputes one
    step at most. Error if ``max_rounds`` is hit (never a partial answer).
    Returns (id, label)."""
    edges = cut_lineage(edges.select("src", "dst"))
    labels = nodes.select("id", F.col("id").alias("label"))
    for _ in range(max_rounds):
        nb = edges.join(labels.select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id")).agg(
            F.min("label").alias("nl"))
        cur = cut_lineage(labels.join(nb, "id", "left").select(
            "id", F.col("label").alias("old"), F.least("label", F.coalesce("nl", "label")).alias("label")))
        look = cur.select(F.col("id").alias("_i"), F.col("label").alias("_l2"))
        new = F.least("label", F.coalesce("_l2", "label"))
        step = cut_lineage(cur.join(look, F.col("label") == F.col("_i"), "left")
                           .select("id", new.alias("label"), (new != F.col("old")).alias("_chg")))
        labels = step.drop("_chg")
        if step.where("_chg").isEmpty():
            return labels
    raise RuntimeError(f"connected components did not converge in {max_rounds} rounds")


def grid_id(cells: DataFrame, image: str = "image_id") -> Column:
    """Node id for a grid cell: unique over ``cells`` (image, z, y, x).

    Coordinates below 2^14 and images below 2^21 are packed into fixed bits;
    otherwise the ranges that occur are measured (one aggregate) and packed
    tightly. Ranges that need over 63 bits, or images that are no integers,
    are an error, never a shared id."""
    axes = [(image, 1 << 21), ("z", 1 << 14), ("y", 1 << 14), ("x", 1 << 14)]
    r = cells.agg(*[f(F.col(c).cast("bigint")).alias(f"{k}_{i}") for i, (c, _) in enumerate(axes)
                    for k, f in (("low", F.min), ("high", F.max))]).first()
    low, width = [0] * 4, [w for _, w in axes]
    if any(r[f"low_{i}"] is not None and not 0 <= r[f"low_{i}"] <= r[f"high_{i}"] < width[i] for i in range(4)):
        low = [r[f"low_{i}"] for i in range(4)]
        width = [r[f"high_{i}"] - low[i] + 1 for i in range(4)]
    if width[0] * width[1] * width[2] * width[3] > 1 << 63:
        raise ValueError(f"cells span {width} images and grid steps: too many for one 63-bit id")
    out = F.lit(0).cast("bigint")
    for (c, _), lo, w in zip(axes, low, width):
        out = out * F.lit(w) + (F.col(c).cast("bigint") - F.lit(lo))
    return out


def grid_edges(cells: DataFrame, image: str = "image_id") -> DataFrame:
    """Face-neighbour edges (4 in 2-D, 6 in 3-D) between present cells,
    both directions, by equi-joins on the shifted coordinates."""
    base = cells.select(F.col(image).alias("_im"), "z", "y", "x", F.col("id"))
    out = None
    for dz, dy, dx in ((0, 0, 1), (0, 1, 0), (1, 0, 0)):
        moved = base.select("_im", (F.col("z") + dz).alias("z"), (F.col("y") + dy).alias("y"),
                            (F.col("x") + dx).alias("x"), F.col("id").alias("src"))
        e = moved.join(base.withColumnRenamed("id", "dst"), ["_im", "z", "y", "x"]).select("src", "dst")
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        out = both if out is None else out.unionByName(both)
    return out
