"""Images and 3-D structures: P17 label_regions, G3 top_poses, A14
docking_manifest, P18 screen_poses, P19 pocket_points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.spatial import (box_filter, connected_components, grid_edges, grid_id, label_stats,
                                 neighbours_3d)
from ..operators.topk import top_k

# Van der Waals radii (angstrom) by element for the pose
# score; other elements use DEFAULT_RADIUS.
RADII = {"C": 1.9, "N": 1.8, "O": 1.7, "S": 2.0, "P": 2.1, "H": 1.1}
DEFAULT_RADIUS = 1.9
# Score weights: Gaussian steric attraction and overlap repulsion.
W_GAUSS, W_REPULSION, GAUSS_WIDTH = -0.0356, 0.84, 0.5
MANIFEST_COLUMNS = ["complex_name", "protein_path", "ligand_description", "protein_sequence"]


def radius(element: Column) -> Column:
    m = F.create_map(*[x for kv in RADII.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.try_element_at(m, F.upper(element)), F.lit(DEFAULT_RADIUS))


def label_regions(pixels: DataFrame, threshold: float = 0.15, diameter: float = 0.0,
                  image: str = "image_id") -> DataFrame:
    """Pixels above ``threshold`` -> face-neighbour edges (equi-joins)
    -> connected components for all images at once -> D7 per object.
    ``diameter`` > 0 keeps objects whose equivalent diameter lies within
    0.5x-2x of it; 0 keeps all (automatic size). Returns label_stats plus
    ``diameter``."""
    z = F.col("z") if "z" in pixels.columns else F.lit(0)
    fg = pixels.where(F.col("value") > threshold).withColumn("z", z.cast("int"))
    fg = fg.withColumn("id", grid_id(fg, image))
    comps = connected_components(fg.select("id"), grid_edges(fg, image))
    lab = fg.join(comps, "id").withColumnRenamed("label", "label")
    stats = label_stats(lab, image, "label")
    # each image is 2-D or 3-D by itself
    deep = lab.groupBy(image).agg(F.max(F.col("z") != 0).alias("_deep"))
    eq = F.when(F.col("_deep"), F.pow(6.0 * F.col("area") / math.pi, 1.0 / 3.0)) \
        .otherwise(2.0 * F.sqrt(F.col("area") / math.pi))
    stats = stats.join(deep, image).withColumn("diameter", F.round(eq, 4)).drop("_deep")
    if diameter and diameter > 0:
        stats = stats.where((F.col("diameter") >= 0.5 * diameter) & (F.col("diameter") <= 2.0 * diameter))
    return stats


def top_poses(scores: DataFrame, keys: list[str], score: str = "score", num_poses: int = 10,
              tie: list[str] | None = None) -> DataFrame:
    """Best ``num_poses`` poses per complex (lowest score first)."""
    tie = tie or []
    return top_k(scores, keys, [F.col(score)] + [F.col(t) for t in tie], num_poses)


def docking_manifest(receptors: DataFrame, ligands: DataFrame, on: str = "receptor_id",
                     path: str | None = None) -> DataFrame:
    """The docking input table with the reference's four columns,
    one row per (receptor, ligand) pair named by ``on`` (an equi-join, not
    a cross product). Receptors: on, protein_path, protein_sequence;
    ligands: on, ligand_id, smiles. Written as CSV with header if ``path``."""
    m = ligands.join(receptors, on, "inner").select(
        F.concat_ws("_", F.col(on).cast("string"), F.col("ligand_id").cast("string")).alias("complex_name"),
        "protein_path", F.col("smiles").alias("ligand_description"),
        F.coalesce(F.col("protein_sequence"), F.lit("")).alias("protein_sequence"))
    if path:
        m.write.mode("overwrite").option("header", True).csv(path)
    return m


def screen_poses(poses: DataFrame, receptor: DataFrame, centre: tuple | DataFrame, size: float = 20.0,
                 cutoff: float = 8.0, num_poses: int = 10, on: str | None = None) -> DataFrame:
    """Pose atoms inside the box (B9) -> receptor atoms within
    ``cutoff`` (C9) -> pair terms on the surface distance
    d = r - R_i - R_j: W_GAUSS*exp(-(d/0.5)^2) + W_REPULSION*d^2 (d < 0)
    summed per (ligand, pose) -> best ``num_poses`` per ligand (G3).
    Scores given poses; does not search. Poses: ligand, pose_id, atom_id,
    element, x, y, z; receptor: atom_id, element, x, y, z.

    ``on`` names a receptor's key in both tables: then each pose meets its
    own receptor only (an equi-join with the cell), ``centre`` may be a
    table (``on``, cx, cy, cz) of a box for each, and the best poses are those
    per (key, ligand)."""
    key = [on] if on else []
    if isinstance(centre, DataFrame):
        box = tuple(F.col(c) for c in ("cx", "cy", "cz"))
        poses, receptor = poses.join(centre, key), receptor.join(centre, key)
    else:
        box = centre
    inbox = box_filter(poses, box, size)
    rec = box_filter(receptor, box, size + 2 * cutoff)
    pairs = neighbours_3d(inbox.select(*key, "ligand", "pose_id", "atom_id", "element", "x", "y", "z"),
                          rec.select(*key, "atom_id", "element", "x", "y", "z"), cutoff, keys=key, a_prefix="l_", b_prefix="r_")
    d = F.col("dist") - radius(F.col("l_element")) - radius(F.col("r_element"))
    term = F.lit(W_GAUSS) * F.exp(-F.pow(d / GAUSS_WIDTH, 2)) + F.when(d < 0, F.lit(W_REPULSION) * d * d).otherwise(0.0)
    s = pairs.groupBy(*[F.col(f"l_{k}").alias(k) for k in key], F.col("l_ligand").alias("ligand"), F.col("l_pose_id").alias("pose_id")).agg(
        F.round(F.sum(term), 3).alias("score"), F.count(F.lit(1)).alias("contacts"))
    return top_poses(s, [*key, "ligand"], "score", num_poses, ["pose_id"])


def _scatter(atoms: DataFrame, bb: DataFrame, reach: Column, spacing: float, mol: str) -> DataFrame:
    """Grid cells (mol, ix, iy, iz) within ``reach`` of each atom (one row
    per atom and cell, inside the molecule's box), with the distance."""
    x = atoms.join(bb, mol).withColumn("_r", reach)
    for a in "xyz":
        lo = F.greatest(F.ceil((F.col(a) - F.col(f"lo_{a}") - F.col("_r")) / spacing), F.lit(0)).cast("int")
        hi = F.least(F.floor((F.col(a) - F.col(f"lo_{a}") + F.col("_r")) / spacing),
                     F.floor((F.col(f"hi_{a}") - F.col(f"lo_{a}")) / spacing)).cast("int")
        x = x.withColumn(f"i{a}", F.explode(F.sequence(lo, F.greatest(hi, lo - 1))))
    d2 = sum(((F.col(f"lo_{a}") + F.col(f"i{a}") * spacing) - F.col(a)) ** 2 for a in "xyz")
    return x.withColumn("_d", F.sqrt(d2)).select(mol, "ix", "iy", "iz", "_d", "_r")


def pocket_points(receptors: DataFrame, spacing: float = 1.0, probe: float = 1.4,
                  burial_radius: float = 8.0, min_burial: int = 20, mol: str = "mol_id") -> DataFrame:
    """Grid of ``spacing`` over each receptor's atom bounding box;
    points closer than (atom radius + probe) to an atom are clashes and
    dropped; burial = atoms within ``burial_radius``; points with burial
    of at least ``min_burial`` are clustered into pockets by grid
    adjacency (connected components) and ranked by size.

    Both counts are computed by scattering each atom onto the grid cells
    within its reach (``explode(sequence)`` per axis) and aggregating per
    cell, which is exact and touches only cells near atoms. Columns:
    mol_id, pocket, n_points, cx, cy, cz, mean_burial, rank."""
    bb = receptors.groupBy(mol).agg(*[F.min(a).alias(f"lo_{a}") for a in "xyz"],
                                    *[F.max(a).alias(f"hi_{a}") for a in "xyz"])
    atoms = receptors.select(mol, "element", "x", "y", "z")
    near = _scatter(atoms, bb, F.lit(burial_radius), spacing, mol)
    bur = near.where(F.col("_d") <= F.col("_r")).groupBy(mol, "ix", "iy", "iz").agg(
        F.count(F.lit(1)).alias("burial"))
    clash = _scatter(atoms, bb, radius(F.col("element")) + probe, spacing, mol) \
        .where(F.col("_d") < F.col("_r")).select(mol, "ix", "iy", "iz")
    pts = bur.where(F.col("burial") >= min_burial).join(clash, [mol, "ix", "iy", "iz"], "left_anti")
    pts = pts.join(bb, mol).select(mol, "ix", "iy", "iz", "burial",
                                   *[(F.col(f"lo_{a}") + F.col(f"i{a}") * spacing).alias(a) for a in "xyz"])
    # a cell is its own node id, so no two cells can share one
    pts = pts.withColumn("id", F.struct(F.col(mol).alias("m"), "ix", "iy", "iz"))
    cells = pts.select(F.col(mol).alias("image_id"), F.col("iz").alias("z"), F.col("iy").alias("y"),
                       F.col("ix").alias("x"), "id")
    comps = connected_components(pts.select("id"), grid_edges(cells, "image_id"))
    lab = pts.join(comps, "id")
    first_cell = F.concat_ws("_", "label.ix", "label.iy", "label.iz").alias("pocket")
    pockets = lab.groupBy(mol, first_cell).agg(
        F.count(F.lit(1)).alias("n_points"), F.round(F.avg("x"), 3).alias("cx"), F.round(F.avg("y"), 3).alias("cy"),
        F.round(F.avg("z"), 3).alias("cz"), F.round(F.avg("burial"), 3).alias("mean_burial"))
    by_size = Window.partitionBy(mol).orderBy(F.col("n_points").desc(), "pocket")   # pockets of one receptor: few
    return pockets.withColumn("rank", F.row_number().over(by_size))
