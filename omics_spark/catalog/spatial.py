"""Registered queries: 3-D structures and images (B9, C9, G3, A14, D7,
P17, P18, P19, U3)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.validate import smiles_check
from ..operators.pipe import batch_predict
from ..operators.spatial import box_filter, label_stats, neighbours_3d
from ..plans.structures import docking_manifest, label_regions, pocket_points, screen_poses, top_poses
from ..sources.fixtures import duck_with, view
from . import register


@register("box_filter", duck_with("atoms") + """,
c as (select mol_id, avg(x) as cx, avg(y) as cy, avg(z) as cz from atoms group by mol_id)
select a.* from atoms a join c on c.mol_id = a.mol_id
where abs(a.x - c.cx) <= 15 and abs(a.y - c.cy) <= 15 and abs(a.z - c.cz) <= 15""")
def q_box(spark, sf):
    a = view(spark, sf, "atoms")
    c = a.groupBy("mol_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))
    return box_filter(a.join(c, "mol_id"), (F.col("cx"), F.col("cy"), F.col("cz")), 30.0).drop("cx", "cy", "cz")


@register("neighbours_3d", duck_with("atoms") + """
select a.mol_id, a.atom_id as a_atom_id, b.atom_id as b_atom_id,
  round(sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.z - b.z) ^ 2), 4) as dist
from atoms a join atoms b on a.mol_id = b.mol_id and a.atom_id < b.atom_id
where (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.z - b.z) ^ 2 <= 64""")
def q_neighbours(spark, sf):
    a = view(spark, sf, "atoms").select("mol_id", "atom_id", "x", "y", "z")
    p = neighbours_3d(a, a, 8.0, keys=["mol_id"])
    return p.where(F.col("a_atom_id") < F.col("b_atom_id")).select(
        F.col("a_mol_id").alias("mol_id"), "a_atom_id", "b_atom_id", F.round("dist", 4).alias("dist"))


@register("top_poses", duck_with("atoms") + """
select mol_id, atom_id, score, cast(rank as int) as rank from (select mol_id, atom_id, round(x + y + z, 4) as score,
  row_number() over (partition by mol_id order by round(x + y + z, 4), atom_id) as rank from atoms) t where rank <= 10""")
def q_top_poses(spark, sf):
    s = view(spark, sf, "atoms").select("mol_id", "atom_id", F.round(F.col("x") + F.col("y") + F.col("z"), 4).alias("score"))
    return top_poses(s, ["mol_id"], "score", 10, ["atom_id"])


@register("docking_manifest", duck_with("atoms", "smiles_like") + """
select cast(p_partkey % 10 as varchar) || '_' || cast(p_partkey as varchar) as complex_name,
  '/receptors/' || cast(r.mol_id as varchar) || '.pdb' as protein_path,
  trim(smiles, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) as ligand_description, '' as protein_sequence
from smiles_like s join (select distinct mol_id from atoms) r on r.mol_id = s.p_partkey % 10
where length(trim(smiles, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) > 0
  and regexp_full_match(trim(smiles, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)), '[A-Za-z0-9@+\\-\\[\\]\\(\\)\\\\/%=#$.,~!:]+')""")
def q_manifest(spark, sf):
    rec = view(spark, sf, "atoms").select(F.col("mol_id").alias("receptor_id")).distinct().select(
        "receptor_id", F.concat(F.lit("/receptors/"), F.col("receptor_id").cast("string"), F.lit(".pdb")).alias("protein_path"),
        F.lit("").alias("protein_sequence"))
    norm, err = smiles_check(F.col("smiles"))
    lig = view(spark, sf, "smiles_like").select((F.col("p_partkey") % 10).alias("receptor_id"),
                                                F.col("p_partkey").alias("ligand_id"), norm.alias("smiles"),
                                                err.alias("err")).where("err is null")
    return docking_manifest(rec, lig, "receptor_id")


SCREEN_SQL = duck_with("atoms") + """,
rec as (select * from atoms where mol_id % 2 = 0),
lig as (select mol_id as ligand, atom_id % 4 as pose_id, atom_id, element, x, y, z from atoms where mol_id % 2 = 1),
cen as (select avg(x) as cx, avg(y) as cy, avg(z) as cz from rec),
inbox as (select l.* from lig l, cen where abs(l.x - cx) <= 60 and abs(l.y - cy) <= 60 and abs(l.z - cz) <= 60),
rbox as (select r.* from rec r, cen where abs(r.x - cx) <= 68 and abs(r.y - cy) <= 68 and abs(r.z - cz) <= 68),
pr as (select l.ligand, l.pose_id,
         sqrt((l.x - r.x) ^ 2 + (l.y - r.y) ^ 2 + (l.z - r.z) ^ 2)
         - case l.element when 'C' then 1.9 when 'N' then 1.8 when 'O' then 1.7 when 'S' then 2.0 else 1.9 end
         - case r.element when 'C' then 1.9 when 'N' then 1.8 when 'O' then 1.7 when 'S' then 2.0 else 1.9 end as d
       from inbox l join rbox r on (l.x - r.x) ^ 2 + (l.y - r.y) ^ 2 + (l.z - r.z) ^ 2 <= 64),
sc as (select ligand, pose_id, round(sum(-0.0356 * exp(-((d / 0.5) ^ 2)) + case when d < 0 then 0.84 * d * d else 0 end), 3) as score,
         count(*) as contacts from pr group by ligand, pose_id)
select ligand, pose_id, score, contacts, cast(rank as int) as rank from (select *, row_number() over (partition by ligand order by score, pose_id) as rank from sc) t
where rank <= 10"""


@register("screen_poses", SCREEN_SQL)
def q_screen(spark, sf):
    a = view(spark, sf, "atoms")
    rec = a.where(F.col("mol_id") % 2 == 0)
    lig = a.where(F.col("mol_id") % 2 == 1).select(F.col("mol_id").alias("ligand"), (F.col("atom_id") % 4).alias("pose_id"),
                                                   "atom_id", "element", "x", "y", "z")
    c = rec.agg(F.avg("x"), F.avg("y"), F.avg("z")).first()     # one receptor centre (3 numbers)
    return screen_poses(lig, rec, (c[0], c[1], c[2]), size=120.0, cutoff=8.0, num_poses=10)


# Every grid cell against every atom of its receptor; pockets by spreading the
# smallest cell along faces until nothing changes.
@register("pocket_points", duck_with("atoms").replace("with ", "with recursive ", 1) + """
, bb as (select mol_id, min(x) as lx, min(y) as ly, min(z) as lz, max(x) as hx, max(y) as hy, max(z) as hz from atoms group by mol_id),
gx as (select *, unnest(range(cast(floor((hx - lx) / 2.0) as bigint) + 1)) as ix from bb),
gy as (select *, unnest(range(cast(floor((hy - ly) / 2.0) as bigint) + 1)) as iy from gx),
g as (select *, unnest(range(cast(floor((hz - lz) / 2.0) as bigint) + 1)) as iz from gy),
d as (select g.mol_id, ix, iy, iz, lx + ix * 2.0 as px, ly + iy * 2.0 as py, lz + iz * 2.0 as pz,
  sqrt((lx + ix * 2.0 - a.x) ^ 2 + (ly + iy * 2.0 - a.y) ^ 2 + (lz + iz * 2.0 - a.z) ^ 2) as dist,
  case upper(a.element) when 'C' then 1.9 when 'N' then 1.8 when 'O' then 1.7 when 'S' then 2.0 when 'P' then 2.1 when 'H' then 1.1 else 1.9 end + 1.4 as near
  from g join atoms a on a.mol_id = g.mol_id),
pts as (select mol_id, ix, iy, iz, any_value(px) as x, any_value(py) as y, any_value(pz) as z, sum(case when dist <= 8.0 then 1 else 0 end) as burial
  from d group by mol_id, ix, iy, iz having sum(case when dist <= 8.0 then 1 else 0 end) >= 3 and not bool_or(dist < near)),
nodes as (select *, row_number() over (order by mol_id, ix, iy, iz) as id from pts),
e as (select a.id as src, b.id as dst from nodes a join nodes b on a.mol_id = b.mol_id
  and abs(a.ix - b.ix) + abs(a.iy - b.iy) + abs(a.iz - b.iz) = 1),
reach as (select id, id as label from nodes union select e.dst, r.label from reach r join e on e.src = r.id where r.label < e.dst),
lab as (select id, min(label) as label from reach group by id),
pk as (select n.mol_id, first_cell.ix || '_' || first_cell.iy || '_' || first_cell.iz as pocket, count(*) as n_points, round(avg(n.x), 3) as cx,
  round(avg(n.y), 3) as cy, round(avg(n.z), 3) as cz, round(avg(n.burial), 3) as mean_burial
  from lab join nodes n on n.id = lab.id join nodes first_cell on first_cell.id = lab.label group by 1, 2)
select *, cast(row_number() over (partition by mol_id order by n_points desc, pocket) as int) as rank from pk""")
def q_pockets(spark, sf):
    return pocket_points(view(spark, sf, "atoms"), spacing=2.0, min_burial=3)


@register("label_stats", duck_with("pixels") + """,
l as (select *, cast(floor(value * 10) as bigint) as label from pixels where value > 0.15),
per as (select image_id, label, count(*) as area, round(avg(x), 4) as cx, round(avg(y), 4) as cy, round(avg(0), 4) as cz,
          round(avg(value), 4) as mean_value from l group by image_id, label)
select p.*, c.cells from per p join (select image_id, count(*) as cells from per group by image_id) c on c.image_id = p.image_id""")
def q_label_stats(spark, sf):
    px = view(spark, sf, "pixels").where(F.col("value") > 0.15).withColumn(
        "label", F.floor(F.col("value") * 10).cast("bigint"))
    return label_stats(px)


LABEL_REGIONS_SQL = duck_with("pixels") + """,
fg as (select *, cast(image_id as bigint) * 4398046511104 + cast(y as bigint) * 16384 + cast(x as bigint) as id
       from pixels where value > 0.15),
edges as (select a.id as src, b.id as dst from fg a join fg b on a.image_id = b.image_id
          and ((a.y = b.y and abs(a.x - b.x) = 1) or (a.x = b.x and abs(a.y - b.y) = 1))),
cc as (with recursive walk(id, label) as (select id, id from fg
         union select e.dst, w.label from walk w join edges e on e.src = w.id)
       select id, min(label) as label from walk group by id),
lab as (select fg.*, cc.label from fg join cc using (id)),
per as (select image_id, label, count(*) as area, round(avg(x), 4) as cx, round(avg(y), 4) as cy, round(avg(0), 4) as cz,
          round(avg(value), 4) as mean_value from lab group by image_id, label)
select p.*, c.cells, round(2.0 * sqrt(p.area / pi()), 4) as diameter
from per p join (select image_id, count(*) as cells from per group by image_id) c on c.image_id = p.image_id"""


@register("label_regions", LABEL_REGIONS_SQL)
def q_label_regions(spark, sf):
    return label_regions(view(spark, sf, "pixels"), threshold=0.15)


def _make_brightness_model():
    # a user-supplied model: logistic response to a pixel's value
    def predict(values: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-8.0 * (values - 0.15)))
    return predict


@register("batch_predict", duck_with("pixels") + """
select image_id, y, x, value, round(1.0 / (1.0 + exp(-8.0 * (value - 0.15))), 6) as prediction from pixels""")
def q_batch_predict(spark, sf):
    px = view(spark, sf, "pixels")
    out = batch_predict(px, _make_brightness_model, DoubleType(), ["value"], batch_size=1024)
    return out.withColumn("prediction", F.round("prediction", 6))
