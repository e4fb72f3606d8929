"""Registered queries: structural variants (C7, H2, E5, P15) and copy
number (E8, F12, E7, P16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import copy_number
from ..operators.alignments import bin_coverage, mate_join
from ..operators.variants import evidence_union
from ..operators.windows import change_points, cluster_positions, median_center
from ..plans.sv import copy_number_profile, discordant_evidence, split_evidence, structural_variants
from ..sources.fixtures import duck_with, view
from . import register


def _with_mates(spark, sf):
    p = view(spark, sf, "pairs")
    f = F.col("flag")
    mate_flag = (F.lit(1 + 128) + F.when(f.bitwiseAND(32) != 0, 16).otherwise(0)
                 + F.when(f.bitwiseAND(16) != 0, 32).otherwise(0)).cast("int")
    r1 = p.select("qname", "contig", "pos", "flag")
    r2 = p.select("qname", F.col("rnext").alias("contig"), F.col("pnext").alias("pos"), mate_flag.alias("flag"))
    return r1.unionByName(r2)


@register("mate_join", duck_with("pairs") + """
select a.qname, a.contig as r1_contig, a.pos as r1_pos, a.flag as r1_flag,
  a.rnext as r2_contig, a.pnext as r2_pos,
  cast(129 + case when a.flag & 32 != 0 then 16 else 0 end + case when a.flag & 16 != 0 then 32 else 0 end as int) as r2_flag
from pairs a""")
def q_mate_join(spark, sf):
    return mate_join(_with_mates(spark, sf))


def _split_reads(spark, sf):
    p = view(spark, sf, "pairs")
    s = view(spark, sf, "split_pairs")
    return p.join(s, "o_orderkey").select("qname", "contig", "pos", "flag", "sa")


EVIDENCE_SQL = duck_with("pairs", "split_pairs") + """,
disc as (select qname, case when rnext != contig then 'BND'
    when (flag & 16 != 0) = (flag & 32 != 0) then 'INV'
    when flag & 16 = 0 and pnext - pos > 1000 then 'DEL'
    when flag & 16 != 0 and flag & 32 = 0 and pnext - pos > 1000 then 'DUP'
    when flag & 16 = 0 and pnext - pos < 0 then 'DUP' end as sv_type,
  contig, pos as pos1, rnext as contig2, pnext as pos2, 'discordant' as evidence from pairs
  where flag & 1 != 0 and flag & 12 = 0 and flag & 2304 = 0 and (flag & 64 != 0 or flag & 128 = 0)),
spl as (select p.qname, p.contig, p.pos, p.flag, string_split(regexp_replace(s.sa, ';.*$', ''), ',') as sa
        from pairs p join split_pairs s on s.o_orderkey = p.o_orderkey where s.sa is not null and length(s.sa) > 0),
split as (select qname, case when sa[1] != contig then 'BND'
    when sa[3] != case when flag & 16 != 0 then '-' else '+' end then 'INV'
    when cast(sa[2] as bigint) > pos + 50 then 'DEL' else 'DUP' end as sv_type,
  contig, pos as pos1, sa[1] as contig2, cast(sa[2] as bigint) as pos2, 'split' as evidence from spl),
ev as (select * from disc where sv_type is not null union all select * from split)"""

CLUSTER_SQL = """
{name} as (select {src}.*, c.cl as {out} from {src} join (
    select {keys}, {pos}, max(case when isnew then {pos} end) over (partition by {keys} order by {pos}
      rows between unbounded preceding and current row) as cl
    from (select *, lag({pos}) over (partition by {keys} order by {pos}) is null
                 or {pos} - lag({pos}) over (partition by {keys} order by {pos}) > 500 as isnew
          from (select distinct {keys}, {pos} from {src}) d) e) c
  using ({keys}, {pos}))"""


def cluster_sql(name, src, keys, pos, out):
    return (CLUSTER_SQL.replace("{name}", name).replace("{src}", src).replace("{keys}", keys)
            .replace("{pos}", pos).replace("{out}", out))


@register("evidence_union", EVIDENCE_SQL + " select * from ev")
def q_evidence(spark, sf):
    return evidence_union(discordant_evidence(view(spark, sf, "pairs")), split_evidence(_split_reads(spark, sf)))


@register("cluster_positions", EVIDENCE_SQL + "," + cluster_sql("c1", "ev", "sv_type, contig", "pos1", "cluster") +
          " select * from c1")
def q_cluster(spark, sf):
    ev = evidence_union(discordant_evidence(view(spark, sf, "pairs")), split_evidence(_split_reads(spark, sf)))
    return cluster_positions(ev, "pos1", 500, ["sv_type", "contig"])


# evidence with ordered ends, linked to all that is near at both ends, by closure
CALLS_SQL = """,
oe as (select sv_type, evidence, case when swap then contig2 else contig end as contig, case when swap then contig else contig2 end as contig2,
    case when swap then pos2 else pos1 end as pos1, case when swap then pos1 else pos2 end as pos2
  from (select *, contig > contig2 or (contig = contig2 and pos1 > pos2) as swap from ev) x),
pt as materialized (select *, row_number() over () as id from (select distinct sv_type, contig, contig2, pos1, pos2 from oe) x),
link as materialized (select a.id as a, b.id as b from pt a join pt b on a.sv_type = b.sv_type and a.contig = b.contig and a.contig2 = b.contig2
  and abs(a.pos1 - b.pos1) <= 500 and abs(a.pos2 - b.pos2) <= 500),
reach as (select id as a, id as b from pt union select r.a, l.b from reach r join link l on l.a = r.b),
lab as (select a as id, min(b) as label from reach group by a),
calls as (select any_value(oe.sv_type) as sv_type, any_value(oe.contig) as contig, any_value(oe.contig2) as contig2, min(oe.pos1) as start, max(oe.pos2) as "end",
  count(*) as support, cast(sum(case when evidence = 'discordant' then 1 else 0 end) as bigint) as n_discordant,
  cast(sum(case when evidence = 'split' then 1 else 0 end) as bigint) as n_split
  from oe join pt on pt.sv_type = oe.sv_type and pt.contig = oe.contig and pt.contig2 = oe.contig2 and pt.pos1 = oe.pos1 and pt.pos2 = oe.pos2
  join lab on lab.id = pt.id group by label)"""


def recursive(sql):
    return sql.replace("with ", "with recursive ", 1)


SV_EVIDENCE_SQL = duck_with("sv_reads") + """,
disc as (select qname, case when rnext != contig then 'BND'
    when (flag & 16 != 0) = (flag & 32 != 0) then 'INV'
    when flag & 16 = 0 and pnext - pos > 1000 then 'DEL'
    when flag & 16 != 0 and flag & 32 = 0 and pnext - pos > 1000 then 'DUP'
    when flag & 16 = 0 and pnext - pos < 0 then 'DUP' end as sv_type,
  contig, pos as pos1, rnext as contig2, pnext as pos2, 'discordant' as evidence from sv_reads),
spl as (select *, string_split(regexp_replace(sa, ';.*$', ''), ',') as part from sv_reads where sa is not null),
ev as (select * from disc where sv_type is not null
  union all select qname, case when part[1] != contig then 'BND' when part[3] != '+' then 'INV' when cast(part[2] as bigint) > pos then 'DEL' else 'DUP' end,
    contig, pos, part[1], cast(part[2] as bigint), 'split' from spl)"""


@register("structural_variants", recursive(SV_EVIDENCE_SQL + CALLS_SQL) + " select * from calls where support >= 2")
def q_sv(spark, sf):
    reads = view(spark, sf, "sv_reads")
    return structural_variants(reads.drop("sa"), reads.select("qname", "contig", "pos", "flag", "sa"))


@register("structural_variants_all_support", recursive(EVIDENCE_SQL + CALLS_SQL) + " select * from calls")
def q_sv_all(spark, sf):
    # every evidence cluster (min_support=1): this fixture's breakpoints are sparse
    return structural_variants(view(spark, sf, "pairs"), _split_reads(spark, sf), min_support=1)


def _sample_bins(spark, sf, sample):
    r = view(spark, sf, "sample_reads").where(F.col("sample") == sample)
    return bin_coverage(r, 50).select("contig", "start_pos", F.col("n_reads").alias(sample[0]))


BINS_SQL = duck_with("sample_reads") + """,
sb as (select sample, contig, unnest(generate_series((pos - 1) // 50, (pos - 1 + 49) // 50)) as b
       from sample_reads where flag & 2308 = 0),
cnt as (select contig, b * 50 as start_pos, cast(sum(case when sample = 'tumor' then 1 else 0 end) as bigint) as t,
          cast(sum(case when sample = 'normal' then 1 else 0 end) as bigint) as n from sb group by contig, b)"""


@register("median_center", BINS_SQL + """
select contig, start_pos, t, round(t - (select quantile_cont(t, 0.5) from cnt where t > 0), 4) as t_centered
from cnt where t > 0""")
def q_median_center(spark, sf):
    t = _sample_bins(spark, sf, "tumor").withColumn("_all", F.lit(0))
    x = median_center(t, "t", ["_all"], "t_centered").drop("_all")
    return x.select("contig", "start_pos", "t", F.round("t_centered", 4).alias("t_centered"))


@register("copy_number", BINS_SQL + """
select contig, start_pos, t, n, cast(round(2 * pow(2, log2((t + 1.0) / (n + 1.0)))) as int) as cn from cnt""")
def q_copy_number(spark, sf):
    t = _sample_bins(spark, sf, "tumor")
    n = _sample_bins(spark, sf, "normal")
    x = t.join(n, ["contig", "start_pos"], "full").fillna(0, ["t", "n"])
    return x.select("contig", "start_pos", "t", "n",
                    copy_number(F.log2((F.col("t") + 1.0) / (F.col("n") + 1.0))).alias("cn"))


def change_points_sql(src, w, threshold=0.5):
    """``seg``: change points of ``src`` (contig, bin, log2) on the dense grid."""
    near = f"partition by contig order by bin rows between {w} preceding and 1 preceding"
    after = f"partition by contig order by bin rows between 1 following and {w} following"
    return f"""
cp_grid as (select contig, unnest(generate_series(0, max(bin))) as bin from {src} group by contig),
cp_g as (select g.contig, g.bin, coalesce(x.log2, 0.0) as log2, max(g.bin) over (partition by g.contig) as mx
  from cp_grid g left join {src} x on x.contig = g.contig and x.bin = g.bin),
cp_t as (select *, case when bin >= {w} and bin + {w} - 1 <= mx then round(
    avg(log2) over (partition by contig order by bin rows between current row and {w - 1} following) - avg(log2) over ({near}), 9) end as t from cp_g),
cp_b as (select *, coalesce(abs(t) > {threshold} and abs(t) > coalesce(greatest(max(abs(t)) over ({near}), max(abs(t)) over ({after})), -1), false) as is_break from cp_t),
seg as (select contig, bin, log2, t, is_break, cast(sum(case when is_break then 1 else 0 end) over (partition by contig order by bin) as bigint) as segment from cp_b)"""


SEGMENTS_SQL = """
select x.contig, segment, min(start_pos) as start_pos, max(end_pos) as end_pos, count(*) as n_bins, round(avg(x.log2), 4) as mean_log2,
  cast(round(2 * pow(2, round(avg(x.log2), 4))) as int) as cn
from x join seg on seg.contig = x.contig and seg.bin = x.bin group by x.contig, segment"""


@register("change_points", BINS_SQL + """,
x as (select contig, start_pos // 50 as bin, log2((t + 1.0) / (n + 1.0)) as log2 from cnt),""" + change_points_sql("x", 3) + """
select contig, bin, round(log2, 9) as log2, t, is_break, segment from seg""")
def q_change_points(spark, sf):
    t = _sample_bins(spark, sf, "tumor")
    n = _sample_bins(spark, sf, "normal")
    x = t.join(n, ["contig", "start_pos"], "full").fillna(0, ["t", "n"])
    x = x.select("contig", F.floor(F.col("start_pos") / 50).cast("bigint").alias("bin"),
                 F.log2((F.col("t") + 1.0) / (F.col("n") + 1.0)).alias("log2"))
    return change_points(x, "log2", 3, 0.5).select("contig", "bin", F.round("log2", 9).alias("log2"), "t", "is_break", "segment")


@register("copy_number_profile", BINS_SQL.replace(duck_with("sample_reads"), duck_with("sample_reads", "dna")) + """,
x0 as (select contig, start_pos, start_pos + 50 as end_pos, start_pos // 50 as bin, log2((t + 1.0) / (n + 1.0)) as log2 from cnt),
x1 as (select x0.*, x0.log2 - (select quantile_cont(log2, 0.5) from x0) as centred,
  upper(substring(d.seq, cast(start_pos + 1 as int), 50)) as g from x0 join dna d on 's' || cast(d.seq_id as varchar) = x0.contig),
x2 as (select *, least(floor(cast(length(regexp_replace(g, '[^GC]', '', 'g')) as double) / length(g) * 10), 9) as dec from x1 where length(g) > 0),
x as (select contig, start_pos, end_pos, bin, centred - quantile_cont(centred, 0.5) over (partition by dec) as log2 from x2),""" +
          change_points_sql("x", 3) + SEGMENTS_SQL)
def q_cnv(spark, sf):
    sr = view(spark, sf, "sample_reads")
    genome = view(spark, sf, "dna").select(F.concat(F.lit("s"), F.col("seq_id").cast("string")).alias("contig"), "seq")
    return copy_number_profile(sr.where("sample = 'tumor'"), sr.where("sample = 'normal'"), None, 50, genome, w=3)


@register("copy_number_profile_targets", duck_with("sample_reads", "gene_models") + """,
c as (select g.contig, g.start_pos, g.end_pos, g.gene_id, sum(case when r.sample = 'tumor' then 1 else 0 end) as t,
    sum(case when r.sample = 'normal' then 1 else 0 end) as n
  from gene_models g left join (select * from sample_reads where flag & 2308 = 0) r
    on r.contig = g.contig and r.pos - 1 < g.end_pos and g.start_pos < r.pos - 1 + 50 group by g.contig, g.start_pos, g.end_pos, g.gene_id),
x0 as (select *, row_number() over (partition by contig order by start_pos, end_pos, t, n) - 1 as bin, log2((t + 1.0) / (n + 1.0)) as l from c),
x as (select contig, start_pos, end_pos, bin, l - (select quantile_cont(l, 0.5) from x0) as log2 from x0),""" +
          change_points_sql("x", 3) + SEGMENTS_SQL)
def q_cnv_targets(spark, sf):
    sr = view(spark, sf, "sample_reads")
    targets = view(spark, sf, "gene_models").select("contig", "start_pos", "end_pos",
                                                    F.col("gene_id").alias("region_id"))
    return copy_number_profile(sr.where("sample = 'tumor'"), sr.where("sample = 'normal'"), targets, w=3)
