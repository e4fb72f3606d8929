"""Registered queries: intervals, alignments and variants (B6, B7, C1-C3,
D1, D2, E1, E3, E4, G1, H1, A13, and the flagship slice)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignments as AL
from ..operators import intervals as IV
from ..operators.variants import filter_variants, tag_union, variant_span
from ..sources.fixtures import duck_with, view
from . import basics, register

MERGE_SQL = """
{name} as (
  select contig, min(start_pos) as start_pos, max(end_pos) as end_pos, count(*) as n_members from (
    select *, sum(case when prev_end is null or start_pos > prev_end then 1 else 0 end)
      over (partition by contig order by start_pos, end_pos rows between unbounded preceding and current row) as isl
    from (select contig, start_pos, end_pos, max(end_pos) over (partition by contig order by start_pos, end_pos
            rows between unbounded preceding and 1 preceding) as prev_end from {src}) x) y
  group by contig, isl)"""


def merge_sql(name: str, src: str) -> str:
    return MERGE_SQL.replace("{name}", name).replace("{src}", src)


def _variant_iv(df):
    s, e = variant_span()
    return df.select("contig", s.alias("start_pos"), e.alias("end_pos"), "pos", "ref", "alt")


@register("variant_overlaps_per_contig", duck_with("variants", "iv_b") + "," + merge_sql("m", "iv_b") + """
select v.contig, count(*) as n_overlaps, count(distinct v.pos) as n_variants
from (select * from variants where qual > 20) v join m on m.contig = v.contig
  and v.pos - 1 < m.end_pos and m.start_pos < v.pos - 1 + greatest(length(v.ref), 1)
group by v.contig""")
def q_flagship(spark, sf):
    """Flagship: QUAL>20 variants against merged intervals, count per contig."""
    v = filter_variants(view(spark, sf, "variants"), "QUAL>20")
    merged = IV.merge_intervals(view(spark, sf, "iv_b"))
    hits = IV.intersect_intervals(_variant_iv(v), merged)
    return hits.groupBy("contig").agg(F.count(F.lit(1)).alias("n_overlaps"),
                                      F.countDistinct("pos").alias("n_variants"))


@register("filter_variants", duck_with("variants") + "select * from variants where qual > 20")
def q_filter_variants(spark, sf):
    return filter_variants(view(spark, sf, "variants"), "QUAL>20")


@register("filter_variants_expr", duck_with("variants") +
          "select * from variants where (qual > 20 and filter = 'PASS') or not (dp >= 5)")
def q_filter_variants_expr(spark, sf):
    return filter_variants(view(spark, sf, "variants"), 'QUAL>20 && FILTER=="PASS" || !(INFO/DP>=5)')


@register("intersect_intervals", duck_with("iv_a", "iv_b") + """
select a.contig, greatest(a.start_pos, b.start_pos) as start_pos, least(a.end_pos, b.end_pos) as end_pos,
  a.start_pos as a_start_pos, a.end_pos as a_end_pos, a.strand, a.l_orderkey, a.l_linenumber,
  b.start_pos as b_start_pos, b.end_pos as b_end_pos, b.b_id
from iv_a a join iv_b b on a.contig = b.contig and a.start_pos < b.end_pos and b.start_pos < a.end_pos""")
def q_intersect(spark, sf):
    return IV.intersect_intervals(view(spark, sf, "iv_a"), view(spark, sf, "iv_b"))


@register("merge_intervals", duck_with("iv_b") + "," + merge_sql("m", "iv_b") + " select * from m")
def q_merge(spark, sf):
    return IV.merge_intervals(view(spark, sf, "iv_b"))


COMPLEMENT_SQL = """
{name} as (
  select contig, gs as start_pos, ge as end_pos from (
    select contig, coalesce(lag(end_pos) over (partition by contig order by start_pos), 0) as gs, start_pos as ge from {isl}
    union all
    select l.contig, coalesce(max(i.end_pos), 0) as gs, l.length as ge from {lens} l left join {isl} i on i.contig = l.contig
    group by l.contig, l.length) g where ge > gs)"""


@register("complement_intervals", duck_with("iv_a", "iv_b") + "," + merge_sql("m", "iv_b") + """,
lens as (select contig, max(end_pos) + 1000 as length from iv_a group by contig),""" +
          COMPLEMENT_SQL.replace("{name}", "c").replace("{isl}", "m").replace("{lens}", "lens") +
          " select * from c")
def q_complement(spark, sf):
    lens = (view(spark, sf, "iv_a").groupBy("contig")
            .agg((F.max("end_pos") + 1000).alias("length")))
    return IV.complement_intervals(view(spark, sf, "iv_b"), lens)


@register("subtract_intervals", duck_with("iv_a", "iv_b") + "," + merge_sql("m", "iv_b") + """,
lens as (select contig, max(end_pos) + 1 as length from iv_a group by contig),""" +
          COMPLEMENT_SQL.replace("{name}", "gaps").replace("{isl}", "m").replace("{lens}", "lens") + """
select a.contig, greatest(a.start_pos, g.start_pos) as start_pos, least(a.end_pos, g.end_pos) as end_pos,
  a.strand, a.l_orderkey, a.l_linenumber
from iv_a a join gaps g on a.contig = g.contig and a.start_pos < g.end_pos and g.start_pos < a.end_pos""")
def q_subtract(spark, sf):
    return IV.subtract_intervals(view(spark, sf, "iv_a"), view(spark, sf, "iv_b"))


_RESTRICT = duck_with("variants", "regions") + """
select * from variants v where {neg} exists (select 1 from regions r where r.contig = v.contig
  and v.pos - 1 < r.end_pos and r.start_pos < v.pos - 1 + greatest(length(v.ref), 1))"""


@register("restrict_to_intervals", _RESTRICT.replace("{neg}", ""))
def q_restrict(spark, sf):
    s, e = variant_span()
    return IV.restrict_to_intervals(view(spark, sf, "variants"), view(spark, sf, "regions"), "semi", s, e)


@register("exclude_intervals", _RESTRICT.replace("{neg}", "not"))
def q_exclude(spark, sf):
    s, e = variant_span()
    return IV.restrict_to_intervals(view(spark, sf, "variants"), view(spark, sf, "regions"), "anti", s, e)


@register("restrict_intervals_long", duck_with("iv_b", "regions") + """
select * from iv_b b where exists (select 1 from regions r where r.contig = b.contig
  and b.start_pos < r.end_pos and r.start_pos < b.end_pos)""")
def q_restrict_long(spark, sf):
    # small bins force many rows across bin edges: the de-duplicating path
    return IV.restrict_to_intervals(view(spark, sf, "iv_b"), view(spark, sf, "regions"), "semi",
                                    bin_size=128)


@register("depth_segments", duck_with("iv_a") + """,
ev as (select contig, pos, sum(d) as d from (select contig, start_pos as pos, 1 as d from iv_a
        union all select contig, end_pos as pos, -1 as d from iv_a) e group by contig, pos having sum(d) != 0),
s as (select contig, pos, sum(d) over (partition by contig order by pos rows between unbounded preceding and current row) as depth,
        lead(pos) over (partition by contig order by pos) as nxt from ev)
select contig, pos as start_pos, nxt as end_pos, cast(depth as bigint) as depth from s where depth > 0 and nxt is not null""")
def q_depth(spark, sf):
    return IV.depth_segments(view(spark, sf, "iv_a"))


# The greedy choice in rounds: a hit without a better overlapping hit left is
# taken, and its overlapping hits go.
@register("greedy_nonoverlap", duck_with("iv_a").replace("with ", "with recursive ", 1) + """
, h as (select *, (end_pos - start_pos) * 7 % 23 as score, row_number() over (order by (end_pos - start_pos) * 7 % 23 desc,
    l_orderkey, l_linenumber, start_pos, end_pos, strand) as rk from iv_a),
o as (select a.rk as better, b.rk as worse from h a join h b on a.contig = b.contig and a.rk < b.rk
  and a.start_pos < b.end_pos and b.start_pos < a.end_pos),
w as (
  select 0 as round, rk, not exists (select 1 from o where o.worse = h.rk) as best from h
  union all
  (with gone as (select rk from w where best union select o.worse from o join w on w.rk = o.better where w.best),
   rest as (select w.round, w.rk from w where w.rk not in (select rk from gone))
   select r.round + 1, r.rk, not exists (select 1 from o join rest r2 on r2.rk = o.better where o.worse = r.rk) from rest r))
select contig, start_pos, end_pos, strand, l_orderkey, l_linenumber, score from h where rk in (select rk from w where best)""")
def q_greedy(spark, sf):
    hits = view(spark, sf, "iv_a").withColumn("score", (F.col("end_pos") - F.col("start_pos")) * 7 % 23)
    return IV.greedy_nonoverlap(hits, "score", ["l_orderkey", "l_linenumber", "start_pos", "end_pos", "strand"])


@register("flagstat", duck_with("reads") + """
select count(*) as total,
  cast(sum(case when flag & 256 = 0 and flag & 2048 = 0 then 1 else 0 end) as bigint) as primary,
  cast(sum(case when flag & 256 != 0 then 1 else 0 end) as bigint) as secondary,
  cast(sum(case when flag & 2048 != 0 then 1 else 0 end) as bigint) as supplementary,
  cast(sum(case when flag & 1024 != 0 then 1 else 0 end) as bigint) as duplicates,
  cast(sum(case when flag & 4 = 0 then 1 else 0 end) as bigint) as mapped,
  cast(sum(case when flag & 2308 = 0 then 1 else 0 end) as bigint) as primary_mapped,
  cast(sum(case when flag & 2304 = 0 and flag & 1 != 0 then 1 else 0 end) as bigint) as paired,
  cast(sum(case when flag & 2304 = 0 and flag & 1 != 0 and flag & 64 != 0 then 1 else 0 end) as bigint) as read1,
  cast(sum(case when flag & 2304 = 0 and flag & 1 != 0 and flag & 128 != 0 then 1 else 0 end) as bigint) as read2,
  cast(sum(case when flag & 2304 = 0 and flag & 1 != 0 and flag & 2 != 0 and flag & 4 = 0 then 1 else 0 end) as bigint) as properly_paired,
  cast(sum(case when flag & 2304 = 0 and flag & 1 != 0 and flag & 12 = 0 then 1 else 0 end) as bigint) as both_mapped,
  cast(sum(case when flag & 2304 = 0 and flag & 1 != 0 and flag & 4 = 0 and flag & 8 != 0 then 1 else 0 end) as bigint) as singletons,
  cast(0 as bigint) as mate_other_contig, cast(0 as bigint) as mate_other_contig_q5
from reads""")
def q_flagstat(spark, sf):
    return AL.flagstat(view(spark, sf, "reads"))


_READS_COUNTED = "(select row_number() over () as rid, * from reads where flag & 2308 = 0)"


@register("bin_coverage", duck_with("reads") + ", rr as " + _READS_COUNTED + ", " +
          basics.CIGAR_BLOCKS_SQL.replace("{src}", "rr") + """,
reflen as (select rid, cast(sum(case when code in ('M','D','N','=','X') then len else 0 end) as bigint) as ref_len from ops group by rid),
spans as (select contig, unnest(generate_series((r.pos - 1) // 1000, (r.pos - 1 + greatest(l.ref_len, 1) - 1) // 1000)) as b
          from rr r join reflen l on l.rid = r.rid),
bases as (select b.pos - 1 + b.ref_off + i as p, r.contig from blocks b join rr r on r.rid = b.rid,
          unnest(generate_series(0, b.len - 1)) t(i)),
sc as (select contig, b, count(*) as n from spans group by contig, b),
bc as (select contig, p // 1000 as b, count(*) as n from bases group by contig, p // 1000)
select coalesce(sc.contig, bc.contig) as contig, cast(coalesce(sc.b, bc.b) * 1000 as bigint) as start_pos,
  cast((coalesce(sc.b, bc.b) + 1) * 1000 as bigint) as end_pos,
  cast(coalesce(sc.n, 0) as bigint) as n_reads, cast(coalesce(bc.n, 0) as bigint) as bases
from sc full outer join bc on sc.contig = bc.contig and sc.b = bc.b""")
def q_bin_coverage(spark, sf):
    return AL.bin_coverage(view(spark, sf, "reads"), 1000)


@register("target_coverage", duck_with("reads", "regions") + ", rr as " + _READS_COUNTED + ", " +
          basics.CIGAR_BLOCKS_SQL.replace("{src}", "rr") + """,
reflen as (select rid, cast(sum(case when code in ('M','D','N','=','X') then len else 0 end) as bigint) as ref_len from ops group by rid),
sp as (select r.contig, r.pos - 1 as s, r.pos - 1 + greatest(l.ref_len, 1) as e from rr r join reflen l on l.rid = r.rid),
bl as (select r.contig, b.pos - 1 + b.ref_off as s, b.pos - 1 + b.ref_off + b.len as e from blocks b join rr r on r.rid = b.rid)
select g.contig, g.start_pos, g.end_pos, g.region_id,
  cast((select count(*) from sp where sp.contig = g.contig and sp.s < g.end_pos and g.start_pos < sp.e) as bigint) as n_reads,
  cast(coalesce((select sum(least(bl.e, g.end_pos) - greatest(bl.s, g.start_pos)) from bl
    where bl.contig = g.contig and bl.s < g.end_pos and g.start_pos < bl.e), 0) as bigint) as bases
from regions g""")
def q_target_coverage(spark, sf):
    return AL.target_coverage(view(spark, sf, "reads"), view(spark, sf, "regions"))


@register("sort_alignments", duck_with("reads") + """
select contig, pos, l_orderkey, l_linenumber, flag, mapq, cigar,
  row_number() over (partition by contig order by pos, l_orderkey, l_linenumber, flag, mapq, cigar) as ordinal
from reads""")
def q_sort(spark, sf):
    return AL.sort_alignments(view(spark, sf, "reads"))


@register("view_alignments", duck_with("reads") + ", rr as " + _READS_COUNTED.replace("flag & 2308 = 0", "true") + ", " +
          basics.CIGAR_BLOCKS_SQL.replace("{src}", "rr") + """,
reflen as (select rid, cast(sum(case when code in ('M','D','N','=','X') then len else 0 end) as bigint) as ref_len from ops group by rid)
select r.l_orderkey, r.l_linenumber, r.contig, r.pos, r.flag, r.mapq, r.cigar from rr r join reflen l on l.rid = r.rid
where r.flag & 65 = 65 and r.flag & 1024 = 0 and r.mapq >= 20 and r.contig = 'chr2'
  and r.pos - 1 + greatest(l.ref_len, 1) > 100000 and r.pos - 1 < 2600000""")
def q_view(spark, sf):
    return AL.view_alignments(view(spark, sf, "reads"), require=65, exclude=1024, min_mapq=20,
                              region="chr2:100,001-2,600,000")


@register("tag_union", duck_with("sample_reads") + """
select 'T' as sample, contig, pos, flag, l_orderkey, l_linenumber from sample_reads where sample = 'tumor'
union all select 'N' as sample, contig, pos, flag, l_orderkey, l_linenumber from sample_reads where sample = 'normal'""")
def q_tag_union(spark, sf):
    sr = view(spark, sf, "sample_reads").select("contig", "pos", "flag", "l_orderkey", "l_linenumber", "sample")
    t = sr.where("sample = 'tumor'").drop("sample")
    n = sr.where("sample = 'normal'").drop("sample")
    return tag_union(T=t, N=n)


@register("read_region", duck_with("reads") + ", rr as " + _READS_COUNTED.replace("flag & 2308 = 0", "true") + ", " +
          basics.CIGAR_BLOCKS_SQL.replace("{src}", "rr") + """,
reflen as (select rid, cast(sum(case when code in ('M','D','N','=','X') then len else 0 end) as bigint) as ref_len from ops group by rid)
select r.l_orderkey, r.l_linenumber, r.contig, r.pos, r.flag, r.mapq, r.cigar from rr r join reflen l on l.rid = r.rid
where r.contig = 'chr3' and r.pos - 1 + greatest(l.ref_len, 1) > 200000 and r.pos - 1 < 2700000""")
def q_read_region(spark, sf):
    path = AL.scratch_path(spark, "indexed-reads")
    AL.write_indexed(view(spark, sf, "reads"), path, bin_size=1_000_000)
    return AL.read_region(spark, path, "chr3:200,001-2,700,000", bin_size=1_000_000) \
        .select("l_orderkey", "l_linenumber", "contig", "pos", "flag", "mapq", "cigar")
