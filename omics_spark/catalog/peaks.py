"""Registered queries: ChIP-seq family (E2, E6, F8, F13 via P8, P8, P9, D6/F9 via P9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import poisson_upper
from ..operators.windows import bh_qvalues, local_background
from ..plans.peaks import call_peaks, motif_enrichment, motif_enrichment_in_peaks
from ..sources.fixtures import duck_with, view
from . import register

BH_SQL = duck_with("pvals") + """
select id, p, grp, round(least(1.0, min(p * m / rk) over (partition by grp order by p desc, rk desc
    rows between unbounded preceding and current row)), 6) as q
from (select id, p, grp, row_number() over (partition by grp order by p) as rk,
        count(*) over (partition by grp) as m from pvals) x"""


@register("bh_qvalues", BH_SQL)
def q_bh(spark, sf):
    x = bh_qvalues(view(spark, sf, "pvals"), "p", ["grp"])
    return x.select("id", "p", "grp", F.round("q", 6).alias("q"))


@register("bh_qvalues_global", BH_SQL.replace("partition by grp order by p desc", "order by p desc")
          .replace("partition by grp order by p)", "order by p)").replace("count(*) over (partition by grp)", "count(*) over ()"))
def q_bh_global(spark, sf):
    x = bh_qvalues(view(spark, sf, "pvals"), "p")
    return x.select("id", "p", "grp", F.round("q", 6).alias("q"))


def _control_bins(spark, sf):
    c = view(spark, sf, "chip_tags").where("sample = 'control'")
    return c.groupBy("contig", F.floor(F.col("start_pos") / 1000).cast("bigint").alias("bin")) \
            .agg(F.count(F.lit(1)).alias("count"))


@register("local_background", duck_with("chip_tags") + """,
cb as (select contig, cast(floor(start_pos / 1000) as bigint) as bin, count(*) as count
       from chip_tags where sample = 'control' group by 1, 2),
grid as (select contig, unnest(generate_series(0, max(bin))) as bin from cb group by contig),
g as (select g.contig, g.bin, coalesce(c.count, 0) as count from grid g left join cb c on c.contig = g.contig and c.bin = g.bin)
select contig, bin, count,
  round(avg(count) over (partition by contig order by bin range between 10 preceding and 10 following), 6) as bg_10,
  round(avg(count) over (partition by contig order by bin range between 100 preceding and 100 following), 6) as bg_100
from g""")
def q_local_background(spark, sf):
    x = local_background(_control_bins(spark, sf), [10, 100])
    return x.select("contig", "bin", "count", F.round("bg_10", 6).alias("bg_10"), F.round("bg_100", 6).alias("bg_100"))


@register("poisson_upper", duck_with("chip_tags") + """,
b as (select contig, cast(floor(start_pos / 1000) as bigint) as bin,
        cast(sum(case when sample = 'treatment' then 1 else 0 end) as bigint) as n,
        cast(sum(case when sample = 'control' then 1 else 0 end) as double) + 0.5 as lam
      from chip_tags group by 1, 2)
select contig, bin, cast(n as bigint) as n, lam,
  round(greatest(0.0, 1.0 - coalesce((select sum(exp(-lam + k * ln(lam) - lgamma(k + 1))) from range(0, cast(n as bigint)) t(k)), 0.0)), 6) as p
from b""")
def q_poisson(spark, sf):
    t = view(spark, sf, "chip_tags")
    b = t.groupBy("contig", F.floor(F.col("start_pos") / 1000).cast("bigint").alias("bin")).agg(
        F.sum(F.when(F.col("sample") == "treatment", 1).otherwise(0)).cast("bigint").alias("n"),
        (F.sum(F.when(F.col("sample") == "control", 1).otherwise(0)) * 1.0 + 0.5).alias("lam"))
    pairs = b.select("n", "lam").distinct().withColumn("p", F.round(poisson_upper(F.col("n"), F.col("lam")), 6))
    return b.join(pairs, ["n", "lam"]).select("contig", "bin", "n", "lam", "p")


def peaks_sql(tags, d=200, bin_size=50, genome_size=2.7e9, q=0.05):
    """``peaks`` of the tags: windows of bins as range frames, Poisson tails
    as sums of their terms, ranks over all bins."""
    k1, k10 = 500 // bin_size, 5000 // bin_size

    def mean(h):
        return (f"sum(c_count) over (partition by contig order by bin range between {h} preceding and {h} following)"
                f" / cast(least(bin + {h}, mx) - greatest(bin - {h}, 0) + 1 as double)")

    term = "-lam + {k} * ln(lam) - lgamma({k} + 1)"
    return f"""
tag as (select sample, contig, greatest(case when strand = '-' then start_pos - {d} + 1 else start_pos end, 0) as s from {tags}),
tot as (select cast(count(*) filter (where sample = 'treatment') as double) as nt, cast(count(*) filter (where sample = 'control') as double) as nc from tag),
bn as (select contig, b as bin, count(*) filter (where sample = 'treatment') as t_count, count(*) filter (where sample = 'control') as c_count
  from (select sample, contig, unnest(generate_series(s // {bin_size}, (s + {d} - 1) // {bin_size})) as b from tag) x group by contig, b),
bm as (select *, max(bin) over (partition by contig) as mx from bn),
bl as (select contig, bin, t_count, {mean(k1)} as l1, {mean(k10)} as l10 from bm),
lm as (select contig, bin, t_count, round(greatest(nt * {d} / {genome_size}, l1 * (nt / nc), l10 * (nt / nc)), 6) as lam from bl, tot where t_count > 0),
dp as (select distinct t_count as n, lam from lm),
pv as (select n, lam, case
    when n > lam then (select sum(exp({term.format(k="j")} - ({term.format(k="n")}))) from range(n, n + 61 + cast(ceil(12 * sqrt(lam)) as bigint)) r(j)) end as tail,
    case when n <= lam then 1 - (select sum(exp({term.format(k="j")})) from range(0, n) r(j)) end as rest from dp),
lp as (select n, lam, case when n > lam then log10(tail) + ({term.format(k="n")}) / ln(10) else log10(greatest(0.0, rest)) end as log10p from pv),
pp as (select lm.*, log10p, pow(10.0, log10p) as p from lm join lp on lp.n = lm.t_count and lp.lam = lm.lam),
rk as (select *, count(*) over () as m, count(*) over (order by p range between unbounded preceding and current row) as r from pp),
qv as (select *, least(1.0, min(p * m / r) over (order by p range between current row and unbounded following)) as q from rk),
sig as (select contig, bin, t_count, lam, log10p, q, bin - row_number() over (partition by contig order by bin) as run from qv where q <= {q}),
pk as (select contig, min(bin) * {bin_size} as start_pos, (max(bin) + 1) * {bin_size} as end_pos,
  arg_min({{'bin': bin, 't': t_count, 'lam': lam, 'lp': log10p, 'q': q}}, (-t_count, bin)) as b from sig group by contig, run),
peaks as (select contig, cast(start_pos as bigint) as start_pos, cast(end_pos as bigint) as end_pos, 'peak_' || contig || '_' || start_pos as name,
  cast(least(1000, round(-10 * log10(greatest(b.q, 1e-300)))) as int) as score, '.' as strand, round(b.t / b.lam, 3) as signal,
  round(-b.lp, 3) as p_value, round(-log10(greatest(b.q, 1e-300)), 3) as q_value, cast(b.bin * {bin_size} - start_pos + {bin_size // 2} as bigint) as peak,
  cast(b.t as bigint) as summit_count from pk)"""


@register("call_peaks", duck_with("chip_tags") + "," + peaks_sql("chip_tags") + " select * from peaks")
def q_call_peaks(spark, sf):
    t = view(spark, sf, "chip_tags")
    return call_peaks(t.where("sample = 'treatment'"), t.where("sample = 'control'"), "hs", 0.05, 200)


def _lchoose(n, k):
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


#: From ``kept`` (seq_id, grp, seq) to the 25 first motifs.
_MOTIF_SQL = ("""
km as (select distinct seq_id, grp, least(kmer, reverse(translate(kmer, 'ACGTNU', 'TGCANA'))) as kmer
  from (select seq_id, grp, substring(seq, cast(i as int), 8) as kmer from (select *, unnest(range(1, length(seq) - 6)) as i from kept) y) z),
h as (select kmer, count(*) filter (where grp = 'target') as t_hits, count(*) filter (where grp = 'background') as b_hits from km group by kmer),
n as (select count(*) filter (where grp = 'target') as nt, count(*) filter (where grp = 'background') as nb from kept),
pairs as (select distinct t_hits, b_hits from h where t_hits > 0),
tail as (select t_hits, b_hits, least(1.0, sum(exp(""" + _lchoose("(t_hits + b_hits)", "j") + " + " + _lchoose("(nt + nb - t_hits - b_hits)", "(nt - j)")
          + " - " + _lchoose("(nt + nb)", "nt") + """))) as p
  from (select *, unnest(range(t_hits, least(nt, t_hits + b_hits) + 1)) as j from pairs, n) y where nt - j <= nt + nb - t_hits - b_hits group by t_hits, b_hits),
x as (select h.kmer, h.t_hits, h.b_hits, nt as n_target, nb as n_background, p,
  round((h.t_hits / nt) / ((h.b_hits + 1) / (greatest(nb, 1) + 1)), 3) as fold
  from h join tail on tail.t_hits = h.t_hits and tail.b_hits = h.b_hits, n),
q as (select *, count(*) over () as m, count(*) over (order by p range between unbounded preceding and current row) as r from x),
qq as (select *, least(1.0, min(p * m / r) over (order by p range between current row and unbounded following)) as q0 from q)
select kmer, cast(t_hits as bigint) as t_hits, cast(b_hits as bigint) as b_hits, cast(n_target as int) as n_target, cast(n_background as int) as n_background,
  fold, round(p, 9) as p, round(q0, 9) as q, cast(rank as int) as rank
from (select *, row_number() over (order by p, kmer) as rank from qq) y where rank <= 25""")


@register("motif_enrichment", duck_with("motif_seqs") + """,
m as (select seq_id, grp, upper(seq) as seq, least(floor(cast(length(regexp_replace(upper(seq), '[^GC]', '', 'g')) as double) / length(seq) * 10), 9) as dec
  from motif_seqs),
kept as (select * from m where grp = 'target' or dec in (select dec from m where grp = 'target')),""" + _MOTIF_SQL)
def q_motif_enrichment(spark, sf):
    m = view(spark, sf, "motif_seqs")
    x = motif_enrichment(m.where("grp = 'target'"), m.where("grp = 'background'"), k=8)
    return x.withColumn("p", F.round("p", 9)).withColumn("q", F.round("q", 9))


SHIFTS = (-900, -450, 450, 900)


@register("motif_enrichment_in_peaks", duck_with("site_tags", "dna") + "," + peaks_sql("site_tags") + f""",
gen as (select 's' || cast(seq_id as varchar) as contig, upper(seq) as letters, length(seq) as len from dna),
tw as (select distinct p.contig, greatest(least((start_pos + end_pos) // 2 - 100, len - 200), 0) as s from peaks p join gen using (contig)),
bw as (select distinct p.contig, (start_pos + end_pos) // 2 - 100 + v as s, len from peaks p join gen using (contig), (values {", ".join(f"({v})" for v in SHIFTS)}) z(v)),
fw as (select contig, s from bw where s >= 0 and s + 200 <= len and not exists (
  select 1 from peaks p where p.contig = bw.contig and p.start_pos < bw.s + 200 and bw.s < p.end_pos)),
both_ as (select *, 'target' as grp from tw union all select *, 'background' from fw),
sq as (select contig || ':' || s as seq_id, grp, substring(letters, cast(s + 1 as int), 200) as seq from both_ join gen using (contig)),
dc as (select *, least(floor(cast(length(regexp_replace(seq, '[^GC]', '', 'g')) as double) / length(seq) * 10), 9) as dec from sq),
want as (select dec, 2 * count(*) as quota from dc where grp = 'target' group by dec),
ranked as (select dc.*, row_number() over (partition by grp, dec order by md5(seq_id)) as place from dc),
kept as (select r.* from ranked r left join want w on w.dec = r.dec where grp = 'target' or place <= quota),""" + _MOTIF_SQL)
def q_motif_in_peaks(spark, sf):
    t = view(spark, sf, "site_tags")
    genome = view(spark, sf, "dna").select(F.concat(F.lit("s"), F.col("seq_id").cast("string")).alias("contig"), "seq")
    peaks = call_peaks(t.where("sample = 'treatment'"), t.where("sample = 'control'"), "hs", 0.05, 200)
    x = motif_enrichment_in_peaks(peaks, genome, size=200, k=8, shifts=SHIFTS)
    return x.withColumn("p", F.round("p", 9)).withColumn("q", F.round("q", 9))
