"""Registered queries: file formats as write -> read round trips of fixture
tables (A1, A4-A9, A11, A12) and the pipe operators (U1, U2). Files go to
a fresh folder under the session's checkpoint directory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.alignments import scratch_path
from ..operators.pipe import pipe_groups, pipe_lines
from ..sources import formats as FM
from ..sources.fixtures import duck_with, view
from . import register


@register("fasta_roundtrip", duck_with("dna") + "select seq_id, seq from dna")
def q_fasta(spark, sf):
    path = scratch_path(spark, "fasta")
    FM.write_fasta(view(spark, sf, "dna"), path)
    return FM.read_fasta(spark, path).select(F.col("seq_id").cast("bigint").alias("seq_id"), "seq")


@register("fastq_roundtrip", duck_with("planted_reads") + """
select concat_ws('_', l_orderkey, l_linenumber, l_partkey) as read_id, seq, repeat('I', cast(length(seq) as int)) as qual
from planted_reads""")
def q_fastq(spark, sf):
    p = view(spark, sf, "planted_reads")
    reads = p.select(F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey").alias("read_id"), "seq",
                     F.expr("repeat('I', length(seq))").alias("qual"))
    path = scratch_path(spark, "fastq")
    FM.write_fastq(reads, path)
    return FM.read_fastq(spark, path).select("read_id", "seq", "qual")


@register("sam_roundtrip", duck_with("reads") + "select contig, pos, flag, mapq, cigar from reads")
def q_sam(spark, sf):
    path = scratch_path(spark, "sam")
    FM.write_sam(view(spark, sf, "reads"), path, contigs=[(f"chr{i}", 4_600_000) for i in range(1, 101)])
    return FM.read_sam(spark, path).select("contig", "pos", "flag", "mapq", "cigar")


@register("vcf_roundtrip", duck_with("variants") + "select contig, pos, ref, alt, qual, filter, dp from variants")
def q_vcf(spark, sf):
    path = scratch_path(spark, "vcf")
    FM.write_vcf(view(spark, sf, "variants"), path, info_cols=["dp"])
    v = FM.read_vcf(spark, path)
    return v.select("contig", "pos", "ref", F.col("alts")[0].alias("alt"), "qual", "filter",
                    F.col("info")["DP"].cast("int").alias("dp"))


@register("bed_roundtrip", duck_with("iv_a") + """
select contig, start_pos, end_pos, concat_ws('_', l_orderkey, l_linenumber) as name, strand from iv_a""")
def q_bed(spark, sf):
    a = view(spark, sf, "iv_a").withColumn("name", F.concat_ws("_", "l_orderkey", "l_linenumber")) \
        .withColumn("score", F.lit(0.0))
    path = scratch_path(spark, "bed")
    FM.write_bed(a, path)
    return FM.read_bed(spark, path).select("contig", "start_pos", "end_pos", "name", "strand")


@register("gff_roundtrip", duck_with("gene_models") + """
select contig, start_pos, end_pos, strand, feature, cast(gene_id as varchar) as gene_id from gene_models""")
def q_gff(spark, sf):
    g = view(spark, sf, "gene_models").select(
        "contig", F.lit("fixture").alias("source"), "feature", "start_pos", "end_pos",
        F.lit(None).cast("double").alias("score"), "strand", F.lit(0).alias("phase"),
        F.create_map(F.lit("ID"), F.col("gene_id").cast("string")).alias("attributes"))
    path = scratch_path(spark, "gff")
    FM.write_gff(g, path)
    return FM.read_gff(spark, path).select("contig", "start_pos", "end_pos", "strand", "feature",
                                           F.col("attributes")["ID"].alias("gene_id"))


@register("lines_roundtrip", duck_with("iv_b") + """
select contig || chr(9) || cast(start_pos as varchar) || chr(9) || cast(end_pos as varchar) as value from iv_b""")
def q_lines(spark, sf):
    b = view(spark, sf, "iv_b").select(F.concat_ws("\t", "contig", "start_pos", "end_pos").alias("value"))
    path = scratch_path(spark, "lines")
    FM.write_lines(b, path)
    return FM.read_lines(spark, path)


@register("pipe_lines", duck_with("iv_b") + "select contig, cast(end_pos - start_pos as bigint) as length from iv_b")
def q_pipe_lines(spark, sf):
    b = view(spark, sf, "iv_b").select(F.concat_ws("\t", "contig", "start_pos", "end_pos").alias("value"))
    out = pipe_lines(b, ["awk", "-F\t", '{print $1 "\t" ($3 - $2)}'])
    parts = F.split("value", "\t")
    return out.select(parts[0].alias("contig"), parts[1].cast("bigint").alias("length"))


@register("pipe_groups", duck_with("iv_b") + "select contig, count(*) as n_lines from iv_b group by contig")
def q_pipe_groups(spark, sf):
    b = view(spark, sf, "iv_b").select("contig", "start_pos",
                                       F.concat_ws("\t", "contig", "start_pos", "end_pos").alias("value"))
    out = pipe_groups(b, ["contig"], ["wc", "-l"], order=["start_pos"])
    return out.select("contig", F.trim("value").cast("bigint").alias("n_lines"))


@register("list_files", duck_with("iv_b") + "select distinct 'contig=' || contig as name, true as is_dir from iv_b")
def q_list_files(spark, sf):
    path = scratch_path(spark, "listed")
    b = view(spark, sf, "iv_b").select("contig", F.concat_ws("\t", "start_pos", "end_pos").alias("value"))
    b.repartition("contig").write.partitionBy("contig").text(path)
    return FM.list_files(spark, path).where(~F.col("name").startswith("_")).select("name", "is_dir")


@register("preview_lines", duck_with("iv_b") + """,
n as (select *, row_number() over (order by value) as line_no, count(*) over () as n from (
  select contig || chr(9) || cast(start_pos as varchar) || chr(9) || cast(end_pos as varchar) as value from iv_b) x)
select value, cast(line_no as int) as line_no, n > 20 as truncated from n where line_no <= 20""")
def q_preview_lines(spark, sf):
    path = scratch_path(spark, "preview")
    lines = view(spark, sf, "iv_b").select(F.concat_ws("\t", "contig", "start_pos", "end_pos").alias("value"))
    FM.write_lines(lines.orderBy("value"), path)
    return FM.preview_lines(FM.read_lines(spark, path), 20)


@register("fasta_tiles", duck_with("dna") + """
select cast(seq_id as varchar) as contig, cast(t as int) as tile, substring(seq, cast(t * 700 + 1 as int), 750) as tile_seq
from (select seq_id, seq, unnest(range((length(seq) + 699) // 700)) as t from dna) x""")
def q_fasta_tiles(spark, sf):
    path = scratch_path(spark, "genome")
    FM.write_fasta(view(spark, sf, "dna"), path)
    return FM.fasta_tiles(spark, path, 700, 50)


@register("vcf_genotypes_roundtrip", duck_with("variants") + """
select contig, pos, ref, alt, case when dp % 2 = 0 then 'PASS' end as db, s.sample, case when s.sample = 'S1' then '0/1' else '1|1' end as gt,
  case when s.sample = 'S1' then dp end as depth from variants, (values ('S1'), ('S2')) s(sample)""")
def q_vcf_genotypes(spark, sf):
    path = scratch_path(spark, "genotypes")
    v = view(spark, sf, "variants")
    both = F.array(*[F.struct(F.lit(n).alias("sample"), F.create_map(F.lit("GT"), F.lit(gt), F.lit("DP"), dp).alias("fields"))
                     for n, gt, dp in (("S1", "0/1", F.col("dp").cast("string")), ("S2", "1|1", F.lit(None).cast("string")))])
    flag = F.when(F.col("dp") % 2 == 0, F.create_map(F.lit("DB"), F.lit(None).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    FM.write_vcf(v.select("contig", "pos", "ref", "alt", "qual", "filter", flag.alias("info"), both.alias("genotypes")), path)
    r = FM.read_vcf(spark, path).select("contig", "pos", "ref", F.col("alts")[0].alias("alt"), "info", F.inline("genotypes"))
    return r.select("contig", "pos", "ref", "alt", F.when(F.map_contains_key("info", "DB"), "PASS").alias("db"), "sample",
                    F.col("fields")["GT"].alias("gt"), F.col("fields")["DP"].try_cast("int").alias("depth"))


# molecules written as fixed-width lines, a file each, in three poses
@register("read_atoms", duck_with("atoms") + """
select cast(p as int) as pose_id, atom_id, element, cast(round(x * 1000) + 100 * p as bigint) as x, cast(round(y * 1000) as bigint) as y, cast(round(z * 1000) as bigint) as z
from (select *, unnest([1, 2, 3]) as p from atoms where atom_id < 99999) a""")
def q_read_atoms(spark, sf):
    path = scratch_path(spark, "atoms")
    a = view(spark, sf, "atoms").where("atom_id < 99999").select("*", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("p"))
    line = F.format_string("ATOM  %5d  %-3s LIG A   1    %8.3f%8.3f%8.3f  1.00  0.00          %2s", F.col("atom_id").cast("int"), "element",
                           F.round(F.col("x") * 1000) / 1000 + F.col("p") * 0.1, F.round(F.col("y") * 1000) / 1000, F.round(F.col("z") * 1000) / 1000, "element")
    heads = a.select("mol_id", "p").distinct().select("mol_id", "p", F.lit(-1).cast("bigint").alias("atom_id"), F.format_string("MODEL     %4d", "p").alias("value"))
    lines = a.select("mol_id", "p", "atom_id", line.alias("value")).unionByName(heads)
    lines.repartition("mol_id").sortWithinPartitions("mol_id", "p", "atom_id").select("mol_id", "value").write.partitionBy("mol_id").text(path)
    r = FM.read_atoms(spark, path)
    return r.select("pose_id", F.col("atom_id").cast("bigint").alias("atom_id"), "element",
                    *[F.round(F.col(c) * 1000).cast("bigint").alias(c) for c in ("x", "y", "z")])
