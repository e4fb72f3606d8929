"""Registered queries: validators (B1-B5) and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reads as R
from ..functions import seq as S
from ..functions import stats as ST
from ..functions import validate as V
from ..operators.kmers import kmer_rows
from ..operators.variants import classify_variants
from ..sources.fixtures import duck_with, view
from . import register

WS = "chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def _duck_check(norm: str, alphabet: str, kind: str, max_len: int | None, tail: str) -> str:
    too_long = (f"when length({norm}) > {max_len} then '{kind} sequence too long (' || "
                f"cast(length({norm}) as varchar) || ' chars, max {max_len}).' ") if max_len else ""
    return (f"case when length({norm}) = 0 then '{kind} sequence is empty.' {too_long}"
            f"when length(regexp_replace({norm}, '[{alphabet}]', '', 'g')) > 0 then "
            f"'Invalid {{k}} characters: ' || array_to_string(list_sort(list_distinct(string_split("
            f"regexp_replace({norm}, '[{alphabet}]', '', 'g'), ''))), ', ') || '{tail}' end")


def _seq_validator_sql(table: str, alphabet: str, kind: str, kword: str,
                       max_len: int | None, tail: str, col: str = "seq", key: str = "seq_id") -> str:
    check = _duck_check("norm", alphabet, kind, max_len, tail).replace("{k}", kword)
    return (duck_with(table) +
            # Java/Python upper-case sharp s as 'SS'; DuckDB keeps one letter
            f", t as (select {key}, upper(replace(trim({col}, {WS}), 'ß', 'SS')) as norm from {table})\n"
            f"select {key}, case when err is null then norm end as normalized, err as error from "
            f"(select {key}, norm, {check} as err from t)")


@register("validate_rna", _seq_validator_sql("raw_rna", "ACGU", "RNA", "RNA", 10000,
                                             ". Expected only A, C, G, U."))
def q_validate_rna(spark, sf):
    return V.validate_rna(view(spark, sf, "raw_rna")).select("seq_id", "normalized", "error")


@register("validate_protein", _seq_validator_sql("raw_rna", r"ACDEFGHIKLMNPQRSTVWYX*\-", "Protein",
                                                 "protein", None, "."))
def q_validate_protein(spark, sf):
    return V.validate_protein(view(spark, sf, "raw_rna")).select("seq_id", "normalized", "error")


@register("validate_dna", _seq_validator_sql("raw_rna", "ACGTN", "DNA", "DNA", None, "."))
def q_validate_dna(spark, sf):
    return V.validate_dna(view(spark, sf, "raw_rna")).select("seq_id", "normalized", "error")


@register("validate_smiles", duck_with("smiles_like") + r"""
, t as (select p_partkey, trim(smiles, """ + WS + r""") as s from smiles_like)
select p_partkey, case when err is null then s end as normalized, err as error from (
  select p_partkey, s, case when length(s) = 0 then 'SMILES string is empty.'
    when not regexp_full_match(s, '[A-Za-z0-9@+\-\[\]\(\)\\/%=#$.,~!:]+') then 'Invalid SMILES string format.'
  end as err from t)""")
def q_validate_smiles(spark, sf):
    return V.validate_smiles(view(spark, sf, "smiles_like")).select("p_partkey", "normalized", "error")


_GENOME_PICK = "element_at(array('hg38','hg19','mm10','mm39','ce11','dm6','sacCer3','potato','HG38'), cast(p_partkey % 9 as int) + 1)"


@register("validate_genome", f"""
select p_partkey, case when g in ('hg38','hg19','mm10','mm39','ce11','dm6','sacCer3') then g end as normalized,
  case when g not in ('hg38','hg19','mm10','mm39','ce11','dm6','sacCer3')
  then 'Unknown genome: ' || g || '. Supported: ce11, dm6, hg19, hg38, mm10, mm39, sacCer3' end as error
from (select p_partkey, {_GENOME_PICK.replace('element_at(array(', 'list_extract([').replace("'HG38'), cast", "'HG38'], cast")} as g from part)""")
def q_validate_genome(spark, sf):
    part = view(spark, sf, "part").select("p_partkey", F.expr(_GENOME_PICK).alias("genome"))
    return V.validate_genome(part).select("p_partkey", "normalized", "error")


@register("revcomp_gc", duck_with("dna") + """
select seq_id, reverse(translate(seq, 'ACGTNUacgtnu', 'TGCANAtgcana')) as rc,
  round(case when length(seq) = 0 then null else
    cast(length(regexp_replace(seq, '[^GCgc]', '', 'g')) as double) / length(seq) end, 6) as gc,
  translate(seq, 'Tt', 'Uu') as rna,
  translate(translate(seq, 'Tt', 'Uu'), 'Uu', 'Tt') = seq as roundtrip
from dna""")
def q_revcomp_gc(spark, sf):
    d = view(spark, sf, "dna")
    return d.select("seq_id", S.revcomp(F.col("seq")).alias("rc"),
                    F.round(S.gc_fraction(F.col("seq")), 6).alias("gc"),
                    S.to_rna(F.col("seq")).alias("rna"),
                    (S.to_dna(S.to_rna(F.col("seq"))) == F.col("seq")).alias("roundtrip"))


@register("kmers", duck_with("dna") + """
select seq_id, cast(i - 1 as int) as pos, substring(seq, cast(i as int), 8) as kmer
from (select seq_id, seq, unnest(generate_series(1, length(seq) - 7)) as i from dna where length(seq) >= 8)""")
def q_kmers(spark, sf):
    d = view(spark, sf, "dna")
    return kmer_rows(d.select("seq_id", "seq"), "seq", 8)


_CODON_SQL = """
codon_table as (
  select substring('TCAG', cast(i // 16 as int) + 1, 1) || substring('TCAG', cast((i // 4) % 4 as int) + 1, 1)
         || substring('TCAG', cast(i % 4 as int) + 1, 1) as codon,
         substring('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', cast(i as int) + 1, 1) as aa
  from range(64) t(i))"""


@register("translate_codons", duck_with("dna") + "," + _CODON_SQL + """,
frames as (select seq_id, seq, f as frame from dna, range(3) r(f)),
cods as (select seq_id, frame, j, substring(upper(seq), cast(frame + j * 3 + 1 as int), 3) as codon
         from (select seq_id, seq, frame, unnest(generate_series(0, (length(seq) - frame) // 3 - 1)) as j
               from frames where (length(seq) - frame) // 3 >= 1))
select f.seq_id, cast(f.frame as int) as frame, coalesce(p.protein, '') as protein
from frames f left join (
  select c.seq_id, c.frame, string_agg(coalesce(t.aa, 'X'), '' order by c.j) as protein
  from cods c left join codon_table t on t.codon = c.codon group by c.seq_id, c.frame) p
on p.seq_id = f.seq_id and p.frame = f.frame""")
def q_translate_codons(spark, sf):
    d = view(spark, sf, "dna").withColumn("frame", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    return d.select("seq_id", "frame", S.translate_codons(F.col("seq"), F.col("frame")).alias("protein"))


@register("flag_bits", duck_with("reads") + """
select l_orderkey, l_linenumber, flag, (flag & 1) != 0 as paired, (flag & 16) != 0 as reverse,
  (flag & 64) != 0 as read1, (flag & 4) = 0 as mapped, (flag & 1024) != 0 as duplicate from reads""")
def q_flag_bits(spark, sf):
    r = view(spark, sf, "reads")
    f = F.col("flag")
    return r.select("l_orderkey", "l_linenumber", "flag",
                    R.flag_has(f, R.PAIRED).alias("paired"), R.flag_has(f, R.REVERSE).alias("reverse"),
                    R.flag_has(f, R.READ1).alias("read1"), R.flag_lacks(f, R.UNMAPPED).alias("mapped"),
                    R.flag_has(f, R.DUPLICATE).alias("duplicate"))


CIGAR_BLOCKS_SQL = """
ops as (select rid, pos, cigar, op, k, cast(left(op, length(op) - 1) as bigint) as len, right(op, 1) as code
        from (select rid, pos, cigar, unnest(regexp_extract_all(cigar, '(\\d+[MIDNSHP=X])', 1)) as op,
                     unnest(generate_series(1, len(regexp_extract_all(cigar, '(\\d+[MIDNSHP=X])', 1)))) as k
              from {src})),
offs as (select *, coalesce(sum(case when code in ('M','D','N','=','X') then len else 0 end)
           over (partition by rid order by k rows between unbounded preceding and 1 preceding), 0) as ref_off,
         coalesce(sum(case when code in ('M','I','S','=','X') then len else 0 end)
           over (partition by rid order by k rows between unbounded preceding and 1 preceding), 0) as read_off
         from ops),
blocks as (select rid, pos, cigar, ref_off, read_off, len from offs where code in ('M','=','X'))"""


@register("cigar_blocks", duck_with("reads") + """,
rr as (select row_number() over () as rid, * from reads), """ + CIGAR_BLOCKS_SQL.replace("{src}", "rr") + """,
reflen as (select rid, cast(sum(case when code in ('M','D','N','=','X') then len else 0 end) as bigint) as ref_len from ops group by rid)
select r.l_orderkey, r.l_linenumber, r.cigar, cast(l.ref_len as bigint) as ref_len,
  cast(r.pos - 1 + b.ref_off as bigint) as ref_start, cast(b.read_off as bigint) as read_off, cast(b.len as bigint) as len
from rr r join blocks b on b.rid = r.rid join reflen l on l.rid = r.rid""")
def q_cigar_blocks(spark, sf):
    r = view(spark, sf, "reads")
    x = r.select("l_orderkey", "l_linenumber", "cigar", "pos",
                 R.cigar_ref_len(F.col("cigar")).alias("ref_len"),
                 F.explode(R.cigar_blocks(F.col("cigar"))).alias("b"))
    return x.select("l_orderkey", "l_linenumber", "cigar", "ref_len",
                    (F.col("pos") - 1 + F.col("b.ref_off")).alias("ref_start"),
                    F.col("b.read_off").alias("read_off"), F.col("b.len").alias("len"))


@register("variant_kind", duck_with("variants") + """
select contig, pos, ref, alt, case when length(ref) = 1 and length(alt) = 1 then 'SNV'
  when length(ref) = length(alt) then 'MNV' when length(alt) > length(ref) then 'INS' else 'DEL' end as kind,
  case when length(ref) = 1 and length(alt) = 1 then upper(ref) || upper(alt) in ('AG','GA','CT','TC') end as transition
from variants""")
def q_variant_kind(spark, sf):
    return classify_variants(view(spark, sf, "variants")).select("contig", "pos", "ref", "alt", "kind", "transition")


_GCODE = "element_at(array('hs','mm','ce','dm','1e9','2.5e6','x'), cast(p_partkey % 7 as int) + 1)"


@register("effective_genome_size", f"""
select p_partkey, g as code, case g when 'hs' then 2.7e9 when 'mm' then 1.87e9 when 'ce' then 9.0e7
  when 'dm' then 1.2e8 else try_cast(g as double) end as size
from (select p_partkey, list_extract(['hs','mm','ce','dm','1e9','2.5e6','x'], cast(p_partkey % 7 as int) + 1) as g from part)""")
def q_effective_genome_size(spark, sf):
    p = view(spark, sf, "part").select("p_partkey", F.expr(_GCODE).alias("code"))
    return p.select("p_partkey", "code", ST.effective_genome_size(F.col("code")).cast("double").alias("size"))
