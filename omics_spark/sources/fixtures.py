"""Fixture views: biological record tables derived from the driver tables.

Each view is one SQL text shared by Spark (``spark.sql`` with DataFrame
arguments) and the DuckDB oracle (as a CTE), so both engines see the same
rows. Table references are written ``{name}``; ``{S}`` is the string type
and ``{G}`` the global-replace flag, which differ between the engines.
All coordinates: intervals 0-based half-open, reads and variants 1-based.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_DNA_EXPR = ("translate(regexp_replace(lower(text), '[^a-z]', ''{G}), "
             "'abcdefghijklmnopqrstuvwxyz', 'ACGTCAGATTACGCATGACCTGTCGA')")
_PROT_EXPR = ("translate(regexp_replace(lower(text), '[^a-z]', ''{G}), "
              "'abcdefghijklmnopqrstuvwxyz', 'ACDEFGHIKLMNPQRSTVWYAEGLKS')")

# name -> (sql template, dependencies)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "iv_a": ("""
select concat('chr', cast(l_suppkey as {S})) as contig,
  (l_partkey * 39709 + l_orderkey * 3101 + l_linenumber * 70001) % 4500000 as start_pos,
  (l_partkey * 39709 + l_orderkey * 3101 + l_linenumber * 70001) % 4500000 + cast(l_quantity as bigint) * 40 as end_pos,
  case when l_returnflag = 'R' then '-' else '+' end as strand, l_orderkey, l_linenumber from {lineitem}""",
             ("lineitem",)),
    "iv_b": ("""
select concat('chr', cast(o_custkey % (select count(*) from {supplier}) + 1 as {S})) as contig, (o_orderkey * 61001) % 4500000 as start_pos,
  (o_orderkey * 61001) % 4500000 + 500 + o_custkey % 4000 as end_pos, o_orderkey as b_id from {orders}""",
             ("orders", "supplier")),
    "variants": ("""
select concat('chr', cast(o_custkey % (select count(*) from {supplier}) + 1 as {S})) as contig, (o_orderkey * 61001) % 4500000 + 1 as pos,
  substring('ACGT', cast(o_orderkey % 4 as int) + 1, 1) as ref, substring('CGTA', cast(o_orderkey % 4 as int) + 1, 1) as alt,
  case when o_orderkey % 17 = 0 then null else cast(floor(o_totalprice / 10000) as double) end as qual,
  case when o_orderstatus = 'F' then 'PASS' else 'LowQual' end as filter, cast(o_custkey % 60 as int) as dp from {orders}""",
                 ("orders", "supplier")),
    "reads": ("""
select l_orderkey, l_linenumber, concat('chr', cast(l_suppkey as {S})) as contig,
  (l_partkey * 39709 + l_orderkey * 3101 + l_linenumber * 70001) % 4500000 + 1 as pos,
  cast(1 + case when l_returnflag = 'R' then 16 else 0 end + case when l_linenumber % 2 = 0 then 64 else 128 end
    + case when l_orderkey % 23 = 0 then 4 else 2 end + case when l_partkey % 29 = 0 then 1024 else 0 end as int) as flag,
  cast(l_quantity as int) as mapq,
  case when l_linenumber = 3 then '20M5D30M' when l_linenumber = 4 then '10S40M' else '50M' end as cigar from {lineitem}""",
              ("lineitem",)),
    "pairs": ("""
select concat('q', cast(o_orderkey as {S})) as qname, concat('chr', cast(o_custkey % (select count(*) from {supplier}) + 1 as {S})) as contig,
  (o_orderkey * 61001) % 4500000 + 1 as pos,
  cast(65 + case when o_orderkey % 89 = 0 then 0 else 32 end as int) as flag,
  concat('chr', cast((o_custkey + case when o_orderkey % 211 = 0 then 1 else 0 end) % (select count(*) from {supplier}) + 1 as {S})) as rnext,
  (o_orderkey * 61001) % 4500000 + 301 + case when o_orderkey % 97 = 0 then 5000 else 0 end as pnext, o_orderkey from {orders}""",
              ("orders", "supplier")),
    "regions": ("""
select concat('chr', cast(p_partkey % (select count(*) from {supplier}) + 1 as {S})) as contig, (p_partkey * 46301) % 4500000 as start_pos,
  (p_partkey * 46301) % 4500000 + 500 + p_size * 10 as end_pos, p_partkey as region_id, p_type as feature from {part}""",
                ("part", "supplier")),
    "dna": ("select doc_id as seq_id, " + _DNA_EXPR + " as seq from {documents}",
            ("documents",)),
    "protein": ("select doc_id as seq_id, " + _PROT_EXPR + " as seq from {documents}",
                ("documents",)),
    # a library of short queries against the documents
    "query_dna": ("select item_id as seq_id, " + _DNA_EXPR + " as seq from {benchmark}", ("benchmark",)),
    "query_protein": ("select item_id as seq_id, " + _PROT_EXPR + " as seq from {benchmark}", ("benchmark",)),
    "rna": ("select seq_id, translate(seq, 'T', 'U') as seq from {dna} where length(seq) > 0",
            ("dna",)),
    "raw_rna": ("""
select doc_id as seq_id, case when doc_id % 5 = 0 then '' when doc_id % 5 = 1 then text
  when doc_id % 5 = 2 then concat('  ', lower(""" + _DNA_EXPR + """), ' ')
  else translate(""" + _DNA_EXPR + """, 'T', 'U') end as seq from {documents}""",
                ("documents",)),
    # the whole protein in lines of 60 letters, the last one filled with gaps
    "aligned": ("""
select {DIV} as family, seq_id * 100000 + n as seq_id, rpad(line, 60, '-') as seq from {protein_lines}""",
                ("protein_lines",)),
    "planted_reads": ("""
select l_orderkey, l_linenumber, l_partkey, seq_id as true_id, p as true_pos, substring(seq, cast(p as int) + 1, 50) as seq
from (select l.l_orderkey, l.l_linenumber, l.l_partkey, d.seq_id, d.seq,
        (l.l_orderkey * 7919 + l.l_linenumber * 3167) % (length(d.seq) - 49) as p
      from (select *, l_partkey % (select max(doc_id) + 1 from {documents}) as sid from {lineitem}) l
      join {dna} d on d.seq_id = l.sid where length(d.seq) >= 50) x""",
                      ("lineitem", "dna", "documents")),
    # one window a contig, anywhere in it, that the reads pile up on
    "windows": ("select seq_id, seq, cast((seq_id * 7919) % (length(seq) - 259) as bigint) as ws from {dna} where length(seq) >= 260",
                ("dna",)),
    "sample_reads": ("""
select case when l_linestatus = 'F' then 'tumor' else 'normal' end as sample, concat('s', cast(seq_id as {S})) as contig,
  ws + p + 1 as pos, cast(case when l_returnflag = 'R' then 16 else 0 end as int) as flag, cast(l_quantity as int) as mapq, '50M' as cigar,
  case when l_linestatus = 'F' and l_orderkey % 3 = 0 and p between 81 and 130
    then concat(substring(s, 1, cast(130 - p as int)), translate(substring(s, cast(131 - p as int), 1), 'ACGT', 'CGTA'),
                substring(s, cast(132 - p as int), 50)) else s end as seq,
  repeat('I', 50) as qual, l_orderkey, l_linenumber, l_partkey
from (select l.*, d.seq_id, d.ws, cast(l.l_quantity as bigint) * 3 as p,
        substring(d.seq, cast(d.ws + l.l_quantity * 3 + 1 as int), 50) as s
      from (select *, l_partkey % (select max(doc_id) + 1 from {documents}) as sid from {lineitem}) l
      join {windows} d on d.seq_id = l.sid) x""",
                     ("lineitem", "windows", "documents")),
    # the same reads, some of the tumor over the site with two letters taken
    # out or three put in, at any of the places that mean the same
    "indel_reads": ("""
select sample, contig, pos, flag, mapq, l_orderkey, l_linenumber, l_partkey,
  case when kind = 1 then concat(substring(seq, 1, cast(cut as int)), substring(seq, cast(cut + 3 as int), 50))
    when kind = 2 then concat(substring(seq, 1, cast(cut as int)), 'GAT', substring(seq, cast(cut + 1 as int), 50)) else seq end as seq,
  case when kind = 1 then concat(cast(cut as {S}), 'M2D', cast(length(seq) - cut - 2 as {S}), 'M')
    when kind = 2 then concat(cast(cut as {S}), 'M3I', cast(length(seq) - cut as {S}), 'M') else cigar end as cigar,
  repeat('I', cast(length(seq) + case when kind = 1 then -2 when kind = 2 then 3 else 0 end as int)) as qual
from (select r.*, w.ws + 125 + l_orderkey % 3 - (pos - 1) as cut,
        case when sample = 'tumor' and pos - 1 < w.ws + 115 and pos - 1 + 50 > w.ws + 140 then l_linenumber % 3 else 0 end as kind
      from {sample_reads} r join {windows} w on concat('s', cast(w.seq_id as {S})) = r.contig) x""",
                    ("sample_reads", "windows")),
    "gene_models": ("""
select concat('s', cast(seq_id as {S})) as contig, seq_id as gene_id, ws + 30 as start_pos, ws + 210 as end_pos,
  case when seq_id % 2 = 0 then '+' else '-' end as strand, 'CDS' as feature from {windows}""",
                    ("windows",)),
    # our addition: SNVs at and around the planted site (in the CDS), one
    # intergenic SNV and one 1-base deletion per sequence, refs from the genome
    "effect_variants": ("""
select concat('s', cast(seq_id as {S})) as contig, ws + 131 + seq_id % 3 as pos,
  substring(seq, cast(ws + 131 + seq_id % 3 as int), 1) as ref,
  translate(substring(seq, cast(ws + 131 + seq_id % 3 as int), 1), 'ACGT', 'CGTA') as alt from {windows}
union all
select concat('s', cast(seq_id as {S})) as contig, ws + 251 as pos, substring(seq, cast(ws + 251 as int), 1) as ref,
  translate(substring(seq, cast(ws + 251 as int), 1), 'ACGT', 'TACG') as alt from {windows}
union all
select concat('s', cast(seq_id as {S})) as contig, ws + 100 as pos, substring(seq, cast(ws + 100 as int), 2) as ref,
  substring(seq, cast(ws + 100 as int), 1) as alt from {windows}""",
                        ("windows",)),
    # genes of three coding parts whose lengths cut codons in two
    "exon_models": (" union all ".join(f"""
select concat('s', cast(seq_id as {{S}})) as contig, seq_id as gene_id, ws + {a} as start_pos, ws + {b} as end_pos,
  case when seq_id % 2 = 0 then '+' else '-' end as strand, '{feature}' as feature from {{windows}}"""
                                   for a, b, feature in ((20, 230, "gene"), (30, 91, "CDS"), (101, 160, "CDS"), (165, 210, "CDS"))),
                    ("windows",)),
    "exon_variants": (" union all ".join(f"""
select concat('s', cast(seq_id as {{S}})) as contig, ws + {at + 1} as pos, substring(seq, cast(ws + {at + 1} as int), 1) as ref,
  translate(substring(seq, cast(ws + {at + 1} as int), 1), 'ACGT', '{to}') as alt from {{windows}}"""
                                     for at, to in ((30, "CGTA"), (89, "TACG"), (90, "CGTA"), (95, "TACG"), (101, "CGTA"), (102, "GTAC"),
                                                    (131, "CGTA"), (158, "TACG"), (159, "CGTA"), (165, "GTAC"), (209, "CGTA"), (240, "CGTA"))),
                      ("windows",)),
    "split_pairs": ("""
select o_orderkey, case when o_orderkey % 101 = 0 then concat('chr', cast((o_custkey + case when o_orderkey % 2 = 0 then 2 else 0 end) % (select count(*) from {supplier}) + 1 as {S}), ',',
  cast((o_orderkey * 61001) % 4500000 + 2001 as {S}), ',+,25S25M,60,0;') else null end as sa from {orders}""",
                    ("orders", "supplier")),
    # read pairs and split reads round planted events: deletions, inversions,
    # pairs of contigs seen from either side, and events that share one end
    "sv_reads": ("""
select concat('q', cast(l_orderkey as {S}), '_', cast(l_linenumber as {S}), '_', cast(l_partkey as {S})) as qname,
  concat('chr', cast(case when ev % 5 = 2 and l_linenumber % 2 = 0 then ctg + 1 else ctg end as {S})) as contig,
  case when ev % 5 = 2 and l_linenumber % 2 = 0 then p + far else p end as pos, cast(case when ev % 5 = 1 then 65 else 97 end as int) as flag,
  concat('chr', cast(case when ev % 5 = 2 and l_linenumber % 2 = 1 then ctg + 1 else ctg end as {S})) as rnext,
  case when ev % 5 = 2 and l_linenumber % 2 = 0 then p when l_partkey % 3 = 0 then p + far else p + 300 end as pnext,
  case when l_partkey % 3 = 1 and l_orderkey % 11 = 0 and ev % 5 != 2 then concat('chr', cast(ctg as {S}), ',', cast(p + far as {S}),
    case when ev % 5 = 1 then ',-' else ',+' end, ',25S25M,60,0;') end as sa
from (select *, l_partkey % 13 as ev, l_suppkey % 20 as ctg, 100000 + (l_partkey % 13) * 300000 + cast(l_quantity as bigint) * 7 as p,
        case when l_partkey % 13 % 5 = 3 and l_orderkey % 2 = 1 then 9000 else 3000 end + (l_orderkey % 40) * 5 as far from {lineitem}) x
where l_partkey % 13 % 5 != 2 or l_partkey % 3 = 0""",
                  ("lineitem",)),
    "motif_seqs": ("""
select seq_id, case when seq_id % 3 = 0 then 'target' else 'background' end as grp,
  case when seq_id % 3 = 0 then concat(substring(seq, 1, 50), 'ACGTTGCA', substring(seq, 59, length(seq))) else seq end as seq
from {dna}""",
                   ("dna",)),
    "chip_tags": ("""
select case when l_linenumber % 2 = 0 then 'treatment' else 'control' end as sample,
  concat('chr', cast(l_suppkey as {S})) as contig,
  case when l_linenumber % 2 = 0 and l_orderkey % 2 = 0 then (l_partkey % 4) * 1100000 + cast(l_quantity as bigint) * 4
    else (l_partkey * 39709 + l_orderkey * 3101 + l_linenumber * 70001) % 4500000 end as start_pos,
  case when l_returnflag = 'R' then '-' else '+' end as strand, l_orderkey, l_linenumber, l_partkey from {lineitem}""",
                  ("lineitem",)),
    # tags on the contigs of the genome: a planted site a contig, the rest anywhere
    "site_tags": ("""
select case when l_linenumber % 2 = 0 then 'treatment' else 'control' end as sample, concat('s', cast(seq_id as {S})) as contig,
  case when l_linenumber % 2 = 0 and l_orderkey % 3 > 0 then ws + 130 + cast(l_quantity as bigint)
    else (l_partkey * 39709 + l_orderkey * 3101 + l_linenumber * 70001) % length(seq) end as start_pos,
  case when l_returnflag = 'R' then '-' else '+' end as strand, l_orderkey, l_linenumber, l_partkey
from (select *, l_partkey % (select max(doc_id) + 1 from {documents}) as sid from {lineitem}) l
join {windows} d on d.seq_id = l.sid""",
                  ("lineitem", "windows", "documents")),
    "smiles_like": ("""
select p_partkey, case when p_partkey % 3 = 0 then concat(' CC(=O)Oc1ccccc1C(=O)O', substring('NOS', cast(p_partkey % 2 as int) + 1, 1))
  when p_partkey % 3 = 1 then p_name else '' end as smiles from {part}""",
                    ("part",)),
    "pvals": ("select o_orderkey as id, cast(o_custkey % 997 + 1 as double) / 1000 as p, o_custkey % 3 as grp from {orders}",
              ("orders",)),
    "atoms": ("""
select label as mol_id, vec_id as atom_id, substring('CNOS', cast(vec_id % 4 as int) + 1, 1) as element,
  cast({E0} as double) * 60 as x, cast({E1} as double) * 60 as y, cast({E2} as double) * 60 as z
from {embeddings}""",
              ("embeddings",)),
}

_PIXELS_SPARK = """
select cast(floor(vec_id / 64) as bigint) as image_id, cast(vec_id % 64 as int) as y, i as x, cast(v as double) as value
from (select vec_id, posexplode(embedding) as (i, v) from {embeddings})"""
_PIXELS_DUCK = """
select cast(floor(vec_id / 64) as bigint) as image_id, cast(vec_id % 64 as int) as y, cast(i - 1 as int) as x,
  cast(embedding[i] as double) as value
from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from {embeddings})"""
_LINES_SPARK = """
select seq_id, n, line from (select seq_id, posexplode(regexp_extract_all(seq, '.{{1,60}}', 0)) as (n, line) from {protein})"""
_LINES_DUCK = """
select seq_id, cast(i - 1 as int) as n, substring(seq, cast(60 * (i - 1) + 1 as int), 60) as line
from (select seq_id, seq, unnest(range(1, (length(seq) + 59) // 60 + 1)) as i from {protein}) x"""
_RNAS_SPARK = """
select seq_id * 100000 + n as seq_id, line as seq from (select seq_id, posexplode(regexp_extract_all(seq, '.{{1,400}}', 0)) as (n, line) from {rna})"""
_RNAS_DUCK = """
select seq_id * 100000 + i - 1 as seq_id, substring(seq, cast(400 * (i - 1) + 1 as int), 400) as seq
from (select seq_id, seq, unnest(range(1, (length(seq) + 399) // 400 + 1)) as i from {rna}) x"""
# name -> (Spark SQL, DuckDB SQL, dependencies) of views that each engine words its own way
OWN = {"pixels": (_PIXELS_SPARK, _PIXELS_DUCK, ("embeddings",)),
       "protein_lines": (_LINES_SPARK, _LINES_DUCK, ("protein",)),
       # whole texts as RNAs of 400 letters
       "short_rna": (_RNAS_SPARK, _RNAS_DUCK, ("rna",))}


def _site(at: int, to: str, length: int = 1) -> str:
    """A variant ``at`` letters into the window: ``to`` names the letters for ACGT."""
    ref = f"substring(seq, cast(ws + {at + 1} as int), {length})"
    alt = f"translate({ref}, 'ACGT', '{to}')" if length == 1 else f"substring(seq, cast(ws + {at + 1} as int), 1)"
    return f"struct(ws + {at + 1} as pos, {ref} as ref, {alt} as alt)"


_CONTIG = "concat('s', cast(seq_id as string)) as contig"
_SITES = ((30, "CGTA"), (89, "TACG"), (90, "CGTA"), (95, "TACG"), (101, "CGTA"), (102, "GTAC"),
          (131, "CGTA"), (158, "TACG"), (159, "CGTA"), (165, "GTAC"), (209, "CGTA"), (240, "CGTA"))
_PARTS = ((20, 230, "gene"), (30, 91, "CDS"), (101, 160, "CDS"), (165, 210, "CDS"))
# views that are unions over one table, for Spark from one scan of it: the same rows
ONE_SCAN = {
    "exon_variants": f"select {_CONTIG}, inline(array({', '.join(_site(*x) for x in _SITES)})) from {{windows}}",
    "exon_models": f"""
select contig, gene_id, start_pos, end_pos, strand, feature from (select {_CONTIG}, seq_id as gene_id, case when seq_id % 2 = 0 then '+' else '-' end as strand,
  inline(array({', '.join(f"struct(ws + {a} as start_pos, ws + {b} as end_pos, '{f}' as feature)" for a, b, f in _PARTS)})) from {{windows}})""",
    "effect_variants": f"""
select {_CONTIG}, inline(array({_site(130, "CGTA").replace("ws + 131", "ws + 131 + seq_id % 3")}, {_site(250, "TACG")}, {_site(99, "", 2)})) from {{windows}}""",
}


def _deps(name: str) -> tuple[str, ...]:
    return OWN[name][2] if name in OWN else VIEWS[name][1]


def _text(name: str, engine: str) -> str:
    spark = engine == "spark"
    body = OWN[name][0 if spark else 1] if name in OWN else VIEWS[name][0]
    body = ONE_SCAN.get(name, body) if spark else body
    subs = {
        "{S}": "string" if spark else "varchar",
        "{G}": "" if spark else ", 'g'",
        "{DIV}": "seq_id div 20" if spark else "seq_id // 20",
        "{E0}": "embedding[0]" if spark else "embedding[1]",
        "{E1}": "embedding[1]" if spark else "embedding[2]",
        "{E2}": "embedding[2]" if spark else "embedding[3]",
    }
    for k, v in subs.items():
        body = body.replace(k, v)
    return body.strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read from ``{sf_dir}/{name}.parquet``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str,
         _memo: dict | None = None) -> DataFrame:
    """Build fixture view ``name`` (recursively building what it reads)."""
    memo = {} if _memo is None else _memo
    if name in memo:
        return memo[name]
    if name in BASE_TABLES:
        df = table(spark, sf_dir, name)
    else:
        args = {d: view(spark, sf_dir, d, memo) for d in _deps(name)}
        df = spark.sql(_text(name, "spark"), **args)
    memo[name] = df
    return df


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in BASE_TABLES or n in out:
            return
        for d in _deps(n):
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def duck_with(*names: str) -> str:
    """``WITH`` clause defining the named fixture views for DuckDB."""
    parts = []
    for n in _order(list(names)):
        body = _text(n, "duckdb")
        for t in [*BASE_TABLES, *VIEWS, *OWN]:
            body = body.replace("{" + t + "}", t)
        parts.append(f"{n} as (\n{body}\n)")
    return "with " + ",\n".join(parts) + "\n"
