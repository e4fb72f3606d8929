"""Alignment-record scalar functions (F4, F5, F11) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SAM flag bits.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED = 1, 2, 4, 8
REVERSE, MATE_REVERSE, READ1, READ2 = 16, 32, 64, 128
SECONDARY, QCFAIL, DUPLICATE, SUPPLEMENTARY = 256, 512, 1024, 2048

CIGAR_OP = r"(\d+[MIDNSHP=X])"
REF_OPS = "MDN=X"      # consume the reference
READ_OPS = "MIS=X"     # consume the read
ALIGNED_OPS = "M=X"    # aligned blocks


def flag_has(flag: Column, bit: int) -> Column:
    return (flag.bitwiseAND(F.lit(bit)) != 0)


def flag_lacks(flag: Column, bit: int) -> Column:
    return (flag.bitwiseAND(F.lit(bit)) == 0)


def cigar_ops(cigar: Column) -> Column:
    """array<struct<len:bigint, op:string>> in CIGAR order ('*' -> empty)."""
    ops = F.regexp_extract_all(cigar, F.lit(CIGAR_OP), 1)
    return F.transform(ops, lambda o: F.struct(
        F.substring(o, 1, F.length(o) - 1).cast("bigint").alias("len"),
        F.substring(o, -1, 1).alias("op")))


def _advance(op: Column, consuming: str) -> Column:
    return op.isin(*list(consuming))


def cigar_ref_len(cigar: Column) -> Column:
    """Reference span: sum of M D N = X lengths (50M -> 50, 20M5D30M -> 55)."""
    return F.aggregate(cigar_ops(cigar), F.lit(0).cast("bigint"),
                       lambda acc, o: acc + F.when(_advance(o["op"], REF_OPS), o["len"])
                       .otherwise(F.lit(0).cast("bigint")))


def cigar_blocks(cigar: Column) -> Column:
    """Aligned blocks: array<struct<ref_off, read_off, len>> (0-based offsets
    from the alignment start and from the first read base)."""
    ops = cigar_ops(cigar)
    zero = F.lit(0).cast("bigint")

    def before(i: Column, consuming: str) -> Column:
        return F.aggregate(F.slice(ops, 1, i), zero,
                           lambda acc, o: acc + F.when(_advance(o["op"], consuming), o["len"])
                           .otherwise(zero))

    indexed = F.transform(ops, lambda o, i: F.struct(
        o["op"].alias("op"), o["len"].alias("len"),
        before(i, REF_OPS).alias("ref_off"), before(i, READ_OPS).alias("read_off")))
    kept = F.filter(indexed, lambda b: _advance(b["op"], ALIGNED_OPS))
    return F.transform(kept, lambda b: F.struct(b["ref_off"].alias("ref_off"),
                                                b["read_off"].alias("read_off"),
                                                b["len"].alias("len")))


def cigar_indels(cigar: Column) -> Column:
    """Insertions and deletions: array<struct<op, len, ref_off, read_off>>
    (offsets of the first letter they concern, as in :func:`cigar_blocks`)."""
    ops = cigar_ops(cigar)
    zero = F.lit(0).cast("bigint")

    def before(i: Column, consuming: str) -> Column:
        return F.aggregate(F.slice(ops, 1, i), zero,
                           lambda acc, o: acc + F.when(_advance(o["op"], consuming), o["len"]).otherwise(zero))

    indexed = F.transform(ops, lambda o, i: F.struct(o["op"].alias("op"), o["len"].alias("len"),
                                                     before(i, REF_OPS).alias("ref_off"), before(i, READ_OPS).alias("read_off")))
    return F.filter(indexed, lambda b: b["op"].isin("I", "D"))


def variant_kind(ref: Column, alt: Column) -> Column:
    """SNV / MNV / INS / DEL from allele lengths."""
    lr, la = F.length(ref), F.length(alt)
    return (F.when((lr == 1) & (la == 1), "SNV")
            .when(lr == la, "MNV")
            .when(la > lr, "INS")
            .otherwise("DEL"))


def is_transition(ref: Column, alt: Column) -> Column:
    """Purine<->purine or pyrimidine<->pyrimidine SNV; null if not an SNV."""
    pair = F.concat(F.upper(ref), F.upper(alt))
    return F.when((F.length(ref) == 1) & (F.length(alt) == 1),
                  pair.isin("AG", "GA", "CT", "TC"))
