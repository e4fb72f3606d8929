"""Sequence scalar functions (F1-F3, F7) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base complement and the standard genetic code.
COMPLEMENT_FROM = "ACGTNUacgtnu"
COMPLEMENT_TO = "TGCANAtgcana"
BASES = "TCAG"
# Standard code (NCBI table 1), codons ordered TTT TTC TTA TTG TCT ... GGG.
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def codon_table() -> dict[str, str]:
    """The 64 codons -> amino acid letter, built from the code string."""
    codons = [a + b + c for a in BASES for b in BASES for c in BASES]
    return dict(zip(codons, STANDARD_CODE))


def revcomp(c: Column) -> Column:
    """Reverse complement (N stays N, U pairs with A)."""
    return F.reverse(F.translate(c, COMPLEMENT_FROM, COMPLEMENT_TO))


def gc_fraction(c: Column) -> Column:
    """G+C count over length; null for an empty sequence."""
    gc = F.length(F.regexp_replace(c, "[^GCgc]", ""))
    return F.try_divide(gc.cast("double"), F.length(c).cast("double"))


def to_rna(c: Column) -> Column:
    return F.translate(c, "Tt", "Uu")


def to_dna(c: Column) -> Column:
    return F.translate(c, "Uu", "Tt")


#: Letters of a tile: substring() walks from the start of its string, so long
#: sequences are cut up first and every look-up stays within a tile.
TILE = 512


def tiles(c: Column, width: int = TILE, extra: int = 0) -> Column:
    """array<string>: consecutive pieces of ``width`` letters, each with the
    ``extra`` letters that follow it. One linear pass."""
    pieces = F.regexp_extract_all(c, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    if not extra:
        return pieces
    more = -(-extra // width)
    both = F.transform(F.array(pieces), lambda p: F.transform(p, lambda x, i: F.concat(
        x, F.substring(F.array_join(F.slice(p, i + 2, more), ""), 1, extra))))
    return both[0]


def kmers(c: Column, k: int) -> Column:
    """array<struct<pos:int (0-based), kmer:string>>; empty when shorter than k."""
    def of_tile(t: Column, i: Column) -> Column:
        n = F.length(t) - k + 1
        found = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda j: F.struct(
            (i * TILE + j - 1).alias("pos"), F.substring(t, j, k).alias("kmer")))
        return F.when(n >= 1, found).otherwise(F.array().cast("array<struct<pos:int,kmer:string>>"))

    return F.flatten(F.transform(tiles(c, TILE, k - 1), of_tile)) if k > 1 else F.flatten(F.transform(tiles(c), of_tile))


def codons(c: Column, frame: int | Column = 0) -> Column:
    """Codons of ``c`` starting at 0-based ``frame`` (incomplete tail dropped)."""
    frame = F.lit(frame) if isinstance(frame, int) else frame
    return F.regexp_extract_all(F.substring(c, frame + 1, F.length(c)), F.lit("(?s).{3}"), F.lit(0))


def codon_map() -> Column:
    table = codon_table()
    return F.create_map(*[x for kv in table.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])


def translate_codons(c: Column, frame: int | Column = 0) -> Column:
    """Protein string of ``c`` read from ``frame``: ``*`` stop, unknown codon -> X."""
    m = codon_map()
    aa = F.transform(codons(F.upper(to_dna(c)), frame),
                     lambda cod: F.coalesce(F.try_element_at(m, cod), F.lit("X")))
    return F.array_join(aa, "")


def chars(c: Column) -> Column:
    return F.split(c, "")


def match_count(a: Column, b: Column) -> Column:
    """Positions where two equal-length strings carry the same letter."""
    eq = F.zip_with(chars(a), chars(b), lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(eq, F.lit(0), lambda acc, x: acc + x)


#: What the distance of sequences of unlike length says.
MSG_LENGTHS = "Sequences must be aligned: lengths {a} and {b} differ."


def identity_distance_error(a: Column, b: Column) -> Column:
    """Message if two sequences are not of one length, else null."""
    head, middle, tail = MSG_LENGTHS.replace("{b}", "{a}").split("{a}")
    text = F.concat(F.lit(head), F.length(a).cast("string"), F.lit(middle), F.length(b).cast("string"), F.lit(tail))
    return F.when(F.length(a) != F.length(b), text)


def identity_distance(a: Column, b: Column) -> Column:
    """1 - matches/length for equal-length aligned strings; null otherwise."""
    same = F.length(a) == F.length(b)
    return F.when(same & (F.length(a) > 0),
                  1.0 - match_count(a, b) / F.length(a).cast("double"))
