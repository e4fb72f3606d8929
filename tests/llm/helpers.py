"""Small tables with the awkward rows that every operator must stand."""

from __future__ import annotations

#: Extra columns whose names clash with names that operators use inside.
CLASHES = ["_id", "_text", "row", "fp", "weight", "grams", "key", "rank", "_salt", "_base", "shard", "size", "p", "m", "score", "hits", "sh", "root"]
WORDS = "amber birch cedar delta ember frost grove hazel inlet jetty knoll larch maple north ocean pearl quartz river stone thorn".split()


def prose(seed: int, words: int) -> str:
    return " ".join(WORDS[(seed * 7919 + i * i * 31 + i * seed) % len(WORDS)] for i in range(words))


def awkward(spark, rows=None, clashes=CLASHES):
    """documents with nulls in any column, empty and long texts, repeats."""
    if rows is None:
        long = prose(3, 30_000)
        rows = [(1, prose(1, 60), "en", "a"), (1, prose(1, 60), "en", "a"), (2, None, "en", "a"), (3, "", None, None),
                (None, prose(2, 40), "en", "a"), (None, None, None, None), (4, long, "en", "b"), (5, " \t\n ", "de", "b"),
                (6, "word", "de", "b"), (7, prose(1, 60), "de", None), (8, "x" * 50_000, "en", "b"), (1, prose(9, 50), "en", "c")]
    full = [(*r, None if r[1] is None else len(r[1]), *(["clash"] * len(clashes))) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in clashes)
    return spark.createDataFrame(full, schema)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
