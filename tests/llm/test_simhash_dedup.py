import numpy as np
import xxhash
from pyspark.sql import functions as F

from conftest import SF001
from omics_spark.llm import simhash_dedup as S
from omics_spark.llm.common import table

from .helpers import awkward, prose


def plain(text, n=3):
    """Fingerprint as the contract words it."""
    import re

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(codes, max_bits=2):
    root = np.arange(len(codes))
    for i in range(len(codes)):
        near = np.nonzero(np.bitwise_count(codes ^ codes[i]) <= max_bits)[0]
        S._merge(root, np.full(len(near), i), near)
    return root


def test_fingerprint():
    for text in [None, "", " \t\n", "One", "one two", "One TWO three", "É É é  Ü\x0bb c d", "a b c d e", prose(1, 500)]:
        assert S.simhash(text, 3) == plain(text)
    text = prose(5, 1000)
    assert S.simhash(text, 3, piece=7) == S.simhash(text, 3)


def test_gray_rank_sorts_like_gray_order(spark):
    codes = [0, 1, 3, 2, 6, 7, 5, 4, 12, -1, -(1 << 63), 1 << 62]
    got = spark.createDataFrame([(c,) for c in codes], "fp long").select("fp", S.gray_rank(F.col("fp")).alias("r")).collect()

    def rank(c):
        c &= (1 << 64) - 1
        r = 0
        while c:
            r, c = r ^ c, c >> 1
        return r

    assert [r["fp"] for r in sorted(got, key=lambda r: r["r"])] == sorted(codes, key=rank)


def test_links_join_all_that_is_near(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(1 << int(x)) ^ np.uint64(1 << int(y)) for b in base for x, y in rng.integers(0, 64, (12, 2))]
    dense = [base[0] ^ np.uint64(x) for x in range(1 << 9)]  # one large group of near codes
    codes = np.unique(np.concatenate([base, np.array(near, np.uint64), np.array(dense, np.uint64), rng.integers(0, 1 << 63, 500, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    want = brute(codes)
    for page in (37, 256, 1 << 15):
        edges = S.links(df, 2, page)
        assert edges.count() < 20 * len(codes)  # a forest, not all pairs
        root = {r["node"]: r["root"] for r in S.components(edges).collect()}
        got = [root.get(int(c), int(c)) for c in codes.view(np.int64)]
        assert len(set(got)) == len(set(want.tolist()))
        assert len(set(zip(got, want.tolist()))) == len(set(got))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 199), (199, 200)]
    got = {r["node"]: r["root"] for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 50)}, 200: 199}


def test_against_brute_force(spark):
    docs = table(spark, SF001, "documents")
    rows = docs.select("doc_id", "text").collect()
    codes = np.array([plain(r["text"]) for r in rows], np.uint64)
    root, ids = brute(codes), np.array([r["doc_id"] for r in rows])
    want = {int(i): (f"{int(c):016x}", int(ids[root == k].min())) for i, c, k in zip(ids, codes, root)}
    got = S.near_duplicates(docs, page=50).select("doc_id", S.hex_of("fp").alias("f"), "component_id").collect()
    assert {r["doc_id"]: (r["f"], r["component_id"]) for r in got} == want and len(got) == len(rows)


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = S.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    empty = {r["component_id"] for r in got if r["fp"] == 0}
    assert empty == {2}  # null, empty and blank texts link like any other
    kept = S.deduplicate(docs)
    assert kept.schema == docs.schema
    rows = sorted(kept.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"]))
    assert [r["doc_id"] for r in rows] == [1, 1, 2, 4, 6, 8, None]
    assert S.near_duplicates(docs.limit(0)).count() == S.deduplicate(docs.limit(0)).count() == 0


def test_only_null_ids(spark):
    docs = awkward(spark, [(None, "a b c d", None, None), (None, "a b c d", None, None)])
    assert {r["component_id"] for r in S.near_duplicates(docs).collect()} == {None}
    assert S.deduplicate(docs).count() == 1
