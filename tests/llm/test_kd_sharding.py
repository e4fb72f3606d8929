import zlib

from pyspark.sql import functions as F

from conftest import SF001
from omics_spark.llm import kd_sharding as K
from omics_spark.llm.common import gapless_rank, table

from .helpers import awkward, prose


def check(rows, texts, shards):
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted(
        (-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    by = {}
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        by.setdefault(r["shard"], []).append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return [sum(r["size"] for r in by.get(s, [])) for s in range(shards)]


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_bytes_slots_and_groups(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    rows = K.shard(docs).collect()
    sizes = check(rows, pairs(docs), 8)
    assert max(sizes) - min(sizes) < 0.01 * sum(sizes) / 8
    home = {r["doc_id"]: r["shard"] for r in rows}
    groups = {}
    for i, t in pairs(docs):
        groups.setdefault(t, []).append(home[i])
    small = [s for t, s in groups.items() if len(s) * (len(t.encode()) + 1) <= sum(sizes) // (8 * 32)]
    assert all(len(set(s)) == 1 for s in small) and any(len(s) > 5 for s in small)


def test_other_numbers_of_shards(spark):
    docs = table(spark, SF001, "documents")
    for shards in (1, 3):
        sizes = check(K.shard(docs, shards).collect(), pairs(docs), shards)
        assert max(sizes) < 1.1 * sum(sizes) / shards
    by_target = K.shard(docs, target_bytes=100_000).agg(F.countDistinct("shard")).first()[0]
    total = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0]
    assert by_target == -(-total // 100_000)


def test_hot_group_of_copies_and_one_source(spark):
    rows = [(i, prose(1, 30) if i % 3 == 0 else prose(i, 20 + i % 50), "en", "hot" if i % 3 else None) for i in range(1500)]
    docs = awkward(spark, rows, clashes=["part", "h", "dim_id", "text_hash", "law"])
    sizes = check(K.shard(docs).collect(), pairs(docs), 8)
    assert max(sizes) < 1.05 * sum(sizes) / 8


def test_awkward_rows(spark):
    docs = awkward(spark, clashes=["part", "h", "dim_id", "text_hash", "law", "bytes", "parts"])
    check(K.shard(docs).collect(), pairs(docs), 8)
    check(K.shard(docs.drop("lang", "source")).collect(), pairs(docs), 8)
    assert K.shard(docs.limit(0)).count() == 0


def test_gapless_rank_of_a_hot_key(spark):
    df = spark.range(1000).withColumn("k", F.when(F.col("id") < 900, 0).otherwise(F.col("id")))
    rows = gapless_rank(df, ["k"], F.xxhash64("id"), ["id"], "n", 16).collect()
    by = {}
    for r in rows:
        by.setdefault(r["k"], []).append(r["n"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(rows) == 1000


def plain_tree(units, shards):
    """Shard of each unit (weight, places, scaled values), node by node."""
    home = {}

    def split(own, low, high):
        if high - low == 1 or not own:
            home.update(dict.fromkeys(own, low))
            return
        widths = [max(units[u][2][d] for u in own) - min(units[u][2][d] for u in own) for d in range(len(units[own[0]][2]))]
        dim, middle = widths.index(max(widths)), (low + high) // 2
        own = sorted(own, key=lambda u: units[u][1][dim])
        target, held, at = sum(units[u][0] for u in own) * (middle - low) / (high - low), 0, 0
        while held + units[own[at]][0] < target:
            held += units[own[at]][0]
            at += 1
        at += held + units[own[at]][0] - target <= target - held
        split(own[:at], low, middle)
        split(own[at:], middle, high)

    split(list(units), 0, shards)
    return home


def test_splits_are_those_of_a_plain_tree(spark, monkeypatch):
    monkeypatch.setattr(K, "TOLERANCE", 0.0)
    df = K.written(spark.range(600).selectExpr("id", "xxhash64(id) h", "1 + pmod(xxhash64(id, 1), 900) weight", "log(1 + pmod(xxhash64(id, 2), 5000)) dim_a",
                                               "cast(pmod(xxhash64(id, 3), 3) as double) dim_b", "0.0D dim_c"))
    rows = df.collect()
    tie = {r["id"]: r["t"] for r in df.select("id", F.pmod(F.xxhash64("h", F.lit(8)), F.lit(1 << K.HASH_BITS)).alias("t")).collect()}
    span = {d: (min(r[d] for r in rows), max(r[d] for r in rows)) for d in ("dim_a", "dim_b")}
    units = {}
    for r in rows:
        scaled = [(r[d] - span[d][0]) / (span[d][1] - span[d][0]) for d in span] + [0.0]
        units[r["id"]] = r["weight"], [int(x * (K.VALUES - 1)) * (1 << K.HASH_BITS) + tie[r["id"]] for x in scaled], scaled
    for shards in (5, 16):
        got = {r["id"]: r["shard"] for r in K.partition(df, ["dim_a", "dim_b", "dim_c"], shards).collect()}
        assert got == plain_tree(units, shards)


def test_very_many_shards(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    sizes = check(K.shard(docs, 512).collect(), pairs(docs), 512)
    assert sum(s > 0 for s in sizes) > 500
