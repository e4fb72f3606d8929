"""The pipeline against plain versions of what its stages decide."""

import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from omics_spark.llm import simhash_dedup as S
from omics_spark.llm.common import table, written

from .helpers import awkward

SF = "/root/testdata/sf0.01"


def grams(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def test_stages_in_order_on_whole_inputs(spark):
    docs = table(spark, SF, "documents")
    marks = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    items = [grams(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    names, kept, before = [n for n, _ in P.STAGES], [], docs
    assert names == ["quality_classifier", "language_id", "simhash_dedup", "decontamination", "packing"]
    for name, stage in P.STAGES[:-1]:
        after = written(stage(spark, before, SF))
        assert after.schema == docs.schema, name
        assert after.exceptAll(before).count() == 0
        kept.append((before.collect(), after.collect()))
        before = after
    ids = [({r["doc_id"] for r in a}, {r["doc_id"] for r in b}) for a, b in kept]
    # quality: labelled clean text stays, nearly all labelled junk goes
    good, bad = ({i for i, q in marks.items() if q == v} for v in (1, 0))
    assert len(good - ids[0][1]) <= 0.005 * len(good) and len(bad & ids[0][1]) <= 0.05 * len(bad)
    # language: all that has letters is known here
    assert ids[1][0] == ids[1][1] | {r["doc_id"] for r in kept[1][0] if not re.search(r"[^\W\d_]", r["text"] or "")}
    # near duplicates: one of each component by brute force
    rows = kept[2][0]
    codes = np.array([S.simhash(r["text"], 3) for r in rows], np.uint64)
    root = np.arange(len(codes))
    for i in range(len(codes)):
        near = np.nonzero(np.bitwise_count(codes ^ codes[i]) <= 2)[0]
        S._merge(root, np.full(len(near), i), near)
    least = {}
    for r, k in zip(rows, root):
        least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    assert ids[2][1] == set(least.values())
    # benchmark: whole items go, texts without a shared shingle stay
    own = {r["doc_id"]: grams(r["text"]) for r in kept[3][0]}
    whole = {i for i, g in own.items() if any(x <= g for x in items)}
    touched = {i for i, g in own.items() if any(x & g for x in items)}
    assert whole and whole <= ids[3][0] - ids[3][1] <= touched
    packed = P.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids[3][1]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024


def test_every_stage_stands_awkward_rows(spark):
    docs = awkward(spark)
    for name, stage in P.STAGES:
        got = stage(spark, docs, SF)
        if name != "packing":
            assert got.schema == docs.schema
        assert got.count() > 0, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_registered_queries():
    import __spark_entry__ as entry

    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and {"op1_license_scan", "op2_pivot_topk"} <= set(entry.oracle_sql())
