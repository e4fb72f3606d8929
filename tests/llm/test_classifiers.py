"""Language, quality and toxicity: held-out accuracy and awkward rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from omics_spark.llm import language_id as L
from omics_spark.llm import quality as Q
from omics_spark.llm import toxicity as X
from omics_spark.llm.common import crc32_of_id, table

from .helpers import awkward, labels, prose

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def marks(spark):
    return table(spark, SF, "labels")


def auc(score, mark):
    order = np.argsort(score, kind="stable")
    s, y = np.asarray(score)[order], np.asarray(mark)[order]
    rank = np.searchsorted(s, s, "left") + np.searchsorted(s, s, "right")
    good = y == 1
    return ((rank[good].sum() / 2) - good.sum() ** 2 / 2) / (good.sum() * (~good).sum())


def test_language_held_out(docs):
    held = F.pmod(crc32_of_id(), F.lit(3)) == 1
    got = L.identify(docs, L.train(docs, ~held)).join(docs.where(held).select("doc_id", "lang"), "doc_id")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 3000 and right >= 0.995 * n


def test_language_pieces_do_not_change_scores():
    rng = random.Random(0)
    texts = ["".join(rng.choice("aeiou nrst") for _ in range(rng.randint(0, 5000))) for _ in range(20)] + ["", None]
    model = (["x", "y"], np.log([0.5, 0.5]), np.random.default_rng(0).normal(-9, 1, (1 << L.BITS, 2)).astype(np.float32))
    whole = L.score_texts(texts, *model)
    old, L._pieces = L._pieces, lambda t, _: old(t, 97)
    try:
        cut = L.score_texts(texts, *model)
    finally:
        L._pieces = old
    assert [a for a, _ in whole] == [a for a, _ in cut]
    assert np.allclose([s for _, s in whole], [s for _, s in cut], atol=1e-6)


def test_language_awkward_rows(spark):
    docs = awkward(spark)
    model = L.train(docs, F.lit(True))
    assert model[0] == ["de", "en"]
    got = L.identify(docs, model)
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] in (2, 3, 5)} == {("und", 0.0)}
    kept = L.keep_identified(docs, model, 0.0)
    assert kept.schema == docs.schema and kept.where("doc_id in (2, 3, 5)").count() == 0
    nothing = L.train(docs, F.lit(False))
    assert {r["lang_pred"] for r in L.identify(docs, nothing).collect()} == {"und"}
    assert L.identify(docs.limit(0), model).count() == L.keep_identified(docs.limit(0), model).count() == 0


def test_quality_held_out(docs, marks):
    learn, test = marks.where("doc_id % 4 <> 0"), marks.where("doc_id % 4 = 0")
    model = Q.train(docs, learn)
    got = Q.resample(docs, model).join(test, "doc_id").select("quality", "weight", "grams", "selected").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good.selected.mean() >= 0.998 and bad.selected.mean() <= 0.03
    assert auc(got.weight / got.grams, got.quality) > 0.99
    chosen = Q.resample(docs, model).where("selected")
    assert Q.keep_selected(docs, model).select("doc_id").exceptAll(chosen.select("doc_id")).count() == 0
    assert Q.keep_selected(docs, model).count() == chosen.count()


def test_gumbel_top_k_draws_by_weight(spark):
    """With full noise, how often a row is drawn follows its weight."""
    df = spark.range(3000).select((F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, math.log(4.0)).otherwise(0.0).alias("w"))
    key = df.withColumn("key", F.col("w") + Q.gumbel(3))
    cut = Q.kth_largest(key, "key", 300)
    got = key.where(F.col("key") >= cut)
    heavy = got.where("w > 0").count()
    assert got.count() == 300 and 0.55 < heavy / 300 < 0.75  # 4 : 1 odds, 1 : 2 rows


def test_kth_largest_is_exact(spark):
    rng = random.Random(4)
    values = [rng.gauss(0, 1) ** 5 for _ in range(9000)] + [0.5] * 6000 + [1e300, -1e300]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 17, 5000, len(values)):
        assert Q.kth_largest(df, "x", k) == ordered[k - 1]


def test_quality_awkward_rows(spark):
    docs = awkward(spark)
    model = Q.train(docs, labels(spark, [(1, 1, 0), (7, 0, 0), (8, 0, 0), (None, 1, 1), (2, None, None), (6, 1, 0), (6, 0, 0), (99, 1, 1)]))
    got = Q.resample(docs, model)
    rows = got.collect()
    assert len(rows) == docs.count()
    assert not any(r["selected"] for r in rows if r["grams"] == 0) and {r["doc_id"] for r in rows if r["grams"] == 0} == {2, 3, 5, None}
    assert Q.keep_selected(docs, model).schema == docs.schema
    assert Q.resample(docs, model, k=0).where("selected").count() == 0
    assert Q.resample(docs, model, k=100).where("selected").count() == sum(r["grams"] > 0 for r in rows)
    free = Q.train(docs, labels(spark, [(77, 1, 1)]).limit(0))
    assert Q.resample(docs, free).where("selected").count() == sum(r["grams"] > 0 for r in rows)
    assert Q.resample(docs.limit(0), model).count() == Q.keep_selected(docs.limit(0), model).count() == 0


def test_toxicity_held_out(docs, marks):
    held = F.pmod(crc32_of_id(), F.lit(5)) == 0
    model = X.train(docs, marks, ~held)
    got = X.score(docs, model).join(marks.where(held), "doc_id").toPandas()
    assert auc(got.score, got.toxic) > 0.93
    assert got[got.toxic == 0].predicted.mean() < 0.01 and got[got.toxic == 1].predicted.mean() > 0.85


def test_toxicity_composition_equals_the_cascade():
    rng = random.Random(7)
    arcs, parts = X.grammar(), [X.negation(), X.reported(), X.targeted()]
    for _ in range(500):
        clause = "".join(rng.choice(X.PLAIN) for _ in range(12))
        state, one, states, cascade = 0, "", [0, 0, 0], ""
        for s in clause:
            state, out = arcs[state, s]
            one += out
            for i, t in enumerate(parts):
                states[i], s = t[states[i], s]
            cascade += s
        assert one == cascade


def test_toxicity_scores_clauses_not_words():
    lexicon = {"idiot": 1.0, "scum*": 1.0}
    read = X._reader(lexicon)
    f = dict(zip(X.FEATURES, range(len(X.FEATURES))))
    plain, aimed, negated, cited, threat, stem, apart = read(
        ["what an idiot", "you are an idiot", "he is not an idiot", "she said an idiot came", "i will kill him, you kill", "scumbags", "he left. not. idiot"])
    assert plain[f["I"]] == 1 and aimed[f["A"]] == 1 and cited[f["q"]] == 1 and stem[f["I"]] == 1 and apart[f["I"]] == 1
    assert negated[f["i"]] == 1 and threat[f["K"]] == 1 and threat[f["H"]] == 1
    assert read([None, "", "a clean text."]) == [[0.0] * len(X.FEATURES)] * 3


def test_toxicity_awkward_rows(spark):
    rows = [(i, f"{prose(i, 30)} {'vile' if i % 2 else ''} {prose(i + 1, 30)}", "en", "a") for i in range(40)]
    docs = awkward(spark, rows + [(100, None, None, None), (101, "", None, None), (None, "vile", None, None), (102, prose(1, 30_000) + " vile", None, None), (0, rows[0][1], "en", "a")])
    model = X.train(docs, labels(spark, [(i, 1, i % 2) for i in range(40)] + [(None, 1, 1), (5, 1, None)]), F.lit(True))
    got = X.score(docs, model).collect()
    assert len(got) == 45 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert {r["doc_id"] for r in got if r["predicted"]} == {*range(1, 40, 2), None, 102}
    nothing = X.train(docs, labels(spark, [(1, 1, 1)]), F.lit(True))
    assert {r["predicted"] for r in X.score(docs, nothing).collect()} == {0}
    assert X.score(docs.limit(0), model).count() == 0


def test_toxicity_learns_insults_of_a_rare_language(spark):
    """An insult in 40 of 5,000 toxic rows is below a hundredth of them."""
    rows = [(i, f"{prose(i, 12)} n{i} {('' if i % 2 else 'blarg' if i < 80 else 'vile')} {prose(i + 1, 12)}", "en", "a") for i in range(10_000)]
    docs = awkward(spark, rows + [(20_000, "so ein blarg hier", "xx", "a"), (20_001, prose(3, 20), "en", "a")], [])
    lexicon, *rest = X.train(docs, labels(spark, [(i, 1, 1 - i % 2) for i in range(10_000)]), F.lit(True))
    assert {"blarg", "vile"} <= set(lexicon)
    got = {r["doc_id"]: r["predicted"] for r in X.score(docs, (lexicon, *rest)).where("doc_id in (0, 20000, 20001)").collect()}
    assert got == {0: 1, 20_000: 1, 20_001: 0}
