import re

from conftest import SF001
from omics_spark.llm import license_scan as L
from omics_spark.llm.common import table

from .helpers import awkward, prose


def grams(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]


def brute(docs, templates):
    out = {}
    for i, text in {(i, t) for i, t in docs if t is not None}:
        g = grams(text)
        for name, t in templates.items():
            own = set(grams(t))
            if not own:
                continue
            n, stride = len(own), max(1, len(own) // 4)
            shares = [(-len(set(g[a:a + n + stride - 1]) & own) / n, a) for a in range(0, max(1, len(g)), stride)]
            held = [x for x in shares if x[0] <= -0.8]
            if held:
                out[i, name] = (-min(held)[0], min(held)[1], len(held))
    return out


def got(docs, templates, **kw):
    rows = L.scan(docs, L.template_table(docs.sparkSession, templates), **kw).collect()
    found = {(r["doc_id"], r["license_id"]): (r["containment"], r["first_shingle"], r["windows"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_against_brute_force(spark):
    docs = table(spark, SF001, "documents")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], L.TEMPLATES)
    assert want and got(docs, L.TEMPLATES) == want
    assert got(docs, L.TEMPLATES, max_literal=0) == want  # the way for many templates


def test_copies_edits_and_awkward_rows(spark):
    mit = L.TEMPLATES["MIT"]
    words = mit.split()
    half, edited = " ".join(words[:40]), " ".join("changed" if i in (20, 60) else w for i, w in enumerate(words))
    rows = [(1, f"{prose(1, 501)} {mit.upper()} {prose(2, 20_000)}", None, None), (2, edited, "en", "a"), (3, half, "en", "a"),
            (4, None, None, None), (5, "", "en", "a"), (None, mit, "en", "a"), (6, mit, "en", "a"), (6, mit, "en", "a"),
            (7, "four words only here", "en", "a"), (8, prose(3, 3000), "en", "a"), (9, " ".join([mit] * 3), "en", "a")]
    docs = awkward(spark, rows, clashes=["sh", "at", "key", "n", "text_hash", "hits", "words", "license_id"])
    found = got(docs, L.TEMPLATES)
    assert found == brute([r[:2] for r in rows], L.TEMPLATES)
    assert {i for i, _ in found} == {1, 2, None, 6, 9} and found[2, "MIT"][0] < 1
    odd = {"empty": "", "short": "two words", "mit": mit}
    assert {k for _, k in got(docs, odd)} == {"mit"}
    assert got(docs.limit(0), L.TEMPLATES) == {} == got(docs, {"short": "two words"})


def test_bands_meet_the_stated_probability():
    n, held, bands = 100, 0.8, L.bands_for()
    least = held * n / (n + n // 4 + n - held * n)
    assert (1 - least) ** bands <= L.MISS


def test_no_python_in_the_plan(spark):
    plan = L.scan(table(spark, SF001, "documents"), L.template_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
