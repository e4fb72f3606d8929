"""Toxicity by a weighted finite-state pattern grammar.

Tokens become symbols: insult (a lexicon of words and stems learned from
labelled rows), threat, target, negation, reporting verb, clause end, other.
Small transducers rewrite and weigh the symbols of a clause: negation and
reported speech turn the insults and threats they govern into weaker symbols,
the target transducer turns those aimed at somebody into stronger ones, and
the insult and threat transducers read off what was matched. Their
composition is one table; a clause is scored by one walk through it, so a
word counts by the clause it stands in. A logistic model over the symbols
that the matched clauses of a text give is fitted to the labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, slices, written

#: Labelled rows of one label that training reads (expected; by id hash).
PER_LABEL = 6_000
#: A lexicon entry occurs in so many toxic rows of the sample, and its share of
#: toxic rows is so many times that of others even if SPREAD standard
#: deviations of chance spoke for it: rare words of long texts are many, and
#: some stand in toxic rows only.
MIN_ROWS, MIN_ODDS, SPREAD = 4, 20.0, 0.75
#: A stem counts if it is in so many times the rows of its most frequent word.
FAMILY = 1.15
STEMS = (4, 5, 6, 7, 8)
#: Symbols that one task remembers for words.
MEMORY = 1 << 19

# Word lists in four languages (fixed values).
THREAT = "kill hurt destroy beat stab shoot murder töten umbringen zerstören schlagen tuer frapper détruire matar golpear destruir".split()
TARGET = "you your yourself u he she they them him her his their du dich dir dein ihr euch sie er tu toi te ton vous votre il elle ils ustedes tú usted él ella ellos vosotros".split()
NEGATION = "not no never without cannot nicht kein keine nie niemals ne jamais ni nunca tampoco sin".split()
REPORT = "said says say told called calls wrote quoted claimed reported according sagte nannte schrieb laut dit appelé écrit selon dijo llamó escribió según".split()

#: o other, I insult, H threat, T target, N negation, R report, "." clause end.
PLAIN = "oIHTNR."
#: After composition: i/h negated, q/p reported, A/K aimed at a target.
FEATURES = "IHAKiqhp"
PRIOR = {"I": 2.0, "H": 0.3, "A": 2.5, "K": 2.0, "i": 0.5, "q": 0.5, "h": 0.0, "p": 0.0}
TOKEN = r"[^\W\d_]+|[.!?;:\n,\"“”«»]"


def negation(reach: int = 3) -> dict:
    """For ``reach`` tokens after a negation insults and threats weaken."""
    arcs = {}
    for left in range(reach + 1):
        for s in PLAIN:
            to = reach if s == "N" else 0 if s == "." else max(0, left - 1)
            arcs[left, s] = to, {"I": "i", "H": "h"}.get(s, s) if left else s
    return arcs


def reported() -> dict:
    """After a reporting verb, to the clause's end, insults are cited."""
    arcs = {}
    for s in PLAIN + "ih":
        arcs[0, s] = (1 if s == "R" else 0), s
        arcs[1, s] = (0 if s == "." else 1), {"I": "q", "H": "p", "i": "q", "h": "p"}.get(s, s)
    return arcs


def targeted(reach: int = 4) -> dict:
    """Within ``reach`` tokens after a target insults and threats are aimed."""
    arcs = {}
    for left in range(reach + 1):
        for s in PLAIN + "ihqp":
            to = reach if s == "T" else 0 if s == "." else max(0, left - 1)
            arcs[left, s] = to, {"I": "A", "H": "K"}.get(s, s) if left else s
    return arcs


def compose(first: dict, second: dict) -> dict:
    """The transducer that feeds ``first``'s output to ``second``; of pairs of
    states only those reachable from (0, 0) are kept, numbered from 0."""
    number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
    while todo:
        a, b = pair = todo.pop()
        for (state, s), (to, out) in first.items():
            if state == a:
                after, written_ = second[b, out]
                if (to, after) not in number:
                    number[to, after] = len(number)
                    todo.append((to, after))
                arcs[number[pair], s] = number[to, after], written_
    return arcs


def grammar() -> dict:
    return compose(compose(negation(), reported()), targeted())


def clause_features(symbols: str, strength: list[float], arcs: dict) -> list[float]:
    """Strength of the insults and threats of one clause by output symbol."""
    state, out = 0, dict.fromkeys(FEATURES, 0.0)
    for s, w in zip(symbols, strength, strict=True):
        state, got = arcs[state, s]
        if got in out:
            out[got] += w
    return [out[f] for f in FEATURES]


class _Symbols(dict):
    """word -> (symbol, strength)."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon
        self.lists = {w: s for s, words in (("H", THREAT), ("T", TARGET), ("N", NEGATION), ("R", REPORT)) for w in words}

    def __missing__(self, word):
        if len(self) >= MEMORY:
            self.clear()
        strength = max([self.lexicon.get(word, 0.0), *(self.lexicon.get(word[:n] + "*", 0.0) for n in STEMS)])
        if strength:
            found = "I", strength
        elif word in self.lists:
            found = self.lists[word], 1.0
        else:
            found = ("." if not word[0].isalpha() and word != "," else "o"), 0.0
        self[word] = found
        return found


def _reader(lexicon: dict[str, float]):
    """A function from texts to feature rows."""
    import re

    find, clause = re.compile(TOKEN).findall, re.compile(r"[^.]*[IH][^.]*\.?")
    arcs, words = grammar(), _Symbols(lexicon)

    def read(texts):
        rows = []
        for text in texts:
            tokens = find((text or "").lower())
            symbols = "".join([words[t][0] for t in tokens])
            total = [0.0] * len(FEATURES)
            for m in clause.finditer(symbols):
                strength = [words[t][1] for t in tokens[m.start():m.end()]]
                total = [a + b for a, b in zip(total, clause_features(m[0], strength, arcs), strict=True)]
            rows.append(total)
        return rows

    return read


def _sampled(labels: DataFrame, learn: Column, per_label: int) -> DataFrame:
    """(doc_id, toxic): bounded; rows with nulls or contradictions left out."""
    one = (labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
           .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
           .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most").drop("_most"))
    sizes = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 20)) / float(1 << 20)
    rate = {t: min(1.0, per_label / sizes.get(t, 1)) for t in (0, 1)}
    return one.where(draw < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0]))


def train(docs: DataFrame, labels: DataFrame, learn: Column, per_label: int = PER_LABEL):
    """(lexicon, weights, bias) from labelled rows where ``learn`` holds.

    Without toxic or without other rows nothing is learned: the lexicon is
    empty and every score is the same."""
    import math
    import re

    sample = written(_sampled(labels, learn, per_label))
    # Copies of one text are one witness.
    texts = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
                    .join(F.broadcast(sample), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")))

    rows = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if not rows.get(0) or not rows.get(1):
        return {}, [PRIOR[f] for f in FEATURES], -3.0

    def terms(batches):
        import pyarrow as pa

        find, seen = re.compile(r"[^\W\d_]+").findall, {}
        for batch in slices(batches):
            cols = batch.to_pydict()
            for text, toxic in zip(cols["text"], cols["toxic"], strict=True):
                own = set(find(text.lower()))
                own |= {w[:n] + "*" for w in own for n in STEMS if len(w) >= n}
                for w in own:
                    n = seen.setdefault(w, [0, 0])
                    n[toxic] += 1
        if seen:
            yield pa.RecordBatch.from_pydict({"term": list(seen), "clean": [n[0] for n in seen.values()], "toxic": [n[1] for n in seen.values()]})

    bar = min(MIN_ODDS, (rows[0] + 1) / 2)  # few other rows cannot show higher odds
    least = F.greatest(F.col("toxic") - SPREAD * F.sqrt("toxic"), F.lit(0.0)) + 0.5
    most = F.col("clean") + SPREAD * F.sqrt("clean") + 1
    odds = F.log(least / (rows[1] + 1) / (most / (rows[0] + 1)))
    entries = (texts.select("text", "toxic").mapInArrow(terms, "term string, clean long, toxic long").groupBy("term")
               .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
               .withColumn("odds", odds).where((F.col("toxic") >= MIN_ROWS) & (F.col("odds") >= math.log(bar)))
               .orderBy(F.desc("odds"), "term").collect())  # each entry is in MIN_ROWS of the sampled toxic rows
    alone: dict[str, int] = {}  # of each stem the rows of its most frequent word
    for r in entries:
        if r["term"][-1] != "*":
            for n in STEMS:
                if len(r["term"]) >= n:
                    alone[r["term"][:n] + "*"] = max(r["toxic"], alone.get(r["term"][:n] + "*", 0))
    lexicon = {r["term"]: min(1.0, r["odds"] / 4) for r in entries if r["toxic"] > FAMILY * alone.get(r["term"], 0)}
    read = _reader(lexicon)
    scored, (name,) = add_columns(texts.select("toxic", "text"), "text", lambda t: [read(t)], ["f array<double>"])
    table = scored.select("toxic", name).collect()  # bounded by 2 * per_label rows
    weights, bias = fit([r[1] for r in table], [r["toxic"] for r in table])
    return lexicon, weights, bias


def fit(rows, marks, pull: float = 2.0, steps: int = 50):
    """Logistic regression by Newton steps, drawn towards PRIOR."""
    import numpy as np

    x = np.hstack([np.array(rows, float).reshape(len(marks), len(FEATURES)), np.ones((len(marks), 1))])
    y = np.array(marks, float)
    centre = np.array([PRIOR[f] for f in FEATURES] + [-2.0])
    w = centre.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + pull * np.eye(len(w)), x.T @ (y - p) - pull * (w - centre))
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return [float(v) for v in w[:-1]], float(w[-1])


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score, predicted) for every row.

    Only whole texts count. Null and empty texts, like those without a matched
    clause, get the score of no evidence. Repeated rows score alike; an empty
    table gives no rows.
    """
    import math

    _, weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        read = _reader(shared.value[0])
        z = [bias + sum(a * b for a, b in zip(weights, row, strict=True)) for row in read(texts)]
        return [[1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in z]]

    scored, (name,) = add_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", run, ["score double"])
    return scored.select("doc_id", F.col(name).alias("score"), (F.col(name) >= 0.5).cast("int").alias("predicted"))
