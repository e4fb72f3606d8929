"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of a bounded sample of labelled rows in Spark;
the matrix of log probabilities (languages x buckets) is broadcast, and
batches are scored in numpy by gathering the rows of the n-grams that occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices

ORDERS, BITS = 3, 15
#: Labelled rows of one language used in training (expected; chosen by id hash).
PER_LANGUAGE = 2_000
#: The matrix of log probabilities holds at most so many values: up to 2,048
#: languages have 2^BITS buckets each, with twice as many the buckets halve.
MAX_VALUES = 1 << 26
#: Tables of languages are broadcast up to so many rows.
FEW = 1 << 17
#: n-grams that the score trusts: longer texts are no surer than these.
TRUST = 200
UNKNOWN = "und"


def _pieces(texts: list[str | None], chars: int):
    """Lists of (row, code points with ORDERS - 1 following, own length)."""
    import numpy as np

    held, size = [], 0
    for row, text in enumerate(texts):
        cp = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
        cp = np.concatenate([cp, np.zeros(ORDERS - 1, np.uint32)])
        n = len(cp) - ORDERS + 1
        for at in range(0, n, chars):
            own = min(chars, n - at)
            held.append((row, cp[at:at + own + ORDERS - 1], own))
            size += own
            if size >= chars:
                yield held
                held, size = [], 0
    if held:
        yield held


def _bits(languages: int) -> int:
    return max(1, min(BITS, (MAX_VALUES // max(1, languages)).bit_length() - 1))


def _buckets(held, bits: int = BITS):
    """For each n-gram order the buckets; where each piece starts and ends."""
    import numpy as np

    cp = np.concatenate([c for _, c, _ in held])
    sizes = np.array([len(c) for _, c, _ in held])
    starts = np.cumsum(sizes) - sizes
    ends = starts + np.array([n for _, _, n in held])
    h, out = np.zeros(len(cp) - ORDERS + 1, np.uint32), []
    for n in range(ORDERS):
        h = (h ^ cp[n:n + len(h)]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        out.append((h * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits))
    return out, starts, ends


def train(docs: DataFrame, labelled: Column, per_language: int = PER_LANGUAGE, alpha: float = 0.5):
    """(languages, log priors, log probabilities) from the rows where
    ``labelled`` holds and lang and text are not null. At most about
    ``per_language`` rows of a language are read, the same on every run."""
    import numpy as np

    rows = docs.where(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    bits = _bits(len(langs))
    if not langs:
        return [], np.zeros(0), np.zeros((1 << bits, 0), np.float32)
    share = docs.sparkSession.createDataFrame([(n, min(1.0, per_language / sizes[n])) for n in langs], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) / float(1 << 20)
    number = {n: i for i, n in enumerate(langs)}

    def count(batches):
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in slices(batches):
            cols = batch.to_pydict()
            by: dict[str, list] = {}
            for lang, text in zip(cols["lang"], cols["text"], strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                got = total.setdefault(number[lang], np.zeros(1 << bits, np.int64))
                for held in _pieces(texts, 1 << 20):
                    for b in _buckets(held, bits)[0]:
                        got += np.bincount(b, minlength=1 << bits)
        for lang, counts in total.items():
            used = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_pydict({"l": pa.array(np.full(len(used), lang), pa.int32()), "b": pa.array(used, pa.int32()), "n": pa.array(counts[used], pa.int64())})

    # One small row a language, sent to all tasks unless there are very many.
    drawn = rows.join(F.broadcast(share) if len(langs) <= FEW else share, "lang").where(draw < F.col("share")).select("doc_id", "lang", "text")
    counted = drawn.mapInArrow(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), 1 << bits))
    counts[counted["l"], counted["b"]] = counted["n"]
    log_p = np.log(counts + alpha) - np.log(counts.sum(1, keepdims=True) + alpha * (1 << bits))
    prior = np.log(np.array([sizes[n] for n in langs]) / sum(sizes.values()))
    return langs, prior, np.ascontiguousarray(log_p.T, np.float32)


def score_texts(texts, langs, prior, log_p):
    """[(language, score)] of whole texts: the language of the greatest
    posterior, and its posterior with scaled evidence."""
    import re

    import numpy as np

    letter = re.compile(r"[^\W\d_]")
    bits, width = log_p.shape[0].bit_length() - 1, max(1, len(langs))
    rows = max(1, (1 << 23) // width)
    out = []
    for part in (texts[at:at + rows] for at in range(0, len(texts), rows)):
        total, grams = np.zeros((len(part), len(langs))), np.zeros(len(part))
        if langs:
            for held in _pieces(part, max(4096, (1 << 23) // width)):
                buckets, starts, ends = _buckets(held, bits)
                bounds = np.stack([starts, ends], 1).ravel()
                row = np.array([r for r, _, _ in held])
                for b in buckets:
                    sums = np.add.reduceat(np.concatenate([log_p[b], np.zeros((ORDERS, len(langs)), np.float32)]), bounds, axis=0, dtype=np.float64)[::2]
                    np.add.at(total, row, sums)
                np.add.at(grams, row, (ends - starts) * ORDERS)
        for text, sums, n in zip(part, total, grams, strict=True):
            if not langs or not text or not letter.search(text):
                out.append((UNKNOWN, 0.0))
                continue
            best = int((prior + sums).argmax())
            logs = prior * min(1.0, n / TRUST) + sums * min(1.0, TRUST / n)
            p = np.exp(logs - logs.max())
            out.append((langs[best], float(p[best] / p.sum())))
    return out


def identify(docs: DataFrame, model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row.

    The language is that of plain naive Bayes; ``score`` is its posterior with
    the evidence scaled to at most ``TRUST`` n-grams. Null texts, texts without letters, and all texts if nothing was
    learned, are ``und`` with score 0. Repeated rows come out as often as
    they go in; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(cols):
        found = score_texts(cols["text"], *shared.value)
        return {"doc_id": cols["doc_id"], "lang_pred": [x for x, _ in found], "score": [x for _, x in found]}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, lang_pred string, score double", run)


def keep_identified(docs: DataFrame, model, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose language is known with score ``least`` or more.
    The text is scored in place; all columns pass through unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            found = score_texts(batch.column(batch.schema.get_field_index("text")).to_pylist(), *shared.value)
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


