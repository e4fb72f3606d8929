"""Quality by importance resampling: hashed n-gram models of target and raw text.

The target model counts hashed word n-grams of a bounded sample of rows
labelled good; the raw model counts those of all rows. A text's log
importance weight is the sum of log target / raw probabilities of its
n-grams. Rows are drawn by Gumbel top-k: the k largest of weight plus Gumbel
noise. k is the number of rows whose weight, less ``tilt`` an n-gram, is not
negative; the tilt is the one that best parts labelled good from bad rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, slices, written

BITS = 16
#: Labelled rows of one label that training reads (expected; by id hash).
PER_LABEL = 6_000
#: Scale of the Gumbel noise against the log weights: 1 draws in proportion to
#: the weights, less keeps closer to the heaviest rows.
NOISE = 0.1
#: Words whose hashes a task remembers.
MEMORY = 1 << 19
#: Rows that the exact choice of the k-th key may collect at its end.
LAST = 4_096
TOKEN = r"[^\W_]+|[^\w\s]+|_+"


class _Hashes(dict):
    """token -> hash; words in capitals share one."""

    def __missing__(self, token):
        from xxhash import xxh32_intdigest

        if len(self) >= MEMORY:
            self.clear()
        plain = "\x01caps" if len(token) > 1 and token.isupper() else token.lower()
        h = self[token] = xxh32_intdigest(plain.encode("utf-8", "replace"))
        return h


def _grams(text, hashes, find):
    """Buckets of the unigrams and bigrams; a repeated token is one symbol."""
    import numpy as np

    tokens = find(text or "")
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint32, len(tokens))
    if len(h) > 1:
        h[1:][h[1:] == h[:-1]] = 0x5EED
    pairs = (h[:-1] * np.uint32(0x9E3779B1)) ^ (h[1:] + np.uint32(0x7F4A7C15))
    pairs = (pairs ^ (pairs >> np.uint32(15))) * np.uint32(0x85EBCA77)
    # Unigrams take the lower half of the buckets, bigrams the upper half.
    half = np.uint32(1 << (BITS - 1))
    return np.concatenate([(h * np.uint32(0x9E3779B1)) >> np.uint32(33 - BITS), (pairs >> np.uint32(33 - BITS)) + half])


def _sampled(labels: DataFrame, per_label: int) -> DataFrame:
    """(doc_id, quality): a bounded sample of labelled ids, small enough to
    send to every task. Rows with nulls or contradicting labels are left out."""
    one = (labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
           .agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most").drop("_most"))
    sizes = {r["quality"]: r["count"] for r in one.groupBy("quality").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 20)) / float(1 << 20)
    rate = F.lit(0.0)
    for value, n in sizes.items():
        rate = F.when(F.col("quality") == value, min(1.0, per_label / n)).otherwise(rate)
    return one.where(draw < rate)


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, alpha: float = 1.0):
    """(log ratios by bucket, tilt). Without labelled good rows the ratios
    are 0 and every text with words is kept."""
    import re

    import numpy as np

    sample = written(_sampled(labels, per_label))
    tagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id", "left")

    def count(batches):
        import pyarrow as pa

        find, hashes = re.compile(TOKEN).findall, _Hashes()
        raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in slices(batches):
            cols = batch.to_pydict()
            for text, quality in zip(cols["text"], cols["quality"], strict=True):
                g = _grams(text, hashes, find)
                np.add.at(raw, g, 1)
                if quality == 1:
                    np.add.at(target, g, 1)
        used = np.nonzero(raw)[0]
        yield pa.RecordBatch.from_pydict({"b": pa.array(used, pa.int32()), "raw": pa.array(raw[used]), "target": pa.array(target[used])})

    got = (tagged.select("text", "quality").mapInArrow(count, "b int, raw long, target long")
           .groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas())
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    raw[got["b"]], target[got["b"]] = got["raw"], got["target"]
    ratio = np.zeros(1 << BITS)
    half = 1 << (BITS - 1)
    if target.sum():
        for part in (slice(0, half), slice(half, None)):
            r, t = raw[part], target[part]
            # The raw model smooths the target's, so rare n-grams say little.
            p = (r + alpha) / (r.sum() + alpha * half)
            ratio[part] = np.log((t + alpha * half * p * 0.25) / (t.sum() + alpha * half * 0.25)) - np.log(p)
    model = ratio.astype(np.float32)
    marked = weights(tagged.where("quality is not null"), model, "quality").where("grams > 0").select("quality", "weight", "grams").toPandas()
    mean = (marked["weight"] / marked["grams"]).to_numpy()
    return model, best_tilt(mean[marked["quality"] == 1], mean[marked["quality"] == 0])


def best_tilt(good, bad) -> float:
    """The cut with the largest sum of kept good and dropped bad shares, in
    the middle of the gap it lies in. Without both kinds nothing is cut."""
    import numpy as np

    if not len(good) or not len(bad):
        return float("-inf")
    both = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[both[0] - 1], (both[:-1] + both[1:]) / 2])
    kept = 1 - np.searchsorted(np.sort(good), cuts) / len(good)
    dropped = np.searchsorted(np.sort(bad), cuts) / len(bad)
    # Losing clean text weighs more than keeping some junk.
    return float(cuts[int((4 * kept + dropped).argmax())])


def _weigher(shared):
    import re

    find = re.compile(TOKEN).findall

    def run(texts):
        hashes, weight, grams = _Hashes(), [], []
        for text in texts:
            g = _grams(text, hashes, find)
            weight.append(float(shared.value[g].sum(dtype="float64")))
            grams.append(len(g))
        return [weight, grams]

    return run


def weights(docs: DataFrame, model, *more: str) -> DataFrame:
    """(doc_id, weight, grams, *more): log importance weight of every text."""
    run = _weigher(docs.sparkSession.sparkContext.broadcast(model))
    scored, (w, n) = add_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more), "text", run, ["weight double", "grams long"])
    return scored.select("doc_id", F.col(w).alias("weight"), F.col(n).alias("grams"), *more)


def kth_largest(df: DataFrame, col: str, k: int, buckets: int = 4096):
    """The exact k-th largest value of a double column of finite values:
    histograms narrow the range until few rows are left in it."""
    low, high = df.agg(F.min(col), F.max(col)).first()
    above = 0
    while True:
        inside = df.where(F.col(col).between(low, high))
        if low == high:
            return low
        step = (high - low) / buckets
        where = F.least(F.floor((F.col(col) - low) / step), F.lit(buckets - 1))
        rows = sorted(inside.groupBy(where.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("low"), F.max(col).alias("high")).collect(), key=lambda r: -r["at"])
        for r in rows:
            if above + r["n"] >= k:
                break
            above += r["n"]
        low, high = r["low"], r["high"]
        if r["n"] <= LAST:
            values = sorted((x[0] for x in df.where(F.col(col).between(low, high)).select(col).collect()), reverse=True)
            return values[k - above - 1]


def gumbel(seed: int = 0):
    """Noise that depends on doc_id alone."""
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return -F.log(-F.log(u))


def _tilted(weight, grams, tilt: float):
    return weight - F.lit(tilt) * grams if tilt != float("-inf") else F.lit(0.0) * weight


def resample(docs: DataFrame, model, k: int | None = None, seed: int = 0, noise: float = NOISE) -> DataFrame:
    """(doc_id, weight, grams, key, selected) for every row.

    ``weight`` is the log importance weight less the tilt. ``selected`` marks
    the ``k`` largest keys (weight + Gumbel noise); rows that tie with the
    k-th are all marked. By default k is the number of rows of weight >= 0.
    Null texts and texts without tokens have no n-grams, hence no key, and
    are never selected. Repeated rows have equal keys. An empty table gives
    no rows.
    """
    ratio, tilt = model
    scored = written(weights(docs, ratio).withColumn("weight", _tilted(F.col("weight"), F.col("grams"), tilt))
                     .withColumn("key", F.when(F.col("grams") > 0, F.col("weight") + noise * gumbel(seed))))
    least = _threshold(scored, k)
    return scored.withColumn("selected", F.coalesce(F.col("key") >= F.lit(least), F.lit(False)))


def _threshold(scored: DataFrame, k: int | None) -> float:
    usable = scored.where("grams > 0")
    rows, heavy = usable.agg(F.count(F.lit(1)), F.count(F.when(F.col("weight") >= 0, 1))).first()
    k = heavy if k is None else min(k, rows)
    return kth_largest(usable, "key", k) if k else float("inf")


def keep_selected(docs: DataFrame, model, k: int | None = None, seed: int = 0, noise: float = NOISE) -> DataFrame:
    """The rows of ``docs`` that ``resample`` selects, all columns unchanged.
    Texts stay where they are: only weights are gathered for the threshold."""
    ratio, tilt = model
    scored, (w, n) = add_columns(docs, "text", _weigher(docs.sparkSession.sparkContext.broadcast(ratio)), ["weight double", "grams long"])
    tilted = _tilted(F.col(w), F.col(n), tilt)
    keys = written(scored.select(tilted.alias("weight"), F.col(n).alias("grams"), F.when(F.col(n) > 0, tilted + noise * gumbel(seed)).alias("key")))
    kept = scored.where((F.col(n) > 0) & (tilted + noise * gumbel(seed) >= F.lit(_threshold(keys, k))))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
