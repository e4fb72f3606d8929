"""Benchmark decontamination: SimHash of item-sized windows, multi-index
Hamming search, exact weighted-shingle similarity.

An item of n words is looked for in windows of n words of a document. A window
gets a SimHash of its five-word shingles, weighted by how few items hold them;
shingles that no item of its size holds weigh nothing, so the words round an
edit do not blur it. Fingerprints are cut into ``BLOCKS`` blocks; two that
differ by at most ``RADIUS`` bits differ by at most ``FLIPS`` in some block,
so the tables of each block's neighbours find all of them. What is found is
verified exactly: the weight of the item's shingles that the window holds,
repeats included, over the weight of all of them.

With a fifth of an item's weight gone, fingerprints differ by 9 of 64 bits on
average, give or take 3; the radius leaves room for five times that spread
(tests measure what is lost against the exact search over all windows).

Items of one size are kept in groups of about ``GROUP``; the fingerprints of a
group depend on its own items and on weights counted over the whole benchmark,
so it does not matter which groups share a broadcast. Windows are cut only
where a document holds enough known weight to be verified; this changes no
result. Words are runs of letters and digits, lower case. An item of under
five words is one shingle, and is found where its words stand in a row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, map_batches, slices, written

SHINGLE, SIMILARITY = 5, 0.8
#: Room for the rounding of sums: a similarity equal to the least one counts.
SLACK = 1e-9
#: 8 blocks of 8 bits with at most two differences each: 8 * 3 - 1 bits.
BLOCKS, FLIPS, RADIUS = 8, 2, 23
#: Items of one size that share their fingerprints' weights and tables.
GROUP = 4_096
#: Characters of benchmark text in one broadcast, which every task gets; a
#: larger benchmark is searched in several passes. Changes no result.
INDEX_CHARS = 16_000_000
#: Window ends that are fingerprinted at once.
ENDS = 8_192
#: Hashes of words that a task remembers.
MEMORY = 1 << 19
WORD = r"[^\W_]+"
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


class _Hashes(dict):
    def __missing__(self, word):
        from xxhash import xxh64_intdigest

        if len(self) >= MEMORY:
            self.clear()
        h = self[word] = xxh64_intdigest(word.encode("utf-8", "replace"))
        return h


class _Words:
    """Text -> 64-bit hashes of its words."""

    def __init__(self):
        import re

        self.find, self.hashes = re.compile(WORD).findall, _Hashes()

    def __call__(self, text):
        import numpy as np

        words = self.find((text or "").lower())
        return np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))


def shingles_of(words, width: int):
    """64-bit hashes of the runs of ``width`` words, one per position."""
    import numpy as np

    n = max(0, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for i, m in enumerate(MULTIPLIERS[:width]):
        out += words[i:i + n] * np.uint64(m)
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _votes(shingles, weights):
    """Running sums, from zero, of each shingle's weight for and against
    each of the 64 bits."""
    import numpy as np

    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64) * 2 - 1
    return np.vstack([np.zeros((1, 64)), np.cumsum(bits * weights[:, None], axis=0)])


def _prints(votes):
    import numpy as np

    return np.packbits(np.round(votes, 6) > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


class Group:
    """Items of one size: [(id, shingles)], with ``weights`` (shingle ->
    weight over the whole benchmark)."""

    def __init__(self, items: list[tuple[int, object]], weights: dict[int, float]):
        import numpy as np

        self.ids, self.size = [i for i, _ in items], len(items[0][1])
        self.own = []
        for _, s in items:
            known, times = np.unique(s, return_counts=True)
            w = np.array([weights[h] for h in known.tolist()])
            self.own.append((known, times, w))
        self.totals = np.array([float((w * n).sum()) for _, n, w in self.own])
        self.prints = np.array([_prints(_votes(s, np.array([weights[h] for h in s.tolist()]))[-1:])[0] for _, s in items], np.uint64)
        # By block and key: the items whose block differs by FLIPS bits at most, as bits.
        apart = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])
        keys = self.prints.view(np.uint8).reshape(-1, BLOCKS)
        self.tables = [np.packbits(apart[:, keys[:, b]] <= FLIPS, axis=1) for b in range(BLOCKS)]

    def near(self, prints):
        """(place in ``prints``, item) of all items within RADIUS bits."""
        import numpy as np

        keys = prints.view(np.uint8).reshape(-1, BLOCKS)
        found = self.tables[0][keys[:, 0]]
        for b in range(1, BLOCKS):
            found = found | self.tables[b][keys[:, b]]
        at, item = np.nonzero(np.unpackbits(found, axis=1, count=len(self.ids)))
        ok = np.bitwise_count(self.prints[item] ^ prints[at]) <= RADIUS
        return at[ok], item[ok]

    def similarity(self, item: int, window) -> float:
        """Weight of the item's shingles that the window holds, of 1."""
        import numpy as np

        own, n, w = self.own[item]
        there, m = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(there, own), len(there) - 1)
        both = np.where(there[at] == own, np.minimum(n, m[at]), 0)
        return float((w * both).sum() / self.totals[item])

    def search(self, shingles, places, weights, similarity: float) -> list[tuple[int, int, float]]:
        """[(item, first word, similarity)] in a document with this group's
        shingles at ``places``: for each item found the best window, the
        first of equals."""
        import numpy as np

        # A document shorter than the items is a window of its own. The first
        # of the best windows ends with a shingle of the item.
        size = min(self.size, len(shingles))
        starts = np.unique(np.maximum(places - size + 1, 0))
        low, high = np.searchsorted(places, starts), np.searchsorted(places, starts + size)
        sums = np.append(0.0, np.cumsum(weights))
        enough = np.nonzero(sums[high] - sums[low] >= similarity * self.totals.min() - SLACK)[0]
        best: dict[int, tuple[float, int]] = {}
        for part in (enough[i:i + ENDS] for i in range(0, len(enough), ENDS)):
            first, end = low[part[0]], high[part].max()
            votes = _votes(shingles[places[first:end]], weights[first:end])
            prints = _prints(votes[high[part] - first] - votes[low[part] - first])
            for at, item in zip(*(x.tolist() for x in self.near(prints)), strict=True):
                have = best.get(item, (0.0, 0))[0]
                if have < 1.0:
                    start = int(starts[part[at]])
                    sim = self.similarity(item, shingles[start:start + size])
                    if sim >= similarity - SLACK and sim > have:
                        best[item] = sim, start
        return [(item, start, sim) for item, (sim, start) in best.items()]


class Index:
    """Groups of items whose shingles are of ``width`` words, by shingle."""

    def __init__(self, width: int, groups: list[Group]):
        import numpy as np

        self.width, self.groups = width, groups
        held, by, weights = [], [], []
        for g, group in enumerate(groups):
            known = np.unique(np.concatenate([own for own, _, _ in group.own]))
            weight = dict(z for own, _, w in group.own for z in zip(own.tolist(), w.tolist(), strict=True))
            held.append(known)
            by.append(np.full(len(known), g))
            weights.append([weight[h] for h in known.tolist()])
        held, by, weights = np.concatenate(held), np.concatenate(by), np.concatenate(weights)
        order = np.lexsort((by, held))
        self.by, self.weights = by[order], weights[order]
        self.known, first = np.unique(held[order], return_index=True)
        self.first = np.append(first, len(held))
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.known >> np.uint64(44)).astype(np.int64)] = True
        self.least = np.array([g.totals.min() for g in groups])

    def place(self, shingles):
        """Positions that hold an item's shingle, and which."""
        import numpy as np

        at = np.nonzero(self.gate[(shingles >> np.uint64(44)).astype(np.int64)])[0]
        where = np.minimum(np.searchsorted(self.known, shingles[at]), len(self.known) - 1)
        ok = self.known[where] == shingles[at]
        return at[ok], where[ok]

    def search(self, words, similarity: float) -> Iterator[tuple[int, int, int, float]]:
        """(item id, first word, words, similarity) of the items found."""
        import numpy as np

        shingles = shingles_of(words, self.width)
        at, where = self.place(shingles)
        if not len(at):
            return
        n = self.first[where + 1] - self.first[where]
        entries = np.arange(n.sum()) + np.repeat(self.first[where] - np.cumsum(n) + n, n)
        places, by, weights = np.repeat(at, n), self.by[entries], self.weights[entries]
        held = np.bincount(by, weights, len(self.groups))
        for g in np.nonzero(held >= similarity * self.least - SLACK)[0].tolist():
            group, mine = self.groups[g], by == g
            for item, start, sim in group.search(shingles, places[mine], weights[mine], similarity):
                yield group.ids[item], start, group.size + self.width - 1, sim


def read_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, chars, width, shingles) of the items that have a word."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")

    def run(columns):
        import numpy as np

        read = _Words()
        words = [read(t) for t in columns["text"]]
        widths = [min(SHINGLE, len(w)) for w in words]
        return {"item_id": columns["item_id"], "chars": [len(t) for t in columns["text"]], "width": widths,
                "shingles": [shingles_of(w, max(1, k)).view(np.int64).tolist() for w, k in zip(words, widths, strict=True)]}

    return map_batches(items, "item_id long, chars long, width int, shingles array<bigint>", run).where("width > 0")


def build(items: list[tuple[int, int, int, int, list]], weights: dict[int, float]) -> list[Index]:
    """Indexes over (item_id, width, size, bucket, shingles)."""
    import numpy as np

    groups: dict[tuple, list] = {}
    for item_id, width, size, bucket, shingles in items:
        groups.setdefault((width, size, bucket), []).append((item_id, np.array(shingles, np.int64).view(np.uint64)))
    return [Index(width, [Group(mine, weights) for (w, *_), mine in sorted(groups.items()) if w == width])
            for width in sorted({w for w, *_ in groups})]


def indexes(benchmark: DataFrame, chars: int = INDEX_CHARS) -> Iterator:
    """Broadcast lists of indexes over ``benchmark``, each of at most about
    ``chars`` characters (one group at least). Null ids and items without a
    word take no part."""
    import math

    import numpy as np

    items = written(read_items(benchmark))
    holders = items.select(F.explode(F.array_distinct("shingles")).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    size = F.size("shingles").alias("size")
    # One row for each size of items.
    sizes = items.groupBy("width", size).agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).orderBy("width", "size").collect()
    total = sum(r["n"] for r in sizes)
    buckets = {(r["width"], r["size"]): -(-r["n"] // GROUP) for r in sizes}
    if not sizes:
        return
    table = benchmark.sparkSession.createDataFrame([(w, s, b) for (w, s), b in buckets.items()], "width int, size int, buckets int")
    grouped = (items.select("item_id", "width", size, "shingles").join(table, ["width", "size"])
               .withColumn("bucket", F.pmod(F.xxhash64("item_id"), F.col("buckets")).cast("int")).drop("buckets"))
    parts: list[list[tuple]] = [[]]
    filled = 0
    for r in sizes:
        for bucket in range(n := buckets[r["width"], r["size"]]):
            if filled and filled + r["chars"] // n > chars:
                parts.append([])
                filled = 0
            parts[-1].append((r["width"], r["size"], bucket))
            filled += r["chars"] // n
    for part in parts:
        wanted = benchmark.sparkSession.createDataFrame(part, "width int, size int, bucket int")
        mine = grouped.join(wanted, ["width", "size", "bucket"])
        rows = mine.orderBy("item_id", "shingles").select("item_id", "width", "size", "bucket", "shingles").collect()
        counts = mine.select(F.explode("shingles").alias("s")).distinct().join(holders, "s").collect()
        weights = {int(np.int64(r["s"]).view(np.uint64)): math.log1p(total / r["n"]) for r in counts}
        yield benchmark.sparkSession.sparkContext.broadcast(cloudpickle.dumps(build([tuple(r) for r in rows], weights)))


def search(built: list[Index], words, similarity: float) -> list[tuple[int, int, int, float]]:
    return [found for index in built for found in index.search(words, similarity)]


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): one row for each
    document row and item found in it, with the best window.

    Null and short texts match nothing; rows with a null doc_id keep it.
    Repeated rows and repeated items each give their rows. Empty tables give
    no rows.
    """
    found = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, first_word long, n_words long, similarity double")
    for shared in indexes(benchmark):
        def run(texts, shared=shared, state={}):  # noqa: B006  (one for each task)
            if not state:
                state.update(built=cloudpickle.loads(shared.value), read=_Words())
            return [[search(state["built"], state["read"](t), similarity) for t in texts]]

        one, (name,) = add_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", run,
                                   ["m array<struct<item_id: bigint, first_word: bigint, n_words: bigint, similarity: double>>"])
        found = found.unionAll(one.select("doc_id", F.inline(name)))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns unchanged."""
    for shared in indexes(benchmark):
        def clean(batches, shared=shared, at=docs.columns.index("text")):
            import pyarrow as pa

            built, read = cloudpickle.loads(shared.value), _Words()
            for batch in slices(batches):
                yield batch.filter(pa.array([not search(built, read(t), similarity) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
