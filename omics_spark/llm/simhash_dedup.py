"""SimHash near-duplicates through a Gray-order hierarchical index.

1. Each text gets a 64-bit fingerprint of its word shingles (Arrow batches).
2. Distinct fingerprints are sorted by Gray rank and cut into pages. In Gray
   order neighbours differ in few bits, so a page shares many: the shared
   bits are its (mask, pattern) node. Page nodes are the upper level of the
   index, nodes of 4096 and 64 codes inside a page the lower levels.
3. A fingerprint visits only nodes whose pattern it meets with at most
   ``max_bits`` differences under the node's mask. A child's mask contains
   its parent's, so the differences accumulate on the way down and whole
   groups fall away.
4. A page returns a spanning forest of its links, never all its pairs; the
   forests of all pages are joined by star contraction.

Every step is exact: each two fingerprints within ``max_bits`` end up in one
component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, orderable, written

#: Codes in a page: 256 KB of codes in one row.
PAGE = 32_768
#: Page nodes sent to every task (24 bytes each); beyond it pages grow.
MAX_PAGES = 65_536
FAN = 64


def simhash(text: str | None, shingle: int, piece: int = 65_536) -> int:
    """Unsigned fingerprint: a bit is 1 if set in over half the shingle hashes.

    A-Z are lower-cased, words end at ASCII white space, shingles repeat.
    Shorter texts are one shingle; texts without words give 0.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, piece):
        part = words[at:at + min(piece, n - at) + shingle - 1]
        if len(part) < shingle:
            grams = [tuple(part)]
        else:
            grams = zip(*(part[i:] for i in range(shingle)), strict=False)
        h = np.fromiter((xxh64_intdigest(b" ".join(g), 42) for g in grams), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def text_hash():
    """Tells the texts of rows with one doc_id apart (null ids included)."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("text"))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): fp as the signed long of the same bits."""

    def run(cols):
        signed = [v - (1 << 64) if v >> 63 else v for v in (simhash(t, shingle) for t in cols["text"])]
        return {"doc_id": cols["doc_id"], "text_hash": cols["text_hash"], "fp": signed}

    wanted = docs.select(F.col("doc_id").cast("long"), F.col("text"), text_hash().alias("text_hash"))
    return map_batches(wanted, "doc_id long, text_hash long, fp long", run)


def gray_rank(fp):
    """Position of a code in Gray order, as a long that sorts like it."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def _node(codes):
    """(mask, pattern) of the bits that all codes share."""
    import numpy as np

    spread = np.bitwise_or.reduce(codes ^ codes[0])
    return ~spread, codes[0] & ~spread


def _levels(codes):
    """Nodes over runs of 4096 and of 64 codes: [(run, masks, patterns)]."""
    import numpy as np

    out = []
    for run in (FAN * FAN, FAN):
        starts = np.arange(0, len(codes), run)
        first = codes[starts]
        spread = np.bitwise_or.reduceat(codes ^ np.repeat(first, np.diff(np.append(starts, len(codes)))), starts)
        out.append((run, ~spread, first & ~spread))
    return out


def _spread(starts, sizes):
    """Row number and value of every member of the ranges start..start+size."""
    import numpy as np

    rows = np.repeat(np.arange(len(sizes)), sizes)
    return rows, np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def _search(probes, codes, levels, max_bits, skip=None, pairs=1 << 15):
    """Yields (probe number, code number) arrays of links, a piece at a time.

    ``skip(probe numbers, leaf numbers)`` may drop leaves that cannot add to
    what is already linked.
    """
    import numpy as np

    (run, masks, patterns), (leaf, low_masks, low_patterns) = levels
    step = max(1, pairs * 8 // max(1, len(masks)))
    for at in range(0, len(probes), step):
        part = probes[at:at + step]
        near = np.bitwise_count((part[:, None] ^ patterns) & masks) <= max_bits
        p, node = np.nonzero(near)
        per = run // leaf
        for k in range(0, len(p), max(1, pairs // per)):
            pk, nk = p[k:k + max(1, pairs // per)], node[k:k + max(1, pairs // per)]
            rows, leaves = _spread(nk * per, np.minimum(per, len(low_masks) - nk * per))
            who = pk[rows]
            ok = np.bitwise_count((part[who] ^ low_patterns[leaves]) & low_masks[leaves]) <= max_bits
            who, leaves = who[ok], leaves[ok]
            if skip is not None and len(who):
                ok = ~skip(at + who, leaves)
                who, leaves = who[ok], leaves[ok]
            rows, members = _spread(leaves * leaf, np.minimum(leaf, len(codes) - leaves * leaf))
            who = who[rows]
            ok = np.bitwise_count(part[who] ^ codes[members]) <= max_bits
            if ok.any():
                yield at + who[ok], members[ok]


def _merge(root, a, b):
    """Joins the sets of a[i] and b[i]; ``root`` points at set minima."""
    import numpy as np

    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def page_links(codes, probes, max_bits: int):
    """Spanning links of one page: within it, and to ``probes`` from others.

    ``codes``: distinct uint64 in Gray order. Returns (a, b) code arrays.
    """
    import numpy as np

    levels = _levels(codes)
    root = np.arange(len(codes))
    leaf_start = np.arange(0, len(codes), FAN)
    step = 2048
    for at in range(0, len(codes), step):
        # A leaf that is one component already adds nothing to a member of it.
        low = np.minimum.reduceat(root, leaf_start)
        high = np.maximum.reduceat(root, leaf_start)
        own = root[at:at + step].copy()
        same = lambda p, leaf: (low[leaf] == high[leaf]) & (low[leaf] == own[p])  # noqa: E731, B023
        for p, m in _search(codes[at:at + step], codes, levels, max_bits, same):
            _merge(root, p + at, m)
    inner = np.nonzero(root != np.arange(len(codes)))[0]
    a, b = [codes[inner]], [codes[root[inner]]]
    for p, m in _search(probes, codes, levels, max_bits):
        # One link for each component that the probe reaches.
        pair = np.unique(np.stack([p, root[m]]), axis=1)
        a.append(probes[pair[0]])
        b.append(codes[pair[1]])
    return np.concatenate(a), np.concatenate(b)


def _pages(distinct: DataFrame, page: int, n: int) -> DataFrame:
    """(page long, mask long, pattern long, codes binary), in Gray order."""
    import math

    def run(batches):
        import numpy as np
        import pandas as pd

        held = np.empty(0, np.int64)

        def row(codes):
            mask, pattern = _node(codes)
            # A code belongs to one page only, so its smallest code names it.
            return {"page": codes[0].view(np.int64), "mask": mask.view(np.int64),
                    "pattern": pattern.view(np.int64), "codes": codes.tobytes()}

        for pdf in batches:
            held = np.concatenate([held, pdf["fp"].to_numpy(np.int64)])
            while len(held) >= page:
                yield pd.DataFrame([row(held[:page].view(np.uint64))])
                held = held[page:]
        if len(held):
            yield pd.DataFrame([row(np.ascontiguousarray(held).view(np.uint64))])

    ranked = distinct.select("fp", gray_rank(F.col("fp")).alias("_rank"))
    return (ranked.repartitionByRange(max(1, math.ceil(n / page)), "_rank").sortWithinPartitions("_rank")
            .select("fp").mapInPandas(run, "page long, mask long, pattern long, codes binary"))


def links(distinct: DataFrame, max_bits: int = 2, page: int = PAGE) -> DataFrame:
    """(a, b): spanning links between distinct fingerprints ``fp``.

    Two fingerprints are in one component of these links exactly if a chain
    of steps of at most ``max_bits`` differing bits joins them.
    """
    import numpy as np

    n = distinct.count()
    page = max(page, -(-n // MAX_PAGES))
    pages = written(_pages(distinct, page, n))
    # The upper nodes: bounded by MAX_PAGES and a short page per partition.
    nodes = sorted((r.page, r.mask, r.pattern) for r in pages.select("page", "mask", "pattern").collect())
    ids, masks, patterns = (np.array([x[i] for x in nodes], np.int64) for i in range(3))
    masks, patterns = masks.view(np.uint64), patterns.view(np.uint64)

    def route(batches):
        import pandas as pd

        for pdf in batches:
            for own, raw in zip(pdf["page"], pdf["codes"], strict=True):
                codes = np.frombuffer(raw, np.uint64)
                for to in np.nonzero(ids > own)[0]:  # each two pages meet once
                    near = np.bitwise_count((codes ^ patterns[to]) & masks[to]) <= max_bits
                    if near.any():
                        yield pd.DataFrame([{"page": ids[to], "probes": codes[near].tobytes()}])

    def search(key, page_rows, probe_rows):
        import pandas as pd

        if not len(page_rows):
            return pd.DataFrame({"a": [], "b": []})
        codes = np.frombuffer(page_rows["codes"].iloc[0], np.uint64)
        probes = np.frombuffer(b"".join(probe_rows["probes"]), np.uint64)
        a, b = page_links(codes, probes, max_bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    probes = pages.select("page", "codes").mapInPandas(route, "page long, probes binary")
    return (pages.select("page", "codes").groupBy("page")
            .cogroup(probes.groupBy("page")).applyInPandas(search, "a long, b long"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): connected components, root the smallest node.

    Alternating large-star and small-star rounds; each joins nodes with the
    minimum of their neighbours (an aggregation, so a node with very many
    links stays divisible) and writes its edges as a table.
    """
    def state(df):
        r = df.agg(F.count(F.lit(1)).alias("n"),
                   F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))).alias("s")).first()
        return r["n"], r["s"]

    def star(e, large: bool):
        """u > v in e. Large: neighbours above u move to u's minimum; small:
        neighbours below u (and u) do."""
        if large:
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
            moved = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            low = e.groupBy("u").agg(F.min("v").alias("m"))
            moved = (e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .union(low.select("u", F.col("m").alias("v"))))
        return moved.where("u <> v").distinct()

    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = state(e)
    for _ in range(max_rounds):
        e = written(star(star(e, True), False))
        now = state(e)
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, page: int = PAGE) -> DataFrame:
    """(doc_id, fp, component_id, text_hash, root) for every row of ``docs``.

    component_id is the smallest doc_id that a chain of links reaches, its
    own included; root names the component by a fingerprint. Null and empty
    texts have fingerprint 0 and link like any other. Rows with a null doc_id
    take part; a component of only such rows has a null component_id.
    Repeated rows come out as often as they go in. An empty table gives an
    empty table.
    """
    fps = written(fingerprints(docs, shingle))
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(distinct.select("fp"), max_bits, page))
    owner = (distinct.join(roots, distinct["fp"] == roots["node"], "left")
             .select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    lowest = owner.groupBy("root").agg(F.min("rep").alias("component_id"))
    return fps.join(owner.join(lowest, "root").select("fp", "root", "component_id"), "fp")


def deduplicate(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id,
    of repeated ids that of the smallest text hash, of repeated rows one.
    Columns stay as they are."""
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("best")
    keep = (near_duplicates(docs, shingle, max_bits).groupBy("root").agg(best)
            .select(F.coalesce("best.doc_id", F.lit(-1)).alias("_id"), F.col("best.text_hash").alias("_text")))
    tagged = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_id"), text_hash().alias("_text"),
                         F.struct("*").alias("row"), F.xxhash64(*orderable(docs)).alias("_content"))
    first = Window.partitionBy("_id", "_text").orderBy("_content")
    return (tagged.join(keep, ["_id", "_text"]).withColumn("_nth", F.row_number().over(first))
            .where("_nth = 1").select("row.*"))


def hex_of(fp) -> F.Column:
    """16 lowercase hex digits of the fingerprint's bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
