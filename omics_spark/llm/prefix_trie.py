"""Prefix trie of conversations, built from adaptive radix trees.

A turn (role and text) becomes an id of fixed width, 16 big-endian bytes of
its MD5, and a conversation the string of its turns' ids. Strings are dealt by
sorted ranges, so a first turn or a whole conversation that many share spreads
over many tasks; each task builds an adaptive radix tree over each run of its
sorted strings. Inner nodes grow through layouts of 4, 16, 48 and 256
children, and chains of single children are one compressed path. Only byte
depths that are whole turns become nodes of the trie. A node on the border of
two runs comes out of both and is summed by its id.

Long conversations are cut into pages of PAGE turns. The ids of a page stand
after the identity of all turns before it, so no key is longer than a page.

What a node's subtree holds is summed over its members: every node belongs to
its smallest member, so a subtree's total is that of its members, without what
the node's own conversation has above it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_of_id, grouped_streams, positions, slices, written

#: Bytes of a turn id; turns in a page.
WIDTH, PAGE = 16, 256
#: Keys in one radix tree.
RUN = 8_192
#: Depths summed in one window.
DEPTHS = 4_096
ROOT = bytes(WIDTH)


class Sorted:
    """Up to 4 or 16 children: their bytes, sorted, beside them."""

    def __init__(self, room: int):
        self.room, self.bytes, self.nodes = room, bytearray(), []

    def get(self, byte: int):
        at = bisect_left(self.bytes, byte)
        return self.nodes[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def add(self, byte: int, node):
        if len(self.bytes) == self.room:
            grown = Sorted(16) if self.room == 4 else Indexed()
            for b, n in self.items():
                grown.add(b, n)
            return grown.add(byte, node)
        at = bisect_left(self.bytes, byte)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def items(self):
        return zip(self.bytes, self.nodes, strict=True)


class Indexed:
    """Up to 48 children: the place of each byte's child, plus one."""

    room = 48

    def __init__(self):
        self.places, self.nodes = bytearray(256), []

    def get(self, byte: int):
        place = self.places[byte]
        return self.nodes[place - 1] if place else None

    def add(self, byte: int, node):
        if len(self.nodes) == self.room:
            grown = Direct()
            for b, n in self.items():
                grown.add(b, n)
            return grown.add(byte, node)
        self.nodes.append(node)
        self.places[byte] = len(self.nodes)
        return self

    def items(self):
        return [(b, self.nodes[p - 1]) for b, p in enumerate(self.places) if p]


class Direct:
    """Up to 256 children, by byte."""

    room = 256

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def add(self, byte: int, node):
        self.nodes[byte] = node
        return self

    def items(self):
        return [(b, n) for b, n in enumerate(self.nodes) if n is not None]


class Node:
    """``path``: the bytes that all keys below share; ``ends``: numbers of
    the keys that end here."""

    __slots__ = ("children", "ends", "path")

    def __init__(self, path: bytes, ends: list[int] | None = None):
        self.path, self.ends, self.children = path, ends if ends is not None else [], Sorted(4)

    def split(self, at: int) -> None:
        """The first ``at`` bytes stay here, the rest goes one node down."""
        lower = Node(self.path[at + 1:], self.ends)
        lower.children = self.children
        byte, self.path, self.ends, self.children = self.path[at], self.path[:at], [], Sorted(4)
        self.children = self.children.add(byte, lower)


def _shared(path: bytes, key: bytes, at: int) -> int:
    """How many bytes of ``path`` stand in ``key`` from ``at`` on."""
    if key.startswith(path, at):
        return len(path)
    low, high = 0, min(len(path), len(key) - at)
    while low < high:  # the first ``low`` bytes are known to be shared
        mid = (low + high + 1) // 2
        if key.startswith(path[:mid], at):
            low = mid
        else:
            high = mid - 1
    return low


class RadixTree:
    """Adaptive radix tree over byte strings, each with a number."""

    def __init__(self):
        self.root: Node | None = None

    def insert(self, key: bytes, number: int) -> None:
        if self.root is None:
            self.root = Node(key, [number])
            return
        node, at = self.root, 0
        while True:
            n = _shared(node.path, key, at)
            if n < len(node.path):
                node.split(n)
            at += n
            if at == len(key):
                node.ends.append(number)
                return
            below = node.children.get(key[at])
            if below is None:
                node.children = node.children.add(key[at], Node(key[at + 1:], [number]))
                return
            node, at = below, at + 1

    def edges(self) -> Iterator[tuple[int, int, int, list[int], Node]]:
        """(number of the node, of its parent or -1, bytes above its edge,
        its own ends, the node), parents first. The edge of a child is the
        byte that leads to it and its path."""
        stack, count = [] if self.root is None else [(-1, 0, 0, self.root)], 0
        while stack:
            parent, above, lead, node = stack.pop()
            mine, count = count, count + 1
            yield mine, parent, above, node.ends, node
            below = above + lead + len(node.path)
            stack.extend((mine, below, 1, child) for _, child in node.children.items())


def turn_ids(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, turn_id, chars) of each row of ``messages`` (conv_id,
    turn, role, text); null role or text is empty, rows of no conv_id go."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return (messages.where("conv_id is not null")
            .select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.md5(said.cast("binary"))).alias("turn_id"),
                    F.length(text).cast("long").alias("chars")))


def ordered(ids: DataFrame) -> DataFrame:
    """``ids`` with ``pos``, from 0 by turn, nulls first, ties by turn id."""
    return positions(ids, "conv_id", [F.col("turn"), F.col("turn_id")], "pos").select("conv_id", "pos", "turn_id", "chars")


def with_shared_heads(turns: DataFrame, group: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) where each conversation c opens with the first
    h turns of conversation c - c % ``group`` in place of its own first h;
    h = crc32(decimal c) % (``most`` + 1). A base hands out ``most`` turns at
    most, to fewer than 2 ``group`` conversations, so the join stays small
    whatever the length of a conversation."""
    c = F.col("conv_id")
    convs = (turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
             .withColumns({"base": c - c % group, "h": crc32_of_id("conv_id") % (most + 1)}))
    heads = (turns.where((F.col("pos") < most) & (c % group == 0))
             .select(c.alias("base"), "pos", "turn_id", "chars"))
    sizes = heads.groupBy("base").agg(F.count(F.lit(1)).alias("given"))
    plan = (convs.join(sizes, "base", "left")
            .withColumn("given", F.least(F.col("h"), F.coalesce(F.col("given"), F.lit(0)))))
    own = (turns.join(plan.select("conv_id", "h", "given"), "conv_id").where(F.col("pos") >= F.col("h"))
           .select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "turn_id", "chars"))
    given = (plan.join(heads, "base").where(F.col("pos") < F.col("given"))
             .select("conv_id", "pos", "turn_id", "chars"))
    total = (F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long")
    return plan.select("conv_id", total.alias("n_turns")), own.unionByName(given)


def _identity(*columns: str):
    return F.unhex(F.md5(F.concat_ws(",", *(F.col(c).cast("string") for c in columns)).cast("binary")))


def pages(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, page, key, chars, next, last): the turn ids of each page
    after the identity of all turns before it, and the identity ``next`` of
    all turns to its end; ``last`` marks a conversation's last page.

    A page's identity is made of running sums over its conversation's pages,
    one small row each, of two hashes of (page, ids).
    """
    cut = (turns.withColumn("page", F.floor(F.col("pos") / PAGE).cast("long"))
           .groupBy("conv_id", "page").agg(F.sort_array(F.collect_list(F.struct("pos", "turn_id", "chars"))).alias("t"))
           .select("conv_id", "page", F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["turn_id"])), "")).alias("ids"),
                   F.col("t.chars").alias("chars")))
    silent = (conversations.where("n_turns = 0")
              .select("conv_id", F.lit(0).cast("long").alias("page"), F.lit(b"").alias("ids"), F.array().cast("array<bigint>").alias("chars")))
    alone = (F.col("page") == 0) & (F.size("chars") < PAGE)
    root, none = F.lit(ROOT), F.lit(None).cast("binary")
    short = cut.where(alone).unionByName(silent).select("conv_id", "page", F.concat(root, "ids").alias("key"), "chars", none.alias("next"), F.lit(True).alias("last"))
    wide = "decimal(20,0)"
    long = cut.where(~alone).withColumns({"a": F.xxhash64("page", "ids").cast(wide), "b": F.xxhash64("ids", "page", F.lit("b")).cast(wide)})
    upto = Window.partitionBy("conv_id").orderBy("page")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    sums = (long.select("conv_id", "page", "a", "b")
            .select("conv_id", "page", F.lead("page").over(upto).isNull().alias("last"),
                    *(F.sum(c).over(upto.rowsBetween(Window.unboundedPreceding, 0)).alias(f"{c}1") for c in ("a", "b")),
                    *(F.sum(c).over(before).alias(f"{c}0") for c in ("a", "b")))
            .withColumn("previous", F.col("page") - 1)
            .select("conv_id", "page", "last", F.when(F.col("page") == 0, root).otherwise(_identity("previous", "a0", "b0")).alias("prefix"),
                    _identity("page", "a1", "b1").alias("next")))
    long = (long.join(sums, ["conv_id", "page"])
            .select("conv_id", "page", F.concat("prefix", "ids").alias("key"), "chars", "next", "last"))
    return short.unionByName(long)


def _run_nodes(batch, sums: list[str]) -> tuple:
    """The turn-aligned nodes of one run of pages, as columns."""
    from hashlib import md5

    column = {name: batch.column(name).to_pylist() for name in ("conv_id", "page", "key", "chars", "next", *sums)}
    tree = RadixTree()
    for number, key in enumerate(column["key"]):
        tree.insert(key, number)
    above, parent_of, lengths, members = [], [], [], []
    for _, parent, start, ends, node in tree.edges():
        parent_of.append(parent)
        above.append(start)
        lengths.append((parent >= 0) + len(node.path))
        # (smallest member, number of a key that stands for all, sums)
        members.append([min((column["conv_id"][e] for e in ends), default=None), ends[0] if ends else None,
                        [sum(column[s][e] for e in ends) for s in sums]])
    for mine in range(len(members) - 1, 0, -1):
        low, key, held = members[mine]
        up = members[parent_of[mine]]
        up[0] = low if up[0] is None else min(low, up[0])
        up[1] = key if up[1] is None else up[1]
        up[2] = [x + y for x, y in zip(up[2], held, strict=True)]
    nodes, parents, depths, chars, lows, held = [], [], [], [], [], []
    for start, length, (low, number, total) in zip(above, lengths, members, strict=True):
        key, page, parent = column["key"][number], column["page"][number], None
        for at in range((start // WIDTH + 1) * WIDTH, start + length + 1, WIDTH):
            depth = at // WIDTH - 1
            if depth == 0:
                node = key[:WIDTH]
                if page:
                    parent = node
                    continue
            else:
                parent = parent or (key[:WIDTH] if depth == 1 else md5(key[:at - WIDTH]).digest())
                node = column["next"][number] if depth == PAGE else md5(key[:at]).digest()
            nodes.append(node)
            parents.append(parent)
            depths.append(page * PAGE + depth)
            chars.append(column["chars"][number][depth - 1] if depth else 0)
            lows.append(low)
            held.append(total)
            parent = node
    return nodes, parents, depths, chars, lows, *([t[i] for t in held] for i in range(len(sums)))


def tree_nodes(paged: DataFrame, sums: list[str]) -> DataFrame:
    """(node, parent, depth, chars, conv_id, sums): the nodes of the trie over
    ``paged``, with the smallest member and the members' ``sums``."""
    schema = "node binary, parent binary, depth long, chars long, conv_id long" + "".join(f", {s} long" for s in sums)

    def run(batches):
        import pyarrow as pa

        kinds = [pa.binary(), pa.binary(), *[pa.int64()] * (3 + len(sums))]
        names = ["node", "parent", "depth", "chars", "conv_id", *sums]
        for batch in slices(batches, RUN):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(_run_nodes(batch, sums), kinds, strict=True)], names=names)

    dealt = (paged.select("conv_id", "page", "key", "chars", "next", *sums)
             .repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id"))
    return (dealt.mapInArrow(run, schema).groupBy("node")
            .agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("chars").alias("chars"),
                 F.min("conv_id").alias("conv_id"), *(F.sum(s).alias(s) for s in sums)))


def ends_of(paged: DataFrame) -> DataFrame:
    """(node, ends_sha256): the hash of the decimal ids of the conversations
    that end at a node, ascending, joined by commas."""
    end = (F.when(F.size("chars") == 0, F.lit(ROOT)).when(F.size("chars") == PAGE, F.col("next"))
           .otherwise(F.unhex(F.md5("key"))))

    def fold(node, rows):
        import hashlib

        h, comma = hashlib.sha256(), b""
        for _, conv in rows:
            h.update(comma + str(conv).encode())
            comma = b","
        return node, h.hexdigest()

    return grouped_streams(paged.where("last").select(end.alias("node"), "conv_id"), "node", ["conv_id"], "node binary, ends_sha256 string", fold)


def trie(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the prefix trie, one row each: conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    ``conversations``: (conv_id, n_turns), each once; ``turns``: (conv_id,
    pos from 0 without gaps, turn_id, chars). A conversation without turns
    ends at the root. Without conversations there are no nodes, no root
    either. (conv_id, depth) names a node.
    """
    paged = written(pages(conversations, turns))
    nodes = written(tree_nodes(paged.withColumn("n_convs", F.lit(1).cast("long")), ["n_convs"]))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    # A node's tokens saved, and those that its conversation saves above it.
    block = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    saves = nodes.join(children, "node", "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)), "saved": (F.col("n_convs") - 1) * F.col("chars"), "block": F.floor(F.col("depth") / DEPTHS)})
    blocks = (saves.groupBy("conv_id", "block").agg(F.sum("saved").alias("sum"))
              .select("conv_id", "block", F.coalesce(F.sum("sum").over(block), F.lit(0)).alias("before")))
    saves = written(saves.join(blocks, ["conv_id", "block"])
                    .withColumn("above", F.col("before") + F.coalesce(F.sum("saved").over(within), F.lit(0)))
                    .drop("block", "before"))
    owners = (saves.groupBy("conv_id").agg(F.sum("saved").alias("saved_below"), F.sum((F.col("n_children") == 0).cast("long")).alias("n_leaves"))
              .where("saved_below > 0 or n_leaves > 0"))
    below = tree_nodes(paged.join(owners, "conv_id"), ["saved_below", "n_leaves"]).select("node", "saved_below", "n_leaves")
    up = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (saves.join(below, "node", "left").join(ends_of(paged), "node", "left").join(up, "parent", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"),
                    (F.coalesce("saved_below", F.lit(0)) - F.col("above")).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256")))
