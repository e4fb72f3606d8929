import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from omics_spark.llm import prefix_trie as T

from .helpers import CLASHES

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(conversations):
    """{(conv_id, depth): row} of {conv_id: [(role, text)]}."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(set)
    for path in members:
        if path:
            kids[path[:-1]].add(path)
    rows = {}
    for path, own in members.items():
        below = [p for p in members if p[:len(path)] == path]
        ends = ",".join(str(c) for c in sorted(own) if len(conversations[c]) == len(path))
        rows[min(own), len(path)] = (min(members[path[:-1]]) if path else None, len(own), len(kids[path]), sum(not kids[p] for p in below),
                                     sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(ends.encode()).hexdigest())
    return rows


def built(spark, rows, rebuild=False, extra=()):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *extra)
    turns = T.written(T.ordered(T.turn_ids(df)))
    if rebuild:
        convs, turns = T.with_shared_heads(turns)
    else:
        convs = turns.groupBy("conv_id").count().withColumnRenamed("count", "n_turns")
    return {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in T.trie(convs, turns).collect()}


def rows_of(conversations):
    return [(c, i, role, text) for c, turns in conversations.items() for i, (role, text) in enumerate(turns)]


def test_against_all_prefixes(spark, monkeypatch):
    rng = random.Random(3)
    conversations = {c: [("user", rng.choice("ab")) if rng.random() < 0.8 else ("assistant", "é" * rng.randint(0, 3)) for _ in range(rng.randint(1, 6))] for c in range(-20, 150)}
    conversations |= {c: conversations[3] for c in range(200, 260)}
    assert built(spark, rows_of(conversations)) == brute(conversations)
    # Short pages, short runs: long conversations over many of both.
    monkeypatch.setattr(T, "PAGE", 2)
    monkeypatch.setattr(T, "RUN", 3)
    monkeypatch.setattr(T, "DEPTHS", 2)
    assert built(spark, rows_of(conversations)) == brute(conversations)


def test_a_long_conversation_over_pages(spark):
    line = [("user", f"turn {i}") for i in range(700)]
    conversations = {1: line, 2: line[:256], 3: line[:512] + [("user", "x")], 4: line, 5: line[:255]}
    assert built(spark, rows_of(conversations)) == brute(conversations)


def test_shared_heads(spark):
    rng = random.Random(5)
    conversations = {c: [("user", f"{c} {i}") for i in range(rng.randint(1, 8))] for c in [*range(0, 30), *range(105, 120), *range(200, 230)]}
    rebuilt = {}
    for c, turns in conversations.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = conversations.get(c - c % 100, [])[:h] + turns[h:]
    assert any(not t for t in rebuilt.values())
    assert built(spark, rows_of(conversations), rebuild=True) == brute(rebuilt)


def test_awkward_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, "", ""), (None, 0, "user", "lost"), (3, 5, "user", "long " * 50_000)]
    conversations = {1: [("", ""), ("user", "a"), ("user", "a")], 2: [("", "")], 3: [("user", "long " * 50_000)]}
    extra = [f"'clash' as `{c}`" for c in [*CLASHES, "node", "page", "depth", "pos"] if c not in ("text",)]
    assert built(spark, rows, extra=extra) == brute(conversations)
    assert built(spark, [r for r in rows if r[0] is None]) == {}


@pytest.mark.parametrize("seed", range(20))
def test_radix_tree_holds_its_keys(seed):
    rng = random.Random(seed)
    width, wide = rng.choice([(2, 256), (3, 4), (6, 60)])
    keys = [bytes(rng.randrange(wide) for _ in range(rng.randint(0, width))) for _ in range(rng.choice([1, 40, 900]))]
    tree = T.RadixTree()
    for n, key in enumerate(keys):
        tree.insert(key, n)
    found, paths, rooms = {}, {}, set()
    for mine, parent, above, ends, node in tree.edges():
        lead = b""
        if parent >= 0:
            up, up_node = paths[parent]
            lead = bytes([next(b for b, n in up_node.children.items() if n is node)])
            assert above == len(up) and up_node.children.get(lead[0]) is node
            lead = up + lead
        paths[mine] = (lead + node.path, node)
        below = list(node.children.items())
        assert [b for b, _ in below] == sorted({b for b, _ in below}) and len(below) <= node.children.room
        assert ends or len(below) > 1, "a chain is one path"
        rooms.add(node.children.room)
        for e in ends:
            found[e] = lead + node.path
    assert found == dict(enumerate(keys))
    assert seed or rooms


def test_layouts_grow():
    node, rooms = T.Node(b""), []
    for b in random.Random(1).sample(range(256), 256):
        node.children = node.children.add(b, T.Node(bytes([b])))
        rooms.append(node.children.room)
        assert node.children.get(b).path == bytes([b])
    assert rooms == [4] * 4 + [16] * 12 + [48] * 32 + [256] * 208
