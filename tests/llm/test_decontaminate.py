import math
import random
import re
from collections import Counter

import numpy as np

from conftest import SF001
from omics_spark.llm import decontaminate as D
from omics_spark.llm.common import table

from .helpers import awkward, prose


def grams(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    k = max(1, min(5, len(w)))
    return list(zip(*(w[i:] for i in range(k))))


def exact(texts, items):
    """{(text, item): similarity} over all windows, no fingerprints."""
    own = {i: Counter(g) for i, t in items.items() if (g := grams(t))}
    holders = Counter(g for c in own.values() for g in c)
    weight = {g: math.log1p(len(own) / n) for g, n in holders.items()}
    found = {}
    for d, text in texts.items():
        words = re.findall(r"[^\W_]+", (text or "").lower())
        for i, mine in own.items():
            size, k = sum(mine.values()), len(next(iter(mine)))
            g = list(zip(*(words[j:] for j in range(k))))
            if not any(x in mine for x in g):
                continue
            total = sum(weight[x] * n for x, n in mine.items())
            best = max(sum(weight[x] * min(n, mine[x]) for x, n in Counter(g[a:a + size]).items() if x in mine) / total
                       for a in range(max(1, len(g) - size + 1)))
            if best >= 0.8 - 1e-9:
                found[d, i] = best
    return found


def searched(texts, items, group=D.GROUP):
    read = D._Words()
    rows, weights = [], Counter()
    for i, t in items.items():
        w = read(t)
        if len(w):
            k = min(5, len(w))
            s = D.shingles_of(w, k)
            rows.append((i, k, len(s), i % max(1, -(-len(items) // group)), s.view(np.int64).tolist()))
            weights.update(set(s.tolist()))
    built = D.build(rows, {h: math.log1p(len(rows) / n) for h, n in weights.items()})
    return {(d, i): sim for d, t in texts.items() for i, _, _, sim in D.search(built, read(t), 0.8)}


def test_against_brute_force(spark):
    docs, items = table(spark, SF001, "documents"), table(spark, SF001, "benchmark")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = exact(texts, {r["item_id"]: r["text"] for r in items.collect()})
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.matches(docs, items).collect()}
    assert found.keys() == want.keys() and want
    assert all(abs(found[k] - want[k]) < 1e-9 for k in want)
    clean = {r["doc_id"] for r in D.decontaminate(docs, items).collect()}
    assert clean == set(texts) - {d for d, _ in want}


def test_several_passes_give_the_same(spark, monkeypatch):
    """Broadcasts of any size, similarity included, also where items share
    openings and a text holds just enough of one."""
    rng = random.Random(9)
    word = [f"w{i}" for i in range(3000)]
    opening = " ".join(rng.choice(word) for _ in range(14))
    own = {i: opening + " " + " ".join(rng.choice(word) for _ in range(26)) for i in range(6)} | {i: " ".join(rng.choice(word) for _ in range(rng.randint(2, 50))) for i in range(6, 30)}
    rows = [(n, " ".join(own[i].split()[cut:]), None, None) for n, (i, cut) in enumerate((i, cut) for i in own for cut in range(9))]
    docs = awkward(spark, rows)
    items = spark.createDataFrame(list(own.items()), "item_id long, text string")
    whole = sorted(map(tuple, D.matches(docs, items).collect()))
    assert {(d, i) for d, i, *_ in whole} == set(exact({r[0]: r[1] for r in rows}, own))
    few = D.indexes
    for chars in (1, 400):
        monkeypatch.setattr(D, "indexes", lambda b, chars=chars: few(b, chars=chars))
        assert sorted(map(tuple, D.matches(docs, items).collect())) == whole


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(2)
    shingles = [D.shingles_of(D._Words()(prose(i + 1, 40)), 5) for i in range(90)]
    group = D.Group(list(enumerate(shingles)), {h: 1.0 for s in shingles for h in s.tolist()})
    prints = group.prints[rng.integers(0, 90, 600)]
    for n in range(600):
        for b in rng.choice(64, int(rng.integers(0, D.RADIUS + 4)), replace=False):
            prints[n] ^= np.uint64(1 << int(b))
    at, item = group.near(prints)
    want = np.nonzero(np.bitwise_count(prints[:, None] ^ group.prints[None, :]) <= D.RADIUS)
    assert sorted(zip(at.tolist(), item.tolist())) == sorted(zip(*(x.tolist() for x in want)))


def test_copies_inside_long_and_odd_texts(spark):
    item = "The quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bank at dawn"
    edited = item.replace("bank", "side")
    rows = [(1, "x " * 20_000 + item.upper().replace(" ", "\n") + " y" * 20_000, None, None), (2, "Before: " + edited + ". After.", None, None),
            (3, " ".join(item.split()[:12]), None, None), (4, item, None, None), (4, item, None, None), (None, item, None, None),
            (5, None, None, None), (6, "", None, None), (7, prose(4, 300), None, None), (8, f"{item} {item}", None, None), (9, "so Swift, a GREEN\ntoad", None, None)]
    docs = awkward(spark, rows)
    items = spark.createDataFrame([(10, item, "z"), (11, None, "z"), (None, item, "z"), (12, "swift a green", "z"), (13, "", "z"), (14, "?!", "z"), (15, "toad", "z")],
                                  "item_id long, text string, m string")
    found = D.matches(docs, items).collect()
    ids = Counter((r["doc_id"], r["item_id"]) for r in found)
    assert ids == {(1, 10): 1, (2, 10): 1, (4, 10): 2, (None, 10): 1, (8, 10): 1, (9, 12): 1, (9, 15): 1}
    assert next(r for r in found if r["doc_id"] == 1)["first_word"] == 20_000
    assert next(tuple(r)[2:] for r in found if r["item_id"] == 12) == (1, 3, 1.0)
    left = D.decontaminate(docs, items)
    assert left.schema == docs.schema and sorted(r["doc_id"] for r in left.collect()) == [3, 5, 6, 7]
    assert D.matches(docs.limit(0), items).count() == D.matches(docs, items.limit(0)).count() == 0
    assert D.decontaminate(docs, items.limit(0)).count() == len(rows)


def test_one_word_changed_at_every_place():
    """Recall against the exact search: a word changed anywhere."""
    rng = random.Random(5)
    want, got, n_cases = {}, {}, 0
    items = {n: " ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(n)) for n in range(20, 61, 4)}
    texts = {}
    for n, text in items.items():
        own, around = text.split(), items[20 + (n - 16) % 44].split()
        for place in range(n):
            texts[n, place] = " ".join(around[:9] + [*own[:place], "changed", *own[place + 1:]] + around[9:16])
    want, got = exact(texts, items), searched(texts, items)
    assert len(want) > 200 and got.keys() <= want.keys()
    assert len(got) >= 0.99 * len(want)
    assert sum(abs(got[k] - want[k]) < 1e-9 for k in got) >= 0.99 * len(want)


def test_items_held_in_part_and_shared_templates():
    """Recall where just enough of an item stands in a text, also where all
    items share half of their words and the text holds but the other half."""
    rng = random.Random(6)
    word = [f"w{i}" for i in range(2000)]
    template = [rng.choice(word) for _ in range(24)]
    items = {i: " ".join((template if i % 2 else []) + [rng.choice(word) for _ in range(rng.randint(15, 50))]) for i in range(40)}
    texts = {}
    for i, text in items.items():
        own = text.split()
        for n in range(9):
            cut = rng.randint(0, len(own) // 2)
            kept = own[cut:] if n % 3 == 0 else own[:len(own) - cut] if n % 3 == 1 else [w if rng.random() < 0.97 else rng.choice(word) for w in own]
            texts[i, n] = " ".join([rng.choice(word) for _ in range(30)] + kept + [rng.choice(word) for _ in range(30)])
    want, got = exact(texts, items), searched(texts, items, group=16)
    assert len(want) > 100 and got.keys() <= want.keys()
    assert len(got) >= 0.99 * len(want)
