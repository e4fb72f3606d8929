import itertools
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from conftest import SF001
from omics_spark.llm import bin_packing as B
from omics_spark.llm.common import table

from .helpers import awkward

PATH = B.tokenizer_path()


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_ids_are_the_tokenizers(spark):
    t, encode = Tokenizer.from_file(PATH), B.encoder(PATH)
    texts = [r["text"] for r in table(spark, SF001, "documents").collect()]
    texts += ["", " ", "a<|endoftext|>b <|endoftext|>", "\n\n  x  \t y", "日本語 ñ é ́ 🙂", "it's we'll I'M", "a" * 5000, "1234567 ...!!!", "\x00\x7f  "]
    for text in texts:
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def check(rows, docs, capacity):
    """Round trip: pieces, checksums, gapless sequences."""
    t = Tokenizer.from_file(PATH)
    want = sorted((i, n, a, len(p), zlib.crc32(np.array(p, "<u4").tobytes()))
                  for i, text in docs for ids in [ids_of(t, text)]
                  for first in [len(ids) % capacity or capacity]
                  for n, a in enumerate([0, *range(first, len(ids), capacity)])
                  for p in [ids[a:first if n == 0 else a + capacity]])
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_round_trip_and_fill(spark):
    docs = table(spark, SF001, "documents")
    rows = B.pack(docs, PATH, 1024).collect()
    n = check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 1024)
    assert n <= 1 + 1.02 * -(-sum(r["length"] for r in rows) // 1024)


def test_awkward_rows(spark):
    docs = awkward(spark)
    plain = [(-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in docs.collect()]
    for capacity in (1, 7, 1024):
        check(B.pack(docs.where("doc_id is null or doc_id not in (4, 8)") if capacity < 1024 else docs, PATH, capacity).collect(),
              [x for x in plain if capacity == 1024 or x[0] not in (4, 8)], capacity)
    assert B.pack(docs.limit(0), PATH).count() == 0


def test_fullest_against_all_contents():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 60)
        best = max(t for u in itertools.product(*(range(c + 1) for c in counts.values())) if (t := sum(n * k for n, k in zip(counts, u))) <= room)
        got = B.fullest(counts, room)
        assert sum(n * u for n, u in got) == best and all(u <= counts[n] for n, u in got)


def test_plan_uses_every_piece_once():
    rng = random.Random(2)
    for _ in range(30):
        capacity = rng.randint(5, 200)
        counts = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(1, 30))}
        rows = B.plan(counts, capacity)
        fill, bins = {}, 0
        for length, start, uses, times, sequence, base in rows:
            fill.setdefault(sequence, [times, 0])
            assert fill[sequence][0] == times and fill[sequence][1] == base
            fill[sequence][1] += uses * length
            bins = max(bins, sequence + times)
        assert all(f <= capacity for _, f in fill.values()) and sum(t for t, _ in fill.values()) == bins
        for length, n in counts.items():
            spans = sorted((s, s + u * t) for m, s, u, t, _, _ in rows if m == length)
            assert [a for a, _ in spans] == [0, *(b for _, b in spans[:-1])] and spans[-1][1] == n
        first_fit: list[int] = []
        for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            k = next((k for k, f in enumerate(first_fit) if f + n <= capacity), None)
            if k is None:
                first_fit.append(n)
            else:
                first_fit[k] += n
        assert bins <= 1 + 1.02 * len(first_fit)


def test_a_third_of_the_rows_of_one_length(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'same words here' else repeat('word ', cast(id % 300 as int)) end as text")
    rows = B.pack(docs, PATH, 256).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 256)
