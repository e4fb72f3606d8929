"""Packing token pieces into sequences by minimum bin slack.

Documents become token ids in Arrow batches; only longer ones than a sequence
are cut. Lengths are at most the capacity, so the plan needs only their
histogram (one row for each length). Bin by bin, a bitset subset-sum dynamic
programme over the lengths still there finds the fullest feasible content,
which is removed, at once as often as the counts allow. Rows then look up
their place: the n-th piece of a length goes to the n-th slot of that length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, gapless_rank, salts_for, written

#: Word pattern of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLACES = "length long, start_rank long, uses long, times long, first_sequence long, base long"


def encoder(path: str):
    """Text -> token ids (uint32 array) of a byte-level BPE ``tokenizers`` file.

    The vocabulary runs on tiktoken, whose ids are the same and which is four
    times as fast here; special tokens in a text are read as such, as the
    file's own tokenizer does without special tokens added.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    built = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: built.encode_to_numpy(text, allowed_special="all")


def cut(ids, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of the little-endian ids); the first piece
    of a longer document is the shorter one."""
    import zlib

    data, n = memoryview(ids.astype("<u4").tobytes()), len(ids)
    starts = [0, *range(n % capacity or capacity, n, capacity)]
    return [(i, a, b - a, zlib.crc32(data[4 * a:4 * b])) for i, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32); null text counts as empty."""
    state: dict = {}

    def run(texts):
        import numpy as np

        encode = state.get("encode") or state.setdefault("encode", encoder(tokenizer))
        end = np.array([end_id], np.uint32)
        return [[cut(np.concatenate([encode(t or ""), end]), capacity) for t in texts]]

    kind = "p array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint>>"
    cut_up, (name,) = add_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", run, [kind])
    return cut_up.select("doc_id", F.inline(name))


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """[(length, uses)]: a feasible content of the largest total <= room.

    Bit s of a bitset says that some content sums to s. Lengths come largest
    first, copies in powers of two; the search ends once ``room`` is met.
    """
    reach, layers, full = 1, [], (1 << (room + 1)) - 1
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(copies, left)
            layers.append((reach, length, take))
            reach = (reach | reach << (length * take)) & full
            left, copies = left - take, copies * 2
        if reach >> room & 1:
            break
    total, uses = reach.bit_length() - 1, {}
    for before, length, take in reversed(layers):
        if not before >> total & 1:
            total -= length * take
            uses[length] = uses.get(length, 0) + take
    return sorted(uses.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of PLACES: pieces number start_rank .. start_rank + uses * times - 1
    of a length stand ``uses`` to a sequence, from ``base`` on.

    Each bin holds the largest length left and the fullest content for the
    rest; a content is repeated while the counts last, so the steps are
    bounded by the number of lengths, not of pieces.
    """
    counts = {n: c for n, c in histogram.items() if c}
    done = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    while counts:
        largest = max(counts)
        counts[largest] -= 1
        content = dict(fullest(counts, capacity - largest))
        counts[largest] += 1
        content[largest] = content.get(largest, 0) + 1
        times = min(counts[n] // u for n, u in content.items())
        base = 0
        for n, u in sorted(content.items(), reverse=True):
            rows.append((n, done[n], u, times, sequence, base))
            done[n] += u * times
            base += n * u
            counts[n] -= u * times
            if not counts[n]:
                del counts[n]
        sequence += times
    return rows


def place(cut_up: DataFrame, capacity: int = 1024) -> DataFrame:
    """``cut_up`` (from ``pieces``) with sequence_id and offset.

    Pieces of one length are numbered in salted parts, as one length may hold
    most rows. The plan's table has at most a few rows for each length of the
    histogram, whatever the number of pieces.
    """
    spark = cut_up.sparkSession
    histogram = {r["length"]: r["count"] for r in cut_up.groupBy("length").count().collect()}
    rows = plan(histogram, capacity)
    places = F.broadcast(spark.createDataFrame(rows, PLACES))
    keys = ["doc_id", "piece", "start", "ids_crc32"]
    ranked = gapless_rank(cut_up, ["length"], F.xxhash64("doc_id", "piece"), keys, "rank", salts_for(sum(histogram.values())))
    nth = F.col("rank") - F.col("start_rank")
    return (ranked.join(places, "length").where((nth >= 0) & (nth < F.col("uses") * F.col("times")))
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    (F.col("first_sequence") + F.floor(nth / F.col("uses"))).alias("sequence_id"),
                    (F.col("base") + nth % F.col("uses") * F.col("length")).alias("offset")))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Every document gives at least one piece: its ids and ``end_id``; null and
    empty texts are one piece of length 1. Repeated rows are packed as often
    as they occur; a null doc_id stays null. An empty table gives no rows.
    """
    return place(written(pieces(docs, tokenizer, capacity, end_id)), capacity)


def tokenizer_path(spark: SparkSession | None = None) -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
