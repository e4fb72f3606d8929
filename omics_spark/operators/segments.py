"""Seeded segments: the seeds of C4 are extended in the task that finds them
(P2, P3).

Subjects are dealt out in blocks, queries in parts, and a task meets one block
with one part: it looks up the k-mers of the block among those of the part,
scores every diagonal that a seed lies on from end to end, and gives the best
segments of each pair. So sequences are shuffled, and neither seeds nor
diagonals nor windows of letters.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.seq import COMPLEMENT_FROM, COMPLEMENT_TO, tiles
from .kmers import NUCLEOTIDES, RESIDUES

#: Letters of a block of subjects and of a part of queries, at most but for one
#: sequence, letters of a piece of a subject, letters and seeds looked at
#: together and bytes of windows that are compared together.
LETTERS, SPAN, PORTION, SEEDS, COMPARED = 1 << 23, 1 << 16, 1 << 20, 1 << 21, 1 << 19
#: Letters compared in one look-up; as many follow each sequence that match nothing.
STEP = 16
COLUMNS = ("q_frame int, s_frame int, strand string, diag bigint, raw_score int, q_start int, q_end int, s_start bigint, "
           "align_length int, identities int, q_len int, split boolean")


def _step_table() -> np.ndarray:
    """By which of ``STEP`` letters match (+1, else -1): their best prefix,
    best suffix, best run and sum (plus ``STEP``), in six bits each."""
    pattern = np.arange(1 << STEP)
    total, prefix, run, best = (np.zeros(len(pattern), np.int32) for _ in range(4))
    low = np.zeros(len(pattern), np.int32)
    for i in range(STEP):
        x = np.where(pattern >> i & 1, 1, -1).astype(np.int32)
        total += x
        run = np.maximum(run, 0) + x
        best, prefix, low = np.maximum(best, run), np.maximum(prefix, total), np.minimum(low, total)
    return (prefix | (total - low) << 6 | best << 12 | (total + STEP) << 18).astype(np.int32)


def words(letters: np.ndarray, table: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, codes) of the k-mers of ``letters``; a letter whose number in
    ``table`` is 0 is in none."""
    c = table[letters]
    n = len(c) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, done, power, size = None, 0, c, 1
    while True:         # words of 1, 2, 4 ... letters, put together as k asks
        if k & size:
            part = power[done:done + n]
            code = part.copy() if code is None else code << bits * size | part
            done += size
        if done == k:
            break
        power = power[:-size] << bits * size | power[size:]
        size *= 2
    gaps = np.concatenate([[0], np.cumsum(c == 0)])
    where = np.flatnonzero(gaps[k:] == gaps[:-k])
    return where, code[where]


def joined(texts: list[str], pad: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of texts, each followed by ``STEP`` times ``pad``, where each begins and how long it is."""
    size = np.array([len(x) for x in texts], np.int64)
    raw = (pad * STEP).join([*texts, ""]).encode("latin-1", "replace")
    return np.frombuffer(raw, np.uint8), np.cumsum(size + STEP) - size - STEP, size


def spread(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The places ``first``, ``first`` + 1, ... of each row, as many as its count."""
    return np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def windows(q: np.ndarray, s: np.ndarray, q_at: np.ndarray, s_at: np.ndarray, length: np.ndarray):
    """Portions (rows, matches) of windows that begin at ``q_at`` and ``s_at``,
    those of about one length together: of each row which letters match, and
    what follows it up to a multiple of ``STEP``, which does not."""
    steps = -(-length // STEP)
    order = np.argsort(steps.astype(np.uint16) if len(steps) and steps.max() < 1 << 16 else steps, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(steps[order])) + 1, [len(order)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if a == b:
            continue
        width = int(steps[order[a]]) * STEP
        views = [np.lib.stride_tricks.as_strided(x, (len(x) - width + 1, width), (1, 1), writeable=False) for x in (q, s)]
        some = max(1, COMPARED // width)
        for i in range(a, b, some):
            rows = order[i:min(i + some, b)]
            yield rows, views[0][q_at[rows]] == views[1][s_at[rows]]


def best_scores(q, s, q_at, s_at, length, table: np.ndarray) -> np.ndarray:
    """The score of the best run (+1 a match, else -1) of each window."""
    out = np.zeros(len(q_at), np.int32)
    for rows, same in windows(q, s, q_at, s_at, length):
        patterns = np.packbits(same, axis=1, bitorder="little").view(np.uint16).T.astype(np.intp)
        now, best = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int32)
        for p in patterns:
            v = table.take(p)
            np.maximum(best, now + (v & 63), out=best)
            np.maximum(best, v >> 12 & 63, out=best)
            now = np.maximum(now + (v >> 18) - STEP, v >> 6 & 63)
        out[rows] = best
    return out


def best_runs(q, s, q_at, s_at, length) -> tuple[np.ndarray, np.ndarray]:
    """Where the best run of each window begins and ends (the first end that
    reaches the best score, the last begin that does)."""
    begin, end = np.zeros(len(q_at), np.int64), np.zeros(len(q_at), np.int64)
    for rows, same in windows(q, s, q_at, s_at, length):
        kind = np.int16 if same.shape[1] < 1 << 14 else np.int32
        sums = np.zeros((len(rows), same.shape[1] + 1), kind)
        np.cumsum(same.astype(np.int8) * np.int8(2) - np.int8(1), axis=1, dtype=kind, out=sums[:, 1:])
        low = np.minimum.accumulate(sums[:, :-1], axis=1)
        j = np.argmax(sums[:, 1:] - low, axis=1)
        least = low[np.arange(len(rows)), j]
        at = (sums[:, :-1] == least[:, None]) & (np.arange(same.shape[1]) <= j[:, None])
        begin[rows], end[rows] = same.shape[1] - 1 - np.argmax(at[:, ::-1], axis=1), j
    return begin, end


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before in some key."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in keys])
    return new


def enough(q: np.ndarray, s: np.ndarray, raw: np.ndarray, top: int) -> np.ndarray:
    """Rows that score no less than the best ``top`` subjects of their query."""
    order = np.lexsort((-raw, s, q))
    order = order[firsts(q[order], s[order])]
    order = order[np.lexsort((-raw[order], q[order]))]
    start = np.flatnonzero(firsts(q[order]))
    size = np.diff(np.append(start, len(order)))
    last = raw[order[start + np.minimum(size, top) - 1]]
    bar = np.where(size >= top, last, 0)
    return raw >= bar[np.searchsorted(q[order[start]], q)]


def seeded_segments(queries: DataFrame, subjects: DataFrame, k: int, nucleotide: bool = True, both_strands: bool = False,
                    share: float = 1.0, top: int | None = None, min_raw: int = 1) -> DataFrame:
    """Best ungapped segments (+1 a match, -1 else) of the diagonals that the
    seeds of ``kmer_join`` lie on, each taken from end to end. ``queries``
    (q_id, q_frame, seq), ``subjects`` (s_id, s_frame, seq), upper case, an id
    and frame stand for one sequence: (q_id, s_id, q_frame, s_frame, strand,
    diag, raw_score, q_start, q_end, s_start, align_length, identities, q_len,
    split).

    Of a pair of ids the best one (ties to the smaller frames, strand and
    diagonal), with ``share`` < 1 all that score that share of it; with ``top``
    only those that may be among the best ``top`` subjects of a query, which a
    top-k finishes. A subject that is cut into pieces (``split``) gives these
    for each piece, so the choice among them is left to the caller."""
    bits, alphabet = (3, NUCLEOTIDES) if nucleotide else (5, RESIDUES)
    if bits * k > 63:
        raise ValueError(f"k-mers of {k} letters do not fit in a long")
    asked, longest = queries.agg(F.sum(F.length("seq")), F.max(F.length("seq"))).first()
    held = subjects.agg(F.sum(F.length("seq"))).first()[0] or 1
    asked, longest, span = asked or 1, max(longest or 1, 1), max(SPAN, longest or 1)
    sc = queries.sparkSession.sparkContext
    parts, blocks, tasks = -(-asked // LETTERS), -(-held // LETTERS), 8 * sc.defaultParallelism
    while parts * blocks < tasks:       # by what costs less letters
        if asked * blocks <= held * parts:
            blocks *= 2
        else:
            parts *= 2
    q = queries.where(F.length("seq") >= k).select("q_id", "q_frame", "seq")
    q = q.withColumns({"_part": F.pmod(F.xxhash64("q_id"), F.lit(parts)), "_block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    s = subjects.where(F.length("seq") >= k).select("s_id", "s_frame", tiles(F.col("seq"), span, longest).alias("_t"))
    s = s.select("s_id", "s_frame", (F.size("_t") > 1).alias("split"), F.posexplode("_t").alias("tile", "seq"))
    s = s.withColumns({"_part": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))),
                       "_block": F.pmod(F.xxhash64("s_id", "tile"), F.lit(blocks)).cast("int")})
    names = [x.schema[c].dataType.simpleString() for x, c in ((q, "q_id"), (s, "s_id"))]
    kinds = [to_arrow_type(x.schema[c].dataType) for x, c in ((q, "q_id"), (s, "s_id"))]

    def run(asks, block):
        import pyarrow as pa
        import pyarrow.compute as pc

        table, comp = np.zeros(256, np.int64), np.arange(256).astype(np.uint8)
        for n, c in enumerate(alphabet):
            table[ord(c)] = n + 1
        for a, b in zip(COMPLEMENT_FROM, COMPLEMENT_TO, strict=True):
            comp[ord(a)] = ord(b)

        def answer(t, p, diagonal, raw):
            """Rows of the segments on diagonals of query strands ``t`` and pieces ``p``."""
            row, minus = t % len(q_size), t >= len(q_size)
            low, length = np.maximum(-diagonal, 0), window_of(t, p, diagonal)
            begin, end = best_runs(q_raw, s_raw, q_begin[t] + low, s_begin[p] + diagonal + low, length)
            whole = diagonal + tile[p] * span
            size = end - begin + 1
            columns = [q_frame[row], s_frame[p], np.where(minus, "-", "+"), whole, raw, low + begin, low + end + 1,
                       whole + low + begin, size, (size + raw) // 2, q_size[row], split[p]]
            return pa.table([q_names.take(pa.array(q_who[row])), s_names.take(pa.array(s_who[p])),
                             *(pa.array(x).cast(f.type) for x, f in zip(columns, rest, strict=True))], schema=nothing.schema)

        kind_of = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        rest = [pa.field(n, kind_of[x]) for n, x in (c.split() for c in COLUMNS.split(", "))]
        nothing = pa.schema([("q_id", kinds[0]), ("s_id", kinds[1]), *rest]).empty_table()
        if not asks.num_rows or not block.num_rows:
            return nothing

        def named(column):
            """Distinct ids in order, and the number of each row's."""
            ids = column.combine_chunks()
            found = ids.unique()
            found = found.take(pc.sort_indices(found, null_placement="at_start"))
            return found, pc.index_in(ids, value_set=found, skip_nulls=False).to_numpy(zero_copy_only=False).astype(np.int64)

        def once(t, *keys):
            """Of rows equal in the keys one, in order."""
            _, first = np.unique(np.stack(keys, 1), axis=0, return_index=True)
            return first, [x[first] for x in keys], t.take(pa.array(first))

        # query strands: all forward ones, then all reverse ones
        q_names, who = named(asks["q_id"])
        _, (q_who, q_frame), asks = once(asks, who, asks["q_frame"].to_numpy().astype(np.int64))
        q_raw, q_begin, q_size = joined(asks["seq"].to_pylist(), "\0")
        if both_strands:
            back = np.concatenate([comp[q_raw[:len(q_raw) - STEP][::-1]], np.zeros(STEP, np.uint8)])
            q_begin = np.concatenate([q_begin, 2 * len(q_raw) - STEP - q_begin - q_size])
            q_raw = np.concatenate([q_raw, back])
        placed = np.argsort(q_begin)
        places, code = words(q_raw, table, k, bits)
        if not len(code):
            return nothing
        order = np.argsort(code)
        code, places = code[order], places[order]
        asked_by = placed[np.searchsorted(q_begin[placed], places, "right") - 1]
        q_pos = places - q_begin[asked_by]
        first = np.flatnonzero(firsts(code))
        known, times = code[first], np.diff(np.append(first, len(code)))
        mixer, small = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - 22)
        some = np.zeros(1 << 22, bool)
        some[(known.astype(np.uint64) * mixer >> small).astype(np.intp)] = True

        s_names, who = named(block["s_id"])
        _, (s_who, s_frame, tile), block = once(block, who, block["s_frame"].to_numpy().astype(np.int64), block["tile"].to_numpy().astype(np.int64))
        s_raw, s_begin, s_size = joined(block["seq"].to_pylist(), "\1")
        split = block["split"].to_numpy(zero_copy_only=False)
        far = int(q_size.max())
        base = far + np.cumsum(s_size + far) - s_size - far     # a diagonal may begin before its piece
        shift = int(base[-1] + s_size[-1] + far).bit_length()
        step_table = _step_table()
        q_length = np.concatenate([q_size, q_size])

        def window_of(t, p, diagonal):
            """Letters of the window on a diagonal."""
            return np.minimum(q_length[t], s_size[p] - diagonal) - np.maximum(-diagonal, 0)

        def keys_of(where, word):
            """(query strand, diagonal) of the seeds of words at places, as one number each, in order."""
            piece = np.searchsorted(s_begin, where, "right") - 1
            local = where - s_begin[piece]
            n = times[word]
            seed = spread(n, first[word])
            diagonal = np.repeat(local, n) - q_pos[seed]
            key = asked_by[seed] << shift | np.repeat(base[piece], n) + diagonal
            mine = (diagonal < span) & ((diagonal >= 0) | np.repeat(tile[piece] == 0, n))
            key = np.sort(key if mine.all() else key[mine])
            return key[firsts(key)]

        def chosen(key):
            """(query strand, piece, diagonal, score) of the segments that may be given."""
            t, v = key >> shift, key & (1 << shift) - 1
            p = np.searchsorted(base - far, v, "right") - 1
            diagonal = v - base[p]
            low = np.maximum(-diagonal, 0)
            raw = best_scores(q_raw, s_raw, q_begin[t] + low, s_begin[p] + diagonal + low, window_of(t, p, diagonal), step_table)
            new = firsts(t, p)
            start, run_of = np.flatnonzero(new), np.cumsum(new) - 1
            best = np.maximum.reduceat(raw, start)
            if share < 1:       # of a pair all strands and pieces at hand
                pair = q_who[t[start] % len(q_size)] * len(s_names) + s_who[p[start]]
                order = np.argsort(pair, kind="stable")
                group = firsts(pair[order])
                tops = np.maximum.reduceat(best[order], np.flatnonzero(group))
                best[order] = tops[np.cumsum(group) - 1]
                keep = np.flatnonzero((raw >= share * best[run_of]) & (raw >= min_raw))
                return t[keep], p[keep], diagonal[keep], raw[keep]
            keep = np.flatnonzero(raw == best[run_of])
            keep = keep[firsts(run_of[keep])]
            keep = keep[raw[keep] >= min_raw]
            return of_pairs(t[keep], p[keep], diagonal[keep], raw[keep])

        def of_pairs(t, p, diagonal, raw):
            """The best of each pair, and what ``top`` leaves of them."""
            row = t % len(q_size)
            asker, found = q_who[row], s_who[p]
            order = np.lexsort((diagonal + tile[p] * span, t >= len(q_size), s_frame[p], q_frame[row], -raw, found, asker))
            order = order[firsts(asker[order], found[order])]
            if top is not None and len(order):
                order = order[enough(asker[order], found[order], raw[order], top)]
            return t[order], p[order], diagonal[order], raw[order]

        kept, tables, a = [], [], 0
        upto = np.append(s_begin, len(s_raw))
        while a < len(s_size):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + PORTION, "right")) - 1)
            where, code = words(s_raw[upto[a]:upto[b]], table, k, bits)
            hit = some[(code.astype(np.uint64) * mixer >> small).astype(np.intp)]
            where, code = where[hit] + upto[a], code[hit]
            order = np.argsort(code)            # so that look-ups go through the known words once
            where, code = where[order], code[order]
            word = np.minimum(np.searchsorted(known, code), len(known) - 1)
            hit = known[word] == code
            where, word = where[hit], word[hit]
            order = np.argsort(where)
            where, word = where[order], word[order]
            piece = np.searchsorted(s_begin, where, "right") - 1
            seeds = np.cumsum(times[word])
            i = 0
            while i < len(where):
                # as many whole pieces as hold SEEDS seeds, or one, in portions
                j = int(np.searchsorted(seeds, (seeds[i - 1] if i else 0) + SEEDS, "right"))
                if j < len(where):
                    whole = int(np.searchsorted(piece, piece[j], "left"))
                    j = whole if whole > i else int(np.searchsorted(piece, piece[i], "right"))
                keys, c = None, i
                while c < j:
                    d = min(j, max(c + 1, int(np.searchsorted(seeds, (seeds[c - 1] if c else 0) + SEEDS, "right"))))
                    more = keys_of(where[c:d], word[c:d])
                    keys = more if keys is None else np.union1d(keys, more)
                    c = d
                i = j
                if keys is None or not len(keys):
                    continue
                best = chosen(keys)
                if top is None:
                    tables.append(answer(*best))
                else:
                    kept.append(best)
            if len(kept) > 16:
                kept = [of_pairs(*(np.concatenate(x) for x in zip(*kept, strict=True)))]
            a = b
        if kept:
            tables.append(answer(*of_pairs(*(np.concatenate(x) for x in zip(*kept, strict=True)))))
        return pa.concat_tables(tables) if tables else nothing

    # groups are few and much work: their number of partitions is set here
    n = min(parts * blocks, max(4 * sc.defaultParallelism, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    q, s = (x.repartition(n, "_block", "_part") for x in (q, s))
    return q.groupBy("_block", "_part").cogroup(s.groupBy("_block", "_part")).applyInArrow(
        run, f"q_id {names[0]}, s_id {names[1]}, {COLUMNS}")
