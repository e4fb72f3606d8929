"""K-mer operators: C4 seed join, D6 k-mer counts.

Sequences are rows (id, seq). K-mers come from ``posexplode``-style
explosion (:func:`kmer_rows`) so every step stays a DataFrame join /
aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.seq import COMPLEMENT_FROM, COMPLEMENT_TO, revcomp, tiles


def explode_kmers(df: DataFrame, k: int, id_col: str = "seq_id", seq_col: str = "seq",
                  both_strands: bool = False) -> DataFrame:
    """(id, strand, pos, kmer); ``pos`` is 0-based on the given strand's
    sequence (for '-' on the reverse complement)."""
    plus = df.select(F.col(id_col).alias("id"), F.lit("+").alias("strand"),
                     F.upper(F.col(seq_col)).alias("_s"))
    parts = plus
    if both_strands:
        parts = plus.unionByName(df.select(F.col(id_col).alias("id"), F.lit("-").alias("strand"),
                                           revcomp(F.upper(F.col(seq_col))).alias("_s")))
    return kmer_rows(parts, "_s", k).select("id", "strand", "pos", "kmer")


#: Letters of a piece that :func:`kmer_rows` cuts k-mers from.
PIECE = 64


def kmer_rows(df: DataFrame, seq: str, k: int) -> DataFrame:
    """One row per k-mer of ``seq``, in its place ``pos`` (0-based) and
    ``kmer`` and the other columns: the rows of ``functions.seq.kmers``, but
    pieces and places become rows one after the other, so no sequence's
    k-mers are held as one array."""
    others = [c for c in df.columns if c != seq]
    x = df.select(*others, F.posexplode(tiles(F.col(seq), PIECE, k - 1)).alias("_t", "_piece")).where(F.length("_piece") >= k)
    x = x.select(*others, "_t", "_piece", F.explode(F.sequence(F.lit(1), F.length("_piece") - k + 1)).alias("_i"))
    return x.select(*others, (F.col("_t") * PIECE + F.col("_i") - 1).alias("pos"), F.substring("_piece", F.col("_i"), F.lit(k)).alias("kmer"))


#: Alphabets that fit in few bits a letter, and k-mers put into one Arrow batch.
NUCLEOTIDES, RESIDUES = "ACGTUN", "ABCDEFGHIJKLMNOPQRSTUVWXYZ*-"
ROWS = 1 << 18


def packed_kmers(df: DataFrame, k: int, id_col: str = "seq_id", seq_col: str = "seq",
                 both_strands: bool = False, nucleotide: bool = True) -> DataFrame:
    """(id, strand, pos, kmer) with each k-mer packed into one long: 3 bits a
    nucleotide (k to 21), 5 bits a residue (k to 12). A k-mer with a letter
    outside the alphabet is none. ``pos`` is 0-based on the given strand's
    sequence (for '-' on the reverse complement). Codes of a whole sequence
    come from ``k`` shifts of numpy arrays; sequences go out in pieces."""
    letters, bits = (NUCLEOTIDES, 3) if nucleotide else (RESIDUES, 5)
    if bits * k > 63:
        raise ValueError(f"k-mers of {k} letters do not fit in a long")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = np.zeros(256, np.int64)
        for n, c in enumerate(letters):
            table[ord(c)] = table[ord(c.lower())] = n + 1
        other = np.zeros(256, np.uint8)
        for a, b in zip("ACGTUNacgtun", "TGCAANtgcaan", strict=True):
            other[ord(a)] = ord(b)

        def codes(raw):
            """(positions, codes) of a sequence, in pieces."""
            for at in range(0, len(raw) - k + 1, ROWS):
                c = table[raw[at:at + ROWS + k - 1]]
                n = len(c) - k + 1
                code, ok = np.zeros(n, np.int64), np.ones(n, bool)
                for i in range(k):
                    part = c[i:i + n]
                    code = code << bits | part
                    ok &= part > 0
                where = np.flatnonzero(ok)
                yield where + at, code[where]

        def flush(parts):
            ids, strands, places, found = zip(*parts, strict=True)
            counts = [len(p) for p in places]
            return pa.RecordBatch.from_arrays([
                pa.concat_arrays(ids).take(pa.array(np.repeat(np.arange(len(counts)), counts))),
                pa.array(np.repeat(np.array(strands) == "-", counts)),
                pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(found))], names=["id", "minus", "pos", "kmer"])

        for batch in batches:
            parts, rows = [], 0
            for n, text in enumerate(batch.column(1).to_pylist()):
                raw = np.frombuffer((text or "").encode("latin-1", "replace"), np.uint8)
                for strand in ("+", "-") if both_strands else ("+",):
                    for places, found in codes(raw if strand == "+" else other[raw[::-1]]):
                        parts.append((batch.column(0).slice(n, 1), strand, places, found))
                        rows += len(places)
                        if rows >= ROWS:
                            yield flush(parts)
                            parts, rows = [], 0
            if parts:
                yield flush(parts)

    kind = df.schema[id_col].dataType.simpleString()
    found = df.select(F.col(id_col).alias("id"), F.col(seq_col).cast("string").alias("seq")).mapInArrow(
        run, f"id {kind}, minus boolean, pos int, kmer long")
    return found.select("id", F.when(F.col("minus"), "-").otherwise("+").alias("strand"), "pos", "kmer")


def frequent_kmers(subject_kmers: DataFrame, max_freq: int) -> DataFrame:
    """K-mers seen more than ``max_freq`` times in the subjects (the mask).
    Counted with partial aggregation, so a hot k-mer is one row per task."""
    return (subject_kmers.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > max_freq).select("kmer"))


def kmer_join(queries: DataFrame, subjects: DataFrame, k: int, max_freq: int | None = None,
              both_strands: bool = True, q_id: str = "seq_id", s_id: str = "seq_id",
              q_seq: str = "seq", s_seq: str = "seq", nucleotide: bool = True) -> DataFrame:
    """C4: shared-k-mer seeds (q_id, s_id, strand, q_pos, s_pos).

    All seeds are given: an equi-join on the k-mer as one long (AQE splits
    skewed partitions on both sides); a longer ``k`` is the way to fewer
    chance seeds. Only on request, ``max_freq`` masks subject k-mers that
    occur more often. On the '-' strand, ``q_pos`` is on the reverse
    complement of the query. Longer k-mers than a long holds are strings.
    """
    if k * (3 if nucleotide else 5) <= 63:
        sk = packed_kmers(subjects, k, s_id, s_seq, nucleotide=nucleotide)
        qk = packed_kmers(queries, k, q_id, q_seq, both_strands, nucleotide)
    else:
        sk, qk = explode_kmers(subjects, k, s_id, s_seq), explode_kmers(queries, k, q_id, q_seq, both_strands)
    sk = sk.select(F.col("id").alias("s_id"), F.col("pos").alias("s_pos"), "kmer")
    qk = qk.select(F.col("id").alias("q_id"), "strand", F.col("pos").alias("q_pos"), "kmer")
    if max_freq is not None:
        mask = frequent_kmers(sk, max_freq)
        sk = sk.join(mask, "kmer", "left_anti")
        qk = qk.join(mask, "kmer", "left_anti")
    return qk.join(sk, "kmer", "inner").select("q_id", "s_id", "strand", "q_pos", "s_pos")


#: Subject letters that a task of :func:`best_diagonals` indexes, query letters
#: it takes at most, letters of a piece of a subject and seeds held at once.
INDEXED, ASKED, SPAN, SEEDS = 1 << 24, 1 << 25, 1 << 16, 1 << 21


def best_diagonals(queries: DataFrame, subjects: DataFrame, k: int, top: int, q_id: str = "seq_id", s_id: str = "seq_id",
                   q_seq: str = "seq", s_seq: str = "seq", tasks: int = 32) -> DataFrame:
    """The seeds of :func:`kmer_join` (nucleotides, both strands), counted by
    diagonal where they are found: (q_id, s_id, strand, diag, n_seeds). Of a
    query (its ids are distinct) only diagonals that can be among its ``top``
    ones by seeds, then s_id, strand and diagonal, leave a task; ``top_k``
    finishes the choice.

    Subjects are cut into pieces that own the diagonals beginning in them
    (with as many letters more as the longest query has) and dealt out in
    blocks, queries in parts; a task meets one block with one part. So what is
    shuffled are sequences, and never a seed. Seeds are all pairs of equal
    k-mers still, but only ``SEEDS`` of them, or those of one k-mer, are held."""
    if 3 * k > 63:
        raise ValueError(f"k-mers of {k} letters do not fit in a long")
    asked, longest = queries.agg(F.sum(F.length(q_seq)), F.max(F.length(q_seq))).first()
    held = subjects.agg(F.sum(F.length(s_seq))).first()[0] or 1
    longest = max(longest or 1, 1)
    span = max(SPAN, longest)
    blocks = -(-held // INDEXED)
    parts = max(-(-(asked or 1) // ASKED), -(-tasks // blocks))

    def run(asks, block):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table, other = np.zeros(256, np.int64), np.zeros(256, np.uint8)
        for n, c in enumerate(NUCLEOTIDES):
            table[ord(c)] = table[ord(c.lower())] = n + 1
        for a, b in zip("ACGTUNacgtun", "TGCAANtgcaan", strict=True):
            other[ord(a)] = ord(b)

        def joined(texts):
            """Letters of texts, one zero after each, and where each begins."""
            texts = [x or "" for x in texts]
            sizes = np.array([len(x) + 1 for x in texts], np.int64)
            return np.frombuffer(("\0".join(texts) + "\0").encode("latin-1", "replace"), np.uint8), np.cumsum(sizes) - sizes

        def codes(raw):
            """(places, codes) of the k-mers of letters."""
            c = table[raw]
            n = max(len(c) - k + 1, 0)
            code, ok = np.zeros(n, np.int64), np.ones(n, bool)
            for i in range(k):
                part = c[i:i + n]
                code = code << 3 | part
                ok &= part > 0
            where = np.flatnonzero(ok)
            return where, code[where]

        def summed(keys, counts=None):
            """Distinct keys, in order, and how often each is there."""
            if counts is not None:
                order = np.argsort(keys, kind="stable")
                keys, counts = keys[order], counts[order]
            else:
                keys = np.sort(keys)
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            return keys[first], np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first)

        nothing = pa.table([pa.array([], kind_q), pa.array([], kind_s), pa.array([], pa.string()), pa.array([], pa.int32()),
                            pa.array([], pa.int64())], names=["q_id", "s_id", "strand", "diag", "n_seeds"])
        if not asks.num_rows or not block.num_rows:
            return nothing
        # distinct ids of the block in order, and pieces of one id and place as one stretch of diagonals
        ids = block["s_id"].combine_chunks()
        names = ids.unique()
        names = names.take(pc.sort_indices(names, null_placement="at_start"))
        who = pc.index_in(ids, value_set=names, skip_nulls=False).to_numpy(zero_copy_only=False).astype(np.int64)
        tile = block["tile"].to_numpy().astype(np.int64)
        stretches, stretch = np.unique(np.stack([who, tile], 1), axis=0, return_inverse=True)
        stretch = stretch.reshape(-1)
        letters, begins = joined(block["piece"].to_pylist())
        size = np.zeros(len(stretches), np.int64)
        np.maximum.at(size, stretch, np.diff(np.append(begins, len(letters))))
        base = np.cumsum(size + longest) - size     # a diagonal may begin before its stretch
        where, found = codes(letters)
        piece = np.searchsorted(begins, where, "right") - 1
        at = base[stretch[piece]] + where - begins[piece]
        order = np.argsort(found, kind="stable")
        found, at = found[order], at[order]
        if not len(found):
            return nothing
        del where, piece, order, letters
        first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        words, times = found[first], np.diff(np.append(first, len(found)))
        bits = int(2 * (base[-1] + size[-1] + longest)).bit_length()
        reads = max(1, min(SEEDS // 64, 1 << max(62 - bits, 0)))

        def owned(diagonals):
            """Which diagonals begin in the piece whose stretch they lie in."""
            s = np.searchsorted(base - longest, diagonals, "right") - 1
            from_start = diagonals - base[s]
            return (from_start < span) & ((from_start >= 0) | (stretches[s, 1] == 0))

        def keys(query, minus, place, word):
            """One key a seed of (query, diagonal, strand)."""
            n = times[word]
            seed = np.repeat(first[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
            diagonal = at[seed] - np.repeat(place, n)
            key = np.repeat(query, n) << bits | diagonal << 1 | np.repeat(minus, n)
            return key[owned(diagonal)]

        def choose(key, n):
            """The best ``top`` of each query, of distinct keys in order."""
            query = key >> bits
            starts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(query))))
            rest, least = n.copy(), np.zeros(len(starts), np.int64)
            for i in range(top):
                least = np.maximum.reduceat(rest, starts)
                hit = np.flatnonzero((rest == least[group]) & (rest > 0))
                if i + 1 < top and len(hit):
                    rest[hit[np.unique(group[hit], return_index=True)[1]]] = 0
            keep = np.flatnonzero(n >= least[group])
            key, n, query = key[keep], n[keep], query[keep]
            diagonal, minus = (key & (1 << bits) - 1) >> 1, key & 1
            s = np.searchsorted(base - longest, diagonal, "right") - 1
            name, diagonal = stretches[s, 0], diagonal - base[s] + stretches[s, 1] * span
            order = np.lexsort((diagonal, minus, name, -n, query))
            query = query[order]
            starts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
            rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
            order, query = order[rank < top], query[rank < top]
            return query, name[order], minus[order], diagonal[order], n[order]

        out = []
        rows = asks["q_id"].combine_chunks()
        texts = asks["seq"]
        for low in range(0, asks.num_rows, reads):
            raw, starts = joined(texts.slice(low, reads).to_pylist())
            back = len(raw) - np.append(starts[1:], len(raw))[::-1]     # queries from last to first, each after its zero
            seeds = []
            for minus, text, begin in ((0, raw, starts), (1, other[raw[::-1]], back + 1)):
                where, code = codes(text)
                word = np.minimum(np.searchsorted(words, code), len(words) - 1)
                hit = words[word] == code
                where, word = where[hit], word[hit]
                query = np.searchsorted(begin, where, "right") - 1
                place = where - begin[query]
                seeds.append((query if not minus else len(starts) - 1 - query, np.full(len(where), minus), place, word))
            query, minus, place, word = (np.concatenate(x) for x in zip(*seeds, strict=True))
            order = np.argsort(query, kind="stable")
            query, minus, place, word = query[order], minus[order], place[order], word[order]
            upto = np.cumsum(times[word])
            i = 0
            while i < len(query):
                # as many whole queries as hold SEEDS seeds, or one, in portions
                j = int(np.searchsorted(upto, (upto[i - 1] if i else 0) + SEEDS, "right"))
                if j < len(query):
                    whole = int(np.searchsorted(query, query[j], "left"))
                    j = whole if whole > i else int(np.searchsorted(query, query[i], "right"))
                key, n, a = None, None, i
                while a < j:
                    b = min(j, max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + SEEDS, "right"))))
                    more = keys(query[a:b], minus[a:b], place[a:b], word[a:b])
                    if len(more):
                        more, m = summed(more)
                        key, n = (more, m) if key is None else summed(np.concatenate([key, more]), np.concatenate([n, m]))
                    a = b
                if key is not None:
                    best = choose(key, n)
                    out.append((best[0] + low, *best[1:]))
                i = j
        if not out:
            return nothing
        query, name, minus, diagonal, n = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table([rows.take(pa.array(query)), names.take(pa.array(name)), pa.array(np.where(minus == 1, "-", "+"), pa.string()),
                         pa.array(diagonal.astype(np.int32)), pa.array(n.astype(np.int64))], names=nothing.column_names)

    q = queries.select(F.col(q_id).alias("q_id"), F.col(q_seq).cast("string").alias("seq")).where(F.length("seq") >= k)
    q = q.select("*", F.pmod(F.xxhash64("q_id"), F.lit(parts)).alias("_part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    s = subjects.select(F.col(s_id).alias("s_id"), F.posexplode(tiles(F.col(s_seq).cast("string"), span, longest)).alias("tile", "piece"))
    s = s.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("_part"),
                 F.pmod(F.xxhash64("s_id", "tile"), F.lit(blocks)).cast("int").alias("_block"))
    kind_q, kind_s = (to_arrow_type(x.schema[c].dataType) for x, c in ((q, "q_id"), (s, "s_id")))
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((q, "q_id"), (s, "s_id"))]
    return q.groupBy("_block", "_part").cogroup(s.groupBy("_block", "_part")).applyInArrow(
        run, f"q_id {kinds[0]}, s_id {kinds[1]}, strand string, diag int, n_seeds bigint")


#: Letters of a k-mer that :func:`kmer_counts` counts as numbers, and distinct
#: k-mers that a task holds before it passes them on.
COUNTED, HELD = 12, 1 << 20


def kmer_counts(df: DataFrame, k: int, id_col: str = "seq_id", seq_col: str = "seq",
                canonical: bool = False) -> DataFrame:
    """Per k-mer, total occurrences and number of sequences holding it.
    ``canonical`` folds a k-mer with its reverse complement (the smaller
    string).

    The sequences are shuffled by id, not their k-mers: a task counts the
    k-mers of one id after the other as numbers and adds them up, so what
    leaves it are distinct k-mers. K-mers of other characters than A-Z are
    cut as strings. Longer k-mers than ``COUNTED`` are rows, counted by two
    partial aggregations."""
    if k > COUNTED:
        x = explode_kmers(df, k, id_col, seq_col)
        if canonical:
            x = x.withColumn("kmer", F.least(F.col("kmer"), revcomp(F.col("kmer"))))
        per_seq = x.groupBy("kmer", "id").agg(F.count(F.lit(1)).alias("n"))
        return per_seq.groupBy("kmer").agg(F.sum("n").cast("bigint").alias("occurrences"),
                                           F.count(F.lit(1)).alias("n_sequences"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        letter = np.zeros(128, np.int64)
        letter[ord("A"):ord("Z") + 1] = np.arange(1, 27)
        other = np.arange(27)
        change = {ord(a): b for a, b in zip(COMPLEMENT_FROM, COMPLEMENT_TO, strict=True)}
        for a, b in change.items():
            if chr(a).isupper():
                other[letter[a]] = letter[ord(b)]

        def windows(text):
            """(codes, strings) of the k-mers of a sequence, in pieces."""
            for at in range(0, len(text) - k + 1, ROWS):
                piece = text[at:at + ROWS + k - 1]
                raw = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
                c = np.where(raw < 128, letter[np.minimum(raw, 127)], 0)
                n = len(c) - k + 1
                code, back, ok = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
                for i in range(k):
                    part = c[i:i + n]
                    code = code << 5 | part
                    ok &= part > 0
                    if canonical:
                        back |= other[part] << 5 * i
                odd = [piece[i:i + k] for i in np.flatnonzero(~ok)]
                if canonical:
                    code = np.minimum(code, back)
                    odd = [min(x, x.translate(change)[::-1]) for x in odd]
                yield code[ok], odd

        def added(parts):
            """Sums of (codes, occurrences, sequences) by code."""
            codes, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return [codes, *(np.bincount(place, np.concatenate([p[i] for p in parts]), len(codes)).astype(np.int64) for i in (1, 2))]

        def flush(parts, strings):
            codes, times, holders = added(parts) if parts else [np.zeros(0, np.int64)] * 3
            shifts = 5 * np.arange(k - 1, -1, -1)
            names = ((codes[:, None] >> shifts & 31) + (ord("A") - 1)).astype(np.uint8).reshape(-1).tobytes().decode("ascii")
            names = [names[i:i + k] for i in range(0, len(names), k)] + list(strings)
            rest = np.array(list(strings.values()), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate([times, rest[:, 0]])),
                                               pa.array(np.concatenate([holders, rest[:, 1]]))], names=["kmer", "occurrences", "n_sequences"])

        parts, strings, size = [], {}, 0        # of ids that are done
        own, own_strings = [], {}               # of the id at hand
        current = none = object()

        def close():
            """The id at hand is done: how many k-mers it adds."""
            for x, n in own_strings.items():
                had = strings.get(x, (0, 0))
                strings[x] = (had[0] + n, had[1] + 1)
            if not own:
                return 0
            codes, times, _ = added(own) if len(own) > 1 else own[0]
            parts.append((codes, times, np.ones(len(codes), np.int64)))
            return len(codes)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if current is none or key != current:
                    size += close()
                    own, own_strings, current = [], {}, key
                    if size > 4 * ROWS:
                        parts, size = [added(parts)], 0
                        if len(parts[0][0]) + len(strings) > HELD:
                            yield flush(parts, strings)
                            parts, strings = [], {}
                for code, odd in windows(text or ""):
                    codes, times = np.unique(code, return_counts=True)
                    own.append((codes, times, times))
                    if len(own) > 16:
                        own = [added(own)]
                    for x in odd:
                        own_strings[x] = own_strings.get(x, 0) + 1
        close()
        if parts or strings:
            yield flush(parts, strings)

    x = df.select(F.col(id_col).alias("id"), F.upper(F.col(seq_col)).alias("seq")).repartition("id").sortWithinPartitions("id")
    found = x.mapInArrow(run, "kmer string, occurrences long, n_sequences long")
    return found.groupBy("kmer").agg(F.sum("occurrences").cast("bigint").alias("occurrences"),
                                     F.sum("n_sequences").cast("bigint").alias("n_sequences"))
