"""Exact top-k inner products by pivot-table elimination.

Inner product becomes a distance by one extra coordinate: with M the largest
norm of a block, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) have
|q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>. A table holds the distances of all x'
to many pivots (p, 0). By the triangle inequality the largest
|d(q', p') - d(x', p')| over the pivots bounds d(q', x') from below, so
bounds <q, x> from above. Candidates are scored in the order of their bounds
until no bound left reaches the k-th best score: an exact stop.

Vectors and queries are dealt into blocks by id; every block of queries
meets every block of vectors, and each pair returns k rows a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Components in a block of vectors, and in a group of queries that one task
#: holds beside it.
BLOCK_VALUES, QUERY_VALUES = 1 << 18, 1 << 22
PIVOTS, PIVOT_SAMPLE = 64, 1024


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def scaled(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): components as floor(scale * x). Rows with a null id, a
    null vector or a null or non-finite component take no part."""
    # Beyond 2^53 a double is an integer already, and floor() would need a long.
    v = F.transform(F.transform("embedding", lambda x: F.lit(float(scale)) * x.cast("double")),
                    lambda y: F.when(F.abs(y) < 2.0 ** 53, F.floor(y).cast("double")).otherwise(y))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", _finite)
    return vectors.where(good).select(F.col("vec_id").cast("long"), v.alias("v"))


def choose_pivots(sample, n: int = PIVOTS):
    """Far-apart members of ``sample`` (rows of one length), and the origin."""
    import numpy as np

    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    picked = [np.zeros(sample.shape[1])]
    far = np.full(len(sample), np.inf)
    while len(picked) < min(n, len(sample) + 1):
        far = np.minimum(far, ((sample - picked[-1]) ** 2).sum(1))
        if far.max() <= 0:
            break
        picked.append(sample[int(far.argmax())])
    return np.array(picked)


def block_topk(ids, x, query_ids, q, pivots, k: int, chunk: int = 256):
    """Rows (query_id, vec_id, score) of one block, and how many were scored.

    ``ids`` ascending and distinct; ``x``, ``q`` hold integers as doubles.
    Scores are int64, or Python integers where int64 might overflow.
    """
    import numpy as np

    big = max(np.abs(x).max(initial=0), np.abs(q).max(initial=0)) ** 2 * max(1, x.shape[1]) >= 2.0 ** 62
    exact = (lambda a: np.array([[int(c) for c in row] for row in a], dtype=object).reshape(a.shape)) if big else (lambda a: a.astype(np.int64))
    xi, qi = exact(x), exact(q)
    m2 = (x * x).sum(1).max(initial=0)
    p2 = (pivots * pivots).sum(1)
    table = np.sqrt(np.maximum(0, m2 + p2 - 2 * x @ pivots.T))
    to_pivot = np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + p2 - 2 * q @ pivots.T))
    rows, scored = [], 0
    for j in range(len(q)):
        total = float((q[j] * q[j]).sum() + m2)
        upper = (total - np.abs(table - to_pivot[j]).max(1) ** 2) / 2 + (1 + 1e-6 * total)
        order = np.argsort(-upper, kind="stable")
        order = order[ids[order] != query_ids[j]]
        best_i, best_s = np.empty(0, np.int64), xi[:0, 0] if xi.shape[1] else np.empty(0, np.int64)
        for at in range(0, len(order), chunk):
            if len(best_s) == k and upper[order[at]] < best_s[-1]:
                break
            part = order[at:at + chunk]
            scored += len(part)
            s = np.concatenate([best_s, xi[part] @ qi[j]])
            i = np.concatenate([best_i, ids[part]])
            top = np.lexsort((i, -s))[:k] if not big else np.array(sorted(range(len(s)), key=lambda n: (-s[n], i[n]))[:k], np.int64)  # noqa: B023
            best_i, best_s = i[top], s[top]
        lim = (1 << 63) - 1
        rows += [(int(query_ids[j]), int(i), max(-lim - 1, min(lim, int(s)))) for i, s in zip(best_i, best_s, strict=True)]
    return rows, scored


def topk(vectors: DataFrame, is_query: Column, k: int = 10, n_pivots: int = PIVOTS,
         block_values: int = BLOCK_VALUES, query_values: int = QUERY_VALUES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each query.

    ``vectors``: (vec_id, v) from ``scaled``. Ties go to the smaller vec_id.
    Vectors of another length than the query's are no candidates. Of rows
    that repeat a vec_id one counts (the smallest vector). Scores beyond a
    long are given as the nearest long. An empty table gives no rows.
    """
    import numpy as np

    vectors = written(vectors)
    queries = vectors.where(is_query)
    x_values, q_values = (df.agg(F.sum(F.size("v"))).first()[0] or 0 for df in (vectors, queries))
    blocks, groups = max(1, -(-x_values // block_values)), max(1, -(-q_values // query_values))
    # A bounded sample, the same on every run: far-apart members are pivots.
    sample = [r.v for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(PIVOT_SAMPLE).collect()]
    by_length = {n: choose_pivots(np.array(same, float).reshape(len(same), n), n_pivots)
                 for n in {len(s) for s in sample} for same in [[s for s in sample if len(s) == n]]}

    def matrices(pdf):
        """By length: ids ascending without repeats, and their vectors."""
        kept, seen = {}, set()
        for i, v in sorted((int(i), tuple(v)) for i, v in zip(pdf["vec_id"], pdf["v"], strict=True)):
            if i not in seen:
                seen.add(i)
                kept.setdefault(len(v), []).append((i, v))
        return {n: (np.array([i for i, _ in rows], np.int64), np.array([v for _, v in rows], float).reshape(len(rows), n))
                for n, rows in kept.items()}

    def search(x_rows, q_rows):
        import pandas as pd

        out, q_of = [], matrices(q_rows)
        for n, (ids, x) in matrices(x_rows).items():
            if n in q_of:
                out += block_topk(ids, x, *q_of[n], by_length.get(n, np.zeros((1, n))), k)[0]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = vectors.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), every(groups).alias("part"))
    q = queries.select("vec_id", "v", every(blocks).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("part"))
    found = (x.groupBy("block", "part").cogroup(q.groupBy("block", "part"))
             .applyInPandas(search, "query_id long, vec_id long, score long"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
