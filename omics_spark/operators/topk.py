"""Top-k per group (G2, G3) without gathering a big group into one task.

Stage 1 ranks inside (group, salt) buckets - the salt is a hash of the row
key, so a group holding a third of the rows is cut into ``buckets`` parts -
and keeps k per bucket. Stage 2 ranks the at most ``k * buckets`` survivors
per group. Ties are broken by the ``order`` list, which callers make total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int,
          salt_cols: list[str] | None = None, buckets: int = 16,
          rank_col: str = "rank") -> DataFrame:
    salt_cols = salt_cols or [c for c in df.columns if c not in keys]
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_cols]), F.lit(buckets))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    s1 = (df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1))
            .where(F.col("_r1") <= k).drop("_r1", "_salt"))
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return s1.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)


def quota_sample(df: DataFrame, strata: list[str], id_col: Column, quotas: DataFrame, quota: str = "quota") -> DataFrame:
    """Of each stratum as many rows as ``quotas`` (strata, ``quota``) asks
    for, the first by the MD5 of ``id_col`` (distinct within a stratum); all
    if it has fewer. A stratum may hold most rows: they are ranked in 4,096
    ranges of the hash, and a range starts after the counts of those before
    it, a table of one row for each (stratum, range)."""
    x = df.withColumn("_h", F.md5(id_col.cast("binary"))).withColumn("_r", F.substring("_h", 1, 3))
    before = Window.partitionBy(*strata).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    counts = (x.groupBy(*strata, "_r").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    wanted = counts.join(quotas.select(*strata, F.col(quota).alias("_q")), strata).where(F.col("_base") < F.col("_q"))
    inside = F.row_number().over(Window.partitionBy(*strata, "_r").orderBy("_h"))
    ranked = x.join(wanted, [*strata, "_r"]).withColumn("_at", F.col("_base") + inside)
    return ranked.where(F.col("_at") <= F.col("_q")).select(*df.columns)
