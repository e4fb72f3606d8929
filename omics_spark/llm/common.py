"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from omics_spark.session import cut_lineage

# Functions that run on executors travel with the job, so that workers need
# not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, read back."""
    return cut_lineage(df)


def slices(batches: Iterator, rows: int = 1_000) -> Iterator:
    """Arrow batches in pieces, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, schema: str, fn: Callable) -> DataFrame:
    """``fn(columns: dict of lists) -> dict of lists`` over Arrow batches."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(arrow_schema)
        for batch in slices(batches):
            got = fn(batch.to_pydict())
            yield pa.RecordBatch.from_pydict({f.name: pa.array(got[f.name], f.type) for f in out}, schema=out)

    from pyspark.sql.types import _parse_datatype_string

    arrow_schema = _parse_datatype_string(schema)
    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, text: str, fn: Callable, fields: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with columns computed from column ``text``, and their names.

    ``fn(texts) -> one list per field``; ``fields`` are "name type". Names get
    underscores until they clash with none of ``df``. Other columns pass
    through Arrow unchanged.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    taken, names, types = {c.lower() for c in df.columns}, [], []
    for field in _parse_datatype_string(", ".join(fields)):
        name = field.name
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
        types.append(field.dataType)
    schema = StructType([*df.schema.fields, *(StructField(n, t) for n, t in zip(names, types, strict=True))])
    arrow = [to_arrow_type(t) for t in types]
    at = df.columns.index(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            new = [pa.array(v, t) for v, t in zip(fn(batch.column(at).to_pylist()), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, schema), names


def gapless_rank(df: DataFrame, keys: list[str], salt: Column, order: list, name: str,
                 salts: int) -> DataFrame:
    """Adds ``name``: a number from 0 without gaps within ``keys``.

    A key may hold most rows: rows are numbered within (key, salt), and each
    piece is shifted by the sizes of the pieces before it, a table of at most
    keys x ``salts`` rows.
    """
    tagged = df.withColumn("_salt", F.pmod(salt, F.lit(salts)))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (tagged.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    return (tagged.join(sizes, [*keys, "_salt"])
            .withColumn(name, F.col("_base") + F.row_number().over(inner) - 1)
            .drop("_salt", "_base"))


def salts_for(rows: int, rows_per_piece: int = 250_000, least: int = 16) -> int:
    """Pieces for ``gapless_rank``: enough that one piece stays small."""
    return max(least, -(-rows // rows_per_piece))


def crc32_of_id(col: str | Column = "doc_id") -> Column:
    return F.crc32((F.col(col) if isinstance(col, str) else col).cast("string").cast("binary"))


def orderable(df: DataFrame) -> list[Column]:
    """Columns that Spark can sort by, to make choices among rows repeatable."""
    return [F.col(f"`{f.name}`") for f in df.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))] or [F.lit(1)]


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def positions(df: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: the row's place, from 0, among the rows of its ``key``
    in ``order`` (nulls first; repeated rows in any order). Null is a key.

    A key may hold most rows: rows are dealt by ranges of (key, order), so a
    large key spans many partitions, numbered inside each (partition, key)
    and shifted by the counts of the partitions before, one row for each
    (partition, key). The ranges are written, so a lost task finds them again.
    """
    part, row, base, count = (free_name(df, x) for x in ("_part", "_row", "_before", "_count"))
    by = [F.col(key), *order]
    ranged = written(df.withColumn(row, F.monotonically_increasing_id()).repartitionByRange(*by, F.col(row))
                     .withColumn(part, F.spark_partition_id()))
    inside = Window.partitionBy(part, key).orderBy(*order, F.col(row))
    earlier = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = (ranged.groupBy(key, part).agg(F.count(F.lit(1)).alias(count))
              .select(F.col(key).alias("_k"), F.col(part).alias("_p"), F.coalesce(F.sum(count).over(earlier), F.lit(0)).alias(base)))
    return (ranged.join(counts, (F.col(part) == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")))
            .withColumn(name, F.row_number().over(inside) - 1 + F.col(base))
            .drop(part, row, base, "_k", "_p"))


def grouped_streams(df: DataFrame, key: str, order: list[str | Column], schema: str, fold: Callable) -> DataFrame:
    """One ``fold(key value, rows) -> tuple`` for each key, rows in ``order``.

    ``rows`` is an iterator of tuples in column order; a key's rows are never
    held together, so a task's memory is that of one Arrow batch whatever the
    size of the key (Spark sorts on disk). For results that need a key's rows
    one after the other, such as a hash of them all. Null is a key.
    """
    from pyspark.sql.types import _parse_datatype_string

    at, out = df.columns.index(key), _parse_datatype_string(schema)

    def run(batches: Iterator) -> Iterator:
        from itertools import groupby

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        rows = (r for b in slices(batches) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        done: list[tuple] = []

        def flush():
            columns = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for value, mine in groupby(rows, key=lambda r: r[at]):
            done.append(fold(value, mine))
            if len(done) >= 1_000:
                yield flush()
                done.clear()
        if done:
            yield flush()

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
