"""External programs over table rows.

``pipe_lines`` streams each partition's lines through a command (the
reference's whole tier-2 path), with optional header lines repeated into
every partition so tools that need a header see it everywhere.
``pipe_groups`` runs one process per key group, so tools that need whole
ordered groups (e.g. per contig) see them. ``batch_predict`` applies a
user-supplied model in Arrow batches.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default per-process timeouts (seconds).
DEFAULT_TIMEOUT = 3600


def _through(command: list[str], lines: Iterator[str], env: dict, timeout: int) -> Iterator[list[str]]:
    """``lines`` through a child process, its output lines in lists. Both
    ways are streamed; a non-zero exit, or running beyond ``timeout``
    seconds, raises. Lines that the child does not read stay in ``lines``."""
    import os
    import threading
    from itertools import islice

    child = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, env={**os.environ, **env})
    failed = []

    def feed() -> None:
        try:
            with child.stdin as sink:
                sink.writelines(lines)
        except BrokenPipeError:
            pass   # the command may stop reading early, as head does
        except BaseException as e:
            failed.append(e)
            child.kill()

    feeder = threading.Thread(target=feed, daemon=True)
    late = threading.Timer(timeout, child.kill)
    feeder.start()
    late.start()
    try:
        while found := list(islice(child.stdout, 10_000)):
            yield [line.removesuffix("\n") for line in found]
        code = child.wait()
        feeder.join()
        if failed:
            raise failed[0]
        if code:
            raise subprocess.CalledProcessError(code, command)
    finally:
        late.cancel()
        child.kill()


def pipe_lines(df: DataFrame, cmd: Sequence[str], col: str = "value",
               header: Sequence[str] | None = None, env: dict | None = None,
               timeout: int = DEFAULT_TIMEOUT) -> DataFrame:
    """Lines of ``col`` -> command stdin per partition -> stdout lines
    as rows (``value``). The command sees the worker's environment with
    ``env`` on top, so tools are found by the worker's PATH. Input and output
    are streamed in batches. A non-zero exit, or running beyond ``timeout``
    seconds, fails the task (and the job after retries)."""
    head, command, extra = list(header or []), list(cmd), dict(env or {})

    def run(batches: Iterator) -> Iterator:
        from itertools import chain

        import pyarrow as pa

        rows = ("\n" if v is None else f"{v}\n" for b in batches for v in b.column(0).to_pylist())
        for lines in _through(command, chain((f"{line}\n" for line in head), rows), extra, timeout):
            yield pa.RecordBatch.from_pydict({"value": lines})

    return df.select(F.col(col).cast("string")).mapInArrow(run, "value string")


def pipe_groups(df: DataFrame, keys: list[str], cmd: Sequence[str], col: str = "value",
                order: list[str] | None = None, timeout: int = DEFAULT_TIMEOUT) -> DataFrame:
    """One process per key group; rows sorted by ``order`` inside the
    group are written to stdin, each stdout line becomes a row next to the
    group keys. Exit status is checked; a timeout fails the task.

    Spark deals the groups out and sorts them (on disk if need be); a process
    is started at each change of key, its input and output are streamed, so a
    group of any size passes through the memory of a few batches. A null line
    is an empty line."""
    command, order = list(cmd), list(order or [])
    schema = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys) + ", value string"
    picked = df.select(*keys, F.col(col).cast("string").alias("_line"), *(F.col(o).alias(f"_o{i}") for i, o in enumerate(order)))
    ordered = picked.repartition(*keys).sortWithinPartitions(*keys, *(f"_o{i}" for i in range(len(order)))).select(*keys, "_line")

    def run(batches: Iterator) -> Iterator:
        from itertools import groupby

        import pyarrow as pa

        kinds: list = []

        def rows() -> Iterator[tuple]:
            for b in batches:
                kinds[:] = [f.type for f in b.schema][:-1]
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        for key, group in groupby(rows(), key=lambda r: r[:-1]):
            for lines in _through(command, ("\n" if r[-1] is None else f"{r[-1]}\n" for r in group), {}, timeout):
                columns = [pa.array([v] * len(lines), t) for v, t in zip(key, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.string())], names=[*keys, "value"])

    return ordered.mapInArrow(run, schema)


def batch_predict(df: DataFrame, make_predict_fn: Callable, return_type,
                  input_cols: list[str], batch_size: int = 256,
                  input_tensor_shapes=None, output: str = "prediction") -> DataFrame:
    """Apply a user-supplied model (``make_predict_fn`` returns a
    function over numpy batches) with Arrow batches; no weights shipped."""
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(make_predict_fn, return_type=return_type, batch_size=batch_size,
                            input_tensor_shapes=input_tensor_shapes)
    return df.withColumn(output, udf(*[F.col(c) for c in input_cols]))
