"""File streams: the reference has no streaming operators, so this module
only lets the batch operators run on files as they arrive.

``stream_lines`` is a Structured Streaming text source; ``apply_batches``
runs any DataFrame -> DataFrame operator on each micro-batch through
``foreachBatch`` and appends the result to a Parquet sink, with the stream
checkpoint in the shared checkpoint folder (so a restarted query resumes
exactly once per file).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..session import checkpoint_dir


def stream_lines(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """New text files under ``path`` as a stream of lines (``value``)."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def apply_batches(stream: DataFrame, op: Callable[[DataFrame], DataFrame], sink_path: str,
                  checkpoint: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Run ``op`` on every micro-batch and append its rows to ``sink_path``."""
    spark = stream.sparkSession
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"

    def run(batch: DataFrame, batch_id: int) -> None:
        op(batch).write.mode("append").parquet(sink_path)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
