"""Incremental runs: new files of alignments are taken in as they come, each exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def process_new(spark: SparkSession, source: str, schema: str, stage: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Run ``stage`` over the files of ``source`` that no earlier run has seen and append the result to ``sink``.

    The checkpoint folder keeps what has been done, so a run that broke off goes on where it stopped; a batch is
    written to a folder of its own number, so its repetition replaces it.
    """

    def write(batch: DataFrame, number: int) -> None:
        stage(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
