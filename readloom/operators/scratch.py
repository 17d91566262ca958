"""Cutting of lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the session's shared folder.

    Where none is set, a Spark whose tasks all run in this process (tests) gets a folder of its own; a cluster has no
    folder that all its machines see, so there it is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='spark-readloom-')}")
    return df.checkpoint()


def dealt(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """Rows with all of a key in one partition, sorted by key and ``order``, for functions that stream over partitions.

    Spark leaves out a repartition by columns that a join or aggregation below has dealt by already, but may then read
    that one's shuffle in other pieces, as it doesn't know that the function needs whole keys. It keeps one by a hash.
    """
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)
