"""Shared helpers: scratch tables, text blocks and connected components."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where that is unset, a Spark whose tasks all run in this process (tests) gets a folder of its own; a cluster has
    no folder that all its machines see, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        _own_scratch[app] = tempfile.mkdtemp(prefix="spark-readloom-")
    return f"file://{_own_scratch[app]}"


#: Says whether Spark deletes a query's shuffle files when it ends, rather than when the driver's memory is next cleaned.
_SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the scratch folder and read it back: this cuts the lineage and survives lost executors.

    The shuffles that made it are deleted at once, as nothing reads them any more: else the disk would hold those of all
    tables until the driver happens to clean its memory.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/readloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_SHUFFLES_END, None)
    spark.conf.set(_SHUFFLES_END, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLES_END)
        else:
            spark.conf.set(_SHUFFLES_END, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._readloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``save`` made, once nothing reads it any more."""
    path = getattr(df, "_readloom_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Edges that one task may join on its own.
TASK_EDGES = 1 << 20


def _forest(batches):
    """Stars that join what a partition's edges (a, b) join: u and the smallest node v of its tree."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = [x for x in up if root(x) != x]
    for i in range(0, len(nodes), 1 << 16):
        part = nodes[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["u", "v"])


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph.

    ``edges`` has columns ``a`` and ``b`` (long). Returns ``node``, ``comp`` (smallest node of the component) for
    every node with an edge to another node. The edges are dealt to tasks of at most TASK_EDGES or so, and each joins
    its own; their stars are joined by alternating large-star and small-star steps until nothing changes. Each
    step is one aggregation and one join, and stars around a hot node are pre-aggregated and split by the skew join.
    The number of rounds grows with the logarithm of the longest chain.
    """
    edges = edges.where("a <> b").select("a", "b")
    stars = _join_stars(edges.repartition(edges.count() // TASK_EDGES + 1).mapInArrow(_forest, "u long, v long"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _settled(edges: DataFrame) -> bool:
    """Does every node point to one other, that points to none?"""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("u"), F.lit(0).alias("v")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("u").alias("u"), F.max("v").alias("v")).where("u + v > 1").isEmpty()


def _join_stars(edges: DataFrame) -> DataFrame:
    cur = save(edges, "cc")
    while not _settled(cur):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = save(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = save(small, "cc")
        discard(large)
        discard(cur)
        cur = new
    return cur
