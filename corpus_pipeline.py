"""A training-data pipeline over ``documents``, in five stages of the ``llm`` operators.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the
columns of ``documents``. Stages decide by the whole row, as ids may be null, repeated, or those of several
texts. Near duplicates are five-word shingle sets of a Jaccard similarity of 0.8 or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import decontamination, mixing, ngram_join, quality, sharding
from readloom.llm.common import save

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with the hash ``_key`` of all their columns: rows that share it are equal, whatever others have their id."""
    return docs.select(COLUMNS).withColumn("_key", F.xxhash64(*COLUMNS, *(F.col(c).isNull() for c in COLUMNS)))


def _repeated(rows: DataFrame, times: DataFrame) -> DataFrame:
    """Of equal rows one, as often as ``times`` (_key, times) says for all of them together."""
    return rows.dropDuplicates(["_key"]).join(times, "_key").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the co-trained classifier keeps, each by its own text and metadata, whatever its id.

    Null texts and texts without words go.
    """
    rows = _keyed(docs)
    table = quality.features(rows, row_col="_key")
    model = quality.train(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = quality.score_documents(table, model).where("keep").select(F.col("row").alias("_key")).distinct()
    return rows.join(kept, "_key", "left_semi").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: one of the smallest id, a null id only where all are null.

    Null texts and texts without words are nobody's duplicates and all stay.
    """
    rows = _keyed(docs)
    found = ngram_join.jaccard_components(rows, 5, 80, id_col="_key").select(F.col("doc_id").alias("_key"), "n_shingles", "component_id")
    groups = found.groupBy("_key").agg(F.min("component_id").alias("component_id"), F.min("n_shingles").alias("n"), F.count("*").alias("copies"))
    ids = rows.groupBy("_key").agg(F.min("doc_id").alias("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))
    kept = groups.where("n > 0").join(ids, "_key").groupBy("component_id").agg(first.alias("first")).select("first._key", F.lit(1).alias("times"))
    return _repeated(rows, kept.unionByName(groups.where("n = 0").select("_key", F.col("copies").alias("times"))))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a ten-word window of a benchmark item."""
    rows = _keyed(docs)
    found = decontamination.contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10, id_col="_key")
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias("_key")).distinct()
    return rows.join(hit, "_key", "left_anti").select(COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; the one at a source's cut if half of it or more is taken."""
    rows = _keyed(docs)
    seeded = rows.withColumn("_id", F.coalesce("doc_id", F.xxhash64("text")))  # so that null ids don't all share a place
    mixed = mixing.mix(seeded, (3, 1, 2), 1.5, 2, id_col="_id", row_col="_key")
    times = F.col("copies") + F.when(2 * F.col("part") >= F.col("size"), F.when(F.col("size") > 0, 1).otherwise(0)).otherwise(0)
    taken = mixed.select("_key", times.alias("times")).where("times > 0").groupBy("_key").agg(F.sum("times").alias("times"))
    return _repeated(rows, taken)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and place."""
    return sharding.shard_documents(docs, 16)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mix),
    ("sharding", shards),
]

#: The classifier can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each one's result being written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
