"""Mixing sources to target weights by capped water-filling.

Each source asks for its share of a total; a source that would be repeated more than ``max_epochs`` times is
clamped there, and what it can't take goes to the others by weight, until no source is above. A source's target is
then met by whole repetitions of all its documents and a seeded sample for the fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import save

WORD = r"[^\x20\x09-\x0D]+"
HASH_BUCKETS = 4096


def words(text_col: str) -> F.Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, total: float, max_epochs: int = 2) -> DataFrame:
    """Targets of ``sources`` (source, source_size long, weight int): adds target double.

    Clamped sources only grow in number, so there are few rounds; a round keeps two sums on the driver.
    """
    cap = F.col("source_size") * max_epochs
    level = (0.0, 1)  # target = weight * level[0] / level[1], at most the cap
    taken = -1
    while True:
        wanted = F.col("weight") * F.lit(float(level[0])) / F.lit(float(level[1]))
        over = (wanted > cap) if taken >= 0 else F.lit(False)
        row = sources.agg(F.sum(F.when(over, cap).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight"))), F.sum(F.when(over, 1).otherwise(0))).first()
        clamped, free, n = int(row[0] or 0), int(row[1] or 0), int(row[2] or 0)
        if n == taken or not free:
            break
        level, taken = (total - clamped, free), n
    wanted = F.col("weight") * F.lit(float(level[0])) / F.lit(float(level[1]))
    return sources.withColumn("target", F.least(wanted, cap.cast("double")) if free or level[0] > 0 else F.lit(0.0))


def source_order(names: DataFrame) -> DataFrame:
    """Sources numbered from 0 by code point, null last (UTF-8 order). One row a source, in range partitions."""
    placed = save(names.repartitionByRange(F.col("source").asc_nulls_last()).select("source", F.spark_partition_id().alias("part")), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return placed.withColumn("nth", F.row_number().over(own)).join(F.broadcast(first), "part").select("source", (F.col("first") + F.col("nth") - 1).alias("nth"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """How many words of each document the mix takes.

    Returns the id, source, size, source_size, target (the source's), taken (words, repeats counted), copies (whole
    repetitions) and part (words of one more, partial repetition; only the document at a source's cut has one).
    A document is in the fraction's sample if its seeded hash comes before the source's cut. The cut is found in
    the sums of 4096 hash ranges of a source; only the range that holds it is ordered by row.

    A null text has size 0, takes nothing and is returned. Rows with a null source form a source, the last.
    Repeated rows count each. An empty table, or one without words, gives targets 0. Reruns agree; rows that are
    equal in id and size are alike, so which of them is cut does not matter. With ``row_col``, that column is
    returned too and orders them. Other columns are not read.
    """
    row = [F.col(row_col)] if row_col else []
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("long")
    rows = save(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(text_col).alias("size"), hashed.alias("hash"), *row).withColumn("bucket", F.shiftright("hash", 40).cast("int")), "mix-rows")
    sums = save(rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")), "mix-sums")
    sizes = sums.groupBy("source").agg(F.sum("n").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    ordered = sizes.join(source_order(sizes.select("source")).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    sources = save(ordered.withColumn("weight", weight), "mix-sizes")
    total = share * int(sources.agg(F.sum("source_size")).first()[0] or 0)
    sources = water_fill(sources, total, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    sources = save(sources.select("source", "source_size", "target", whole.alias("whole")).withColumn("fraction", (F.floor("target") - F.col("whole") * F.col("source_size")).cast("long")), "mix-targets")
    # bounded by 4096 ranges a source: where each range begins in its source's seeded order
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begin = sums.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)))
    begin = begin.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    begin = save(begin.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "n", "begin", "source_size", "target", "whole", "fraction"), "mix-ranges")
    placed = rows.join(begin, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b", "bucket")
    at_cut = (F.col("begin") < F.col("fraction")) & (F.col("begin") + F.col("n") > F.col("fraction"))
    own = Window.partitionBy("source", "begin").orderBy("hash", "id", "size", *row).rowsBetween(Window.unboundedPreceding, -1)
    cut = placed.where(at_cut).withColumn("at", F.col("begin") + F.coalesce(F.sum("size").over(own), F.lit(0)))
    rest = placed.where(~at_cut).withColumn("at", F.col("begin"))
    extra = F.when(F.col("begin") + F.col("n") <= F.col("fraction"), F.col("size")).when(F.col("begin") >= F.col("fraction"), 0).otherwise(F.greatest(F.lit(0), F.least(F.col("size"), F.col("fraction") - F.col("at"))))
    out = rest.unionByName(cut).withColumn("extra", extra.cast("long"))
    full = (F.col("extra") == F.col("size")) & (F.col("size") > 0)
    return out.select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"),
        (F.col("whole") + F.when(full, 1).otherwise(0)).cast("int").alias("copies"),
        F.when(full, 0).otherwise(F.col("extra")).cast("long").alias("part"),
        *row,
    )
