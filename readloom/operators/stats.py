"""Length statistics, Nx/Lx, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The shares for which Nx and Lx are reported, in percent.
NX = (10, 20, 25, 30, 40, 50, 60, 70, 75, 80, 90)


def length_stats(reads: DataFrame, length: str = "len") -> DataFrame:
    """Number, sum, least, greatest, average (whole) and median (element n/2 in descending order) of lengths.

    Lengths are first counted by value, so the ordered scan is over distinct lengths only.
    """
    by = reads.where(F.col(length).isNotNull()).groupBy(F.col(length).cast("long").alias("len")).agg(F.count("*").alias("k"))
    upto = by.withColumn("seen", F.sum("k").over(Window.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("k").over(Window.partitionBy()))
    median = F.max(F.when(F.col("seen") > F.floor(F.col("n") / 2), F.col("len")))
    return upto.agg(F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("n"), F.sum(F.col("len") * F.col("k")).alias("total"), F.min("len").alias("least"), F.max("len").alias("greatest"), F.floor(F.sum(F.col("len") * F.col("k")) / F.max("n")).alias("average"), median.alias("median"))


def nx_lx(reads: DataFrame, length: str = "len", shares: tuple[int, ...] = NX) -> DataFrame:
    """For each share: the length at which the descending running sum first reaches trunc(sum * share), and its rank."""
    by = reads.where(F.col(length).isNotNull()).groupBy(F.col(length).cast("long").alias("len")).agg(F.count("*").alias("k"))
    order = Window.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, -1)
    steps = by.withColumn("before", F.coalesce(F.sum(F.col("len") * F.col("k")).over(order), F.lit(0))).withColumn("rank", F.coalesce(F.sum("k").over(order), F.lit(0)))
    total = by.agg(F.sum(F.col("len") * F.col("k")).alias("total"))
    goals = total.select(F.explode(F.array(*map(F.lit, shares))).alias("share"), "total").select("share", F.expr("total * share div 100").alias("goal"))
    hit = steps.join(F.broadcast(goals), (F.col("before") < F.col("goal")) & (F.col("before") + F.col("len") * F.col("k") >= F.col("goal")))
    return hit.select(F.col("share").cast("int").alias("share"), F.col("len").alias("nx"), (F.col("rank") + F.ceil((F.col("goal") - F.col("before")) / F.col("len"))).cast("long").alias("lx"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def tag_report(tagged: DataFrame, tag: str = "tag", size: str = "size") -> DataFrame:
    """Count, residues and percent of residues by tag, and in total (tag null)."""
    rolled = tagged.rollup(tag).agg(F.count("*").alias("n"), F.sum(size).alias("residues"), F.grouping(tag).alias("whole"))
    total = F.max(F.when(F.col("whole") == 1, F.col("residues"))).over(Window.partitionBy())
    return rolled.select(F.when(F.col("whole") == 1, F.lit("total")).otherwise(F.col(tag)).alias("tag"), "n", "residues", F.round(100.0 * F.col("residues") / total, 6).alias("percent"))


def min_max(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Scale each value to 0..1 between the least and the greatest of its key; 0 if these are equal.

    The bounds are aggregated first and joined, so that a hot key's rows need not meet in one window.
    """
    ends = rows.groupBy(*keys).agg(*(f(v).alias(f"_{n}_{v}") for v in values for n, f in (("lo", F.min), ("hi", F.max))))
    scaled = {v: F.when(F.col(f"_hi_{v}") > F.col(f"_lo_{v}"), (F.col(v) - F.col(f"_lo_{v}")) / (F.col(f"_hi_{v}") - F.col(f"_lo_{v}"))).otherwise(0.0) for v in values}
    return rows.join(ends, keys).withColumns(scaled).drop(*(f"_{n}_{v}" for v in values for n in ("lo", "hi")))
