"""Interval operators: overlap with masks, unions, merges, depth, containment.

A key is a subject, and one subject may hold most rows (a large chromosome). Ordered scans therefore run in bins of
the axis: ``running`` solves each bin on its own and adds what the bins before it amount to, which takes one row a bin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.scratch import dealt

BIN = 4096


def running(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, str, bool]], bin_size: int | None = BIN) -> DataFrame:
    """Running aggregates a key in the given order, whose first column is the place on the axis.

    values: name -> (column, ``sum`` or ``max``, whether the row itself counts). A first maximum is null, a first sum 0.
    bin_size None: the keys name a query, so that one's rows are few; they are scanned whole, without a further shuffle of rows
    that are dealt by query.
    """
    agg = {"sum": F.sum, "max": F.max}
    if bin_size is None:
        whole = Window.partitionBy(*keys).orderBy(*order)
        each = {n: agg[how](c).over(whole.rowsBetween(Window.unboundedPreceding, 0 if itself else -1)) for n, (c, how, itself) in values.items()}
        return rows.withColumns({n: F.coalesce(c, F.lit(0)) if values[n][1] == "sum" else c for n, c in each.items()})
    binned = rows.withColumn("_bin", F.floor(F.col(order[0]) / bin_size))
    bins = binned.groupBy(*keys, "_bin").agg(*(agg[how](c).alias(f"_all_{n}") for n, (c, how, _) in values.items()))
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_bin").alias("_b"), *(agg[how](f"_all_{n}").over(earlier).alias(f"_before_{n}") for n, (_, how, _) in values.items()))
    own = Window.partitionBy(*keys, "_bin").orderBy(*order)
    inner = binned.withColumns({f"_own_{n}": agg[how](c).over(own.rowsBetween(Window.unboundedPreceding, 0 if itself else -1)) for n, (c, how, itself) in values.items()})
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_bin") == F.col("_b")]
    joined = inner.join(bins, on)
    total = {n: F.greatest(f"_own_{n}", f"_before_{n}") if how == "max" else F.coalesce(f"_own_{n}", F.lit(0)) + F.coalesce(f"_before_{n}", F.lit(0)) for n, (_, how, _) in values.items()}
    return joined.withColumns(total).drop("_bin", "_b", *(f"_k{i}" for i in range(len(keys))), *(f"_{x}_{n}" for x in ("own", "before") for n in values))


def following(rows: DataFrame, keys: list[str], at: str, name: str, bin_size: int = BIN) -> DataFrame:
    """Add the next place a key (null for the last); places are distinct."""
    binned = rows.withColumn("_bin", F.floor(F.col(at) / bin_size))
    later = Window.partitionBy(*keys).orderBy("_bin")
    bins = binned.groupBy(*keys, "_bin").agg(F.min(at).alias("_first")).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_bin").alias("_b"), F.lead("_first").over(later).alias("_then"))
    inner = binned.withColumn(name, F.lead(at).over(Window.partitionBy(*keys, "_bin").orderBy(at)))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_bin") == F.col("_b")]
    return inner.join(bins, on).withColumn(name, F.coalesce(name, "_then")).drop("_bin", "_b", "_then", *(f"_k{i}" for i in range(len(keys))))


def islands(rows: DataFrame, keys: list[str], start: str, end: str, gap: int = 0, ties: tuple[str, ...] = (), bin_size: int | None = BIN) -> DataFrame:
    """Add ``_island``: rows of a key that reach each other, by at most ``gap``, have one number, rising along the axis."""
    order = [start, end, *(t for t in ties if t not in (start, end))]
    marked = running(rows, keys, order, {"_reach": (end, "max", False)}, bin_size)
    marked = marked.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + gap), 1).otherwise(0))
    # of equal rows the one that begins an island is first, in whatever order they come this time
    return running(marked, keys, [*order, F.desc("_new")], {"_island": ("_new", "sum", True)}, bin_size).drop("_reach", "_new")


def merge(rows: DataFrame, keys: list[str], start: str = "from", end: str = "to", gap: int = 0, score: str | None = None, bin_size: int | None = BIN) -> DataFrame:
    """Union of intervals a key, those at most ``gap`` apart being one: hull, number, the sum of the sizes, and the
    greatest score."""
    more = [F.sum(F.col(end) - F.col(start)).alias("residues"), *([F.max(score).alias(score)] if score else [])]
    return islands(rows, keys, start, end, gap, bin_size=bin_size).groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"), *more).drop("_island")


def binned_overlap(left: DataFrame, right: DataFrame, keys: list[str], bin_size: int = BIN) -> DataFrame:
    """Pairs of rows of one key whose [from, to) overlap, by an equi-join on bins of the axis.

    A pair that shares several bins is kept only in the first. right's columns are r_from and r_to.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_size), F.floor((F.col(b) - 1) / bin_size)))
    x = left.where(F.col("from") < F.col("to")).withColumn("_bin", bins("from", "to"))
    y = right.where(F.col("from") < F.col("to")).select(*keys, F.col("from").alias("r_from"), F.col("to").alias("r_to")).withColumn("_bin", bins("r_from", "r_to"))
    first = F.col("_bin") == F.floor(F.greatest("from", "r_from") / bin_size)
    return x.join(y, [*keys, "_bin"]).where((F.col("from") < F.col("r_to")) & (F.col("r_from") < F.col("to")) & first).drop("_bin")


def masked_bases(rows: DataFrame, mask: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """For every row how many of its bases a mask covers; the mask's intervals are united first."""
    united = merge(mask, keys)
    over = binned_overlap(rows.select(row_id, *keys, "from", "to"), united, keys)
    sums = over.groupBy(row_id).agg(F.sum(F.least("to", "r_to") - F.greatest("from", "r_from")).alias("masked"))
    return rows.join(sums, row_id, "left").withColumn("masked", F.coalesce("masked", F.lit(0)).cast("long"))


def unmasked_enough(span: Column, masked: Column, least: int = 2000) -> Column:
    return span - masked > least


def depth(rows: DataFrame, keys: list[str], start: str = "from", end: str = "to") -> DataFrame:
    """Steps of coverage a key: from, to, depth (over 0), by a sweep over the ends."""
    events = rows.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("e")).select(*keys, "e.at", "e.d")
    events = events.groupBy(*keys, "at").agg(F.sum("d").alias("d"))
    steps = following(running(events, keys, ["at"], {"depth": ("d", "sum", True)}), keys, "at", "to")
    return steps.where("depth > 0 and to is not null").select(*keys, F.col("at").alias("from"), "to", "depth")


def saturated(rows: DataFrame, depths: DataFrame, keys: list[str], row_id: str, most: int, slack: int = 200) -> DataFrame:
    """Add ``full``: do fewer than ``slack`` places of a row's span have a depth (see ``depth``) under ``most``?"""
    deep = merge(depths.where(F.col("depth") >= most), keys)
    over = binned_overlap(rows.select(row_id, *keys, "from", "to"), deep, keys)
    sums = over.groupBy(row_id).agg(F.sum(F.least("to", "r_to") - F.greatest("from", "r_from")).alias("_deep"))
    left = F.col("to") - F.col("from") - F.coalesce("_deep", F.lit(0))
    return rows.join(sums, row_id, "left").withColumn("full", left < slack).drop("_deep")


def longest_covered(rows: DataFrame, keys: list[str], min_depth: int, min_size: int = 0) -> DataFrame:
    """The longest stretch a key of at least ``min_depth``; the first of equals."""
    deep = merge(depth(rows, keys).where(F.col("depth") >= min_depth), keys)
    best = deep.where(F.col("to") - F.col("from") >= min_size).groupBy(*keys).agg(F.max_by(F.struct("from", "to"), F.struct((F.col("to") - F.col("from")).alias("n"), (-F.col("from")).alias("f"))).alias("b"))
    return best.select(*keys, F.col("b.from").alias("from"), F.col("b.to").alias("to"))


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Of a partition sorted by ``keys``: rows of whole groups, and where each group begins and ends."""

    def cut(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple[int, int]]]:
        values = [pdf[k].to_numpy() for k in keys]
        edge = [0, *(np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1).tolist(), len(pdf)]
        return pdf, list(zip(edge[:-1], edge[1:], strict=True))

    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pd.concat([*held, pdf], ignore_index=True)
        last = np.all([(pdf[k] == pdf[k].iloc[-1]).to_numpy() for k in keys], axis=0)
        first = len(pdf) - int(np.argmin(last[::-1])) if not last.all() else 0  # where the last group begins
        if first:
            yield cut(pdf.iloc[:first])
        held = [pdf.iloc[first:]]
    if held:
        yield cut(held[0].reset_index(drop=True))


def _folded(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], fold: Callable[[list[np.ndarray]], np.ndarray]) -> DataFrame:
    """Rows that ``fold`` keeps; it gets the columns of one key's rows in order and tells which ones stay.

    Sorted partitions are streamed key after key; a key (the alignments of one query) is held as a few arrays.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, groups in whole_groups(batches, keys):
            values = [pdf[c].to_numpy() for c in columns]
            yield pdf[np.concatenate([fold([v[a:b] for v in values]) for a, b in groups])]

    return dealt(rows, keys, *order).mapInPandas(run, rows.schema)


def drop_contained(rows: DataFrame, keys: list[str], order: list[str], tol: int = 200) -> DataFrame:
    """Greedy containment a key, in the given total order.

    Each row in turn, unless dropped before, drops later rows inside it; a row that lies inside a later one is
    dropped, and goes on dropping. The order matters, so a key's rows are folded in order.
    """

    def fold(v: list[np.ndarray]) -> np.ndarray:
        alive = np.ones(len(v[0]), bool)
        for i in range(len(alive) - 1):
            if alive[i]:
                (qb, qe, sb, se), (q, r, s, t) = (x[i] for x in v), (x[i + 1 :] for x in v)
                inside = alive[i + 1 :] & (q + tol >= qb) & (r <= qe + tol) & (s + tol >= sb) & (t <= se + tol)
                around = alive[i + 1 :] & ~inside & (qb + tol >= q) & (qe <= r + tol) & (sb + tol >= s) & (se <= t + tol)
                alive[i + 1 :] &= ~inside
                alive[i] = not around.any()
        return alive

    return _folded(rows, keys, order, ["qoff", "qend", "soff", "send"], fold)


def drop_repeats(rows: DataFrame, query: str, order: list[str], slack: int = 300) -> DataFrame:
    """Drop both of two alignments of a query whose overlapping query ranges agree within ``slack``, both ends in sum.

    In the given total order each row, unless dropped before, meets all later ones that are left; it and those that
    agree with it are dropped. A row that agrees only with dropped ones stays.
    """

    def fold(v: list[np.ndarray]) -> np.ndarray:
        alive = np.ones(len(v[0]), bool)
        for i in range(len(alive) - 1):
            if alive[i]:
                (b, e), (x, y) = (c[i] for c in v), (c[i + 1 :] for c in v)
                first, last = np.maximum(b, x), np.minimum(e, y)
                same = alive[i + 1 :] & (first < last) & (first - b + e - last <= slack) & (first - x + y - last <= slack)
                alive[i + 1 :] &= ~same
                alive[i] = not same.any()
        return alive

    return _folded(rows, [query], order, ["qoff", "qend"], fold)
