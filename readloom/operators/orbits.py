"""Pointers that lead forward along an axis: the places that a scan visits, and where each place's pointers end.

A greedy scan that never looks back is a pointer at each place where it may stand: where it stands next. The axis is cut
into bins at any place. Each bin makes its state map, which says for every place where the scan may enter it where it
leaves; only pointers that cross from bin to bin are entries, so the map is small, and following it takes a few rows a
bin. Then each bin, knowing where it is entered, finds what is visited in it. No key's rows meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.intervals import whole_groups
from readloom.operators.scratch import cut_lineage, dealt

BIN = 4096
#: No pointer.
NONE = -(1 << 62)


def _nodes(rows: DataFrame, keys: list[str], at: str, to: str, bin_size: int) -> DataFrame:
    place = F.col(at).cast("long")
    return rows.select(*keys, place.alias("_at"), F.coalesce(F.col(to).cast("long"), F.lit(NONE)).alias("_to"), F.floor(place / bin_size).cast("long").alias("_bin"))


def _entries(nodes: DataFrame, keys: list[str], starts: DataFrame | None) -> DataFrame:
    """Bounds at which a bin may be entered: keys, _x, _start, _bin (the first with a place from _x on)."""
    bins = nodes.groupBy(*keys, "_bin").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    crossing = nodes.join(bins, [*keys, "_bin"]).where(F.col("_to") > F.col("_last")).select(*keys, F.col("_to").alias("_x"), F.lit(False).alias("_start"))
    first = bins.groupBy(*keys).agg(F.min("_first").alias("_x")) if starts is None else starts
    every = crossing.union(first.select(*keys, "_x", F.lit(True))).groupBy(*keys, "_x").agg(F.max("_start").alias("_start"))
    both = every.select(*keys, "_x", "_start", F.lit(None).cast("long").alias("_bin")).unionByName(bins.select(*keys, F.col("_last").alias("_x"), F.lit(None).cast("boolean").alias("_start"), "_bin"))
    ahead = Window.partitionBy(*keys).orderBy(F.desc("_x"))  # a few rows a bin
    return both.withColumn("_in", F.min("_bin").over(ahead)).where("_start is not null and _in is not null").select(*keys, "_x", "_start", F.col("_in").alias("_bin"))


def _met(nodes: DataFrame, entries: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """``run`` on each bin's places and entries: rows (keys, _bin, _entry 0 or 1, _at, _to), in this order."""
    both = nodes.select(*keys, "_bin", F.lit(0).alias("_entry"), "_at", "_to").union(entries.select(*keys, "_bin", F.lit(1), "_x", F.col("_start").cast("long")))
    return dealt(both, [*keys, "_bin"], "_entry", "_at").mapInPandas(run, schema)


def _types(rows: DataFrame, keys: list[str]) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in keys)


def _followed(at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of a bin the bound at which its pointers leave it (or NONE), the last place in it, and the steps to there."""
    n = len(at)
    step = np.where(to == NONE, n, np.searchsorted(at, to))
    leaves, last, steps = to.copy(), at.copy(), (to != NONE).astype(np.int64)
    for i in range(n - 1, -1, -1):
        j = step[i]
        if j < n:
            leaves[i], last[i], steps[i] = leaves[j], last[j], steps[j] + 1
    return leaves, last, steps


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]):
    """Each bin's places, pointers, entries and their marks, with its rows' frame and range."""
    for pdf, parts in whole_groups(batches, [*keys, "_bin"]):
        at, to, entry = (pdf[c].to_numpy() for c in ("_at", "_to", "_entry"))
        for a, b in parts:
            m = a + int(np.searchsorted(entry[a:b], 1))
            yield pdf, a, at[a:m], to[a:m], at[m:b], to[m:b]


def orbit(rows: DataFrame, keys: list[str], at: str, to: str, starts: DataFrame | None = None, bin_size: int = BIN) -> DataFrame:
    """Places that are visited from each key's first place, or from ``starts`` (keys, and ``at``): keys and ``at``.

    ``at`` is a whole number, distinct within a key; ``to``, greater than it, says from where on the next place is (null:
    none). Keys aren't null.
    """
    nodes, kinds = cut_lineage(_nodes(rows, keys, at, to, bin_size)), _types(rows, keys)
    entries = cut_lineage(_entries(nodes, keys, None if starts is None else starts.select(*keys, F.col(at).cast("long").alias("_x"))))

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, a, places, to_, entered, start in _groups(batches, keys):
            if len(entered):
                leaves, _, _ = _followed(places, to_)
                key = {k: np.repeat(pdf[k].iloc[a], len(entered)) for k in [*keys, "_bin"]}
                yield pd.DataFrame(key | {"_x": entered, "_start": start > 0, "_exit": leaves[np.searchsorted(places, entered)]})

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, pending = None, set()
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            names = list(zip(*(pdf[k].tolist() for k in keys), strict=True))
            for i, (key, x, start, exit_) in enumerate(zip(names, pdf["_x"].tolist(), pdf["_start"].tolist(), pdf["_exit"].tolist(), strict=True)):
                if key != now:
                    now, pending = key, set()
                if start or x in pending:
                    pending.discard(x)
                    keep[i] = True
                    if exit_ != NONE:
                        pending.add(exit_)
            yield pdf.loc[keep, [*keys, "_bin", "_x", "_start"]]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, a, places, to_, entered, _ in _groups(batches, keys):
            seen, n = np.zeros(len(places), bool), len(places)
            step = np.where(to_ == NONE, n, np.searchsorted(places, to_)) if len(entered) else to_
            for i in np.searchsorted(places, entered).tolist():
                while i < n and not seen[i]:
                    seen[i] = True
                    i = int(step[i])
            got = places[seen]
            yield pd.DataFrame({k: np.repeat(pdf[k].iloc[a], len(got)) for k in keys} | {at: got})

    made = _met(nodes, entries, keys, maps, f"{kinds}, _bin long, _x long, _start boolean, _exit long")
    marked = dealt(made, keys, "_x").mapInPandas(follow, f"{kinds}, _bin long, _x long, _start boolean")
    return _met(nodes, marked, keys, walk, f"{kinds}, {at} long")


def ends(rows: DataFrame, keys: list[str], at: str, to: str, bin_size: int = BIN) -> DataFrame:
    """Add ``end``, the last place that each one's pointers lead to (itself, if it has none), and ``steps``, their number.

    As ``orbit``; each pointer leads to a place.
    """
    nodes, kinds = cut_lineage(_nodes(rows, keys, at, to, bin_size)), _types(rows, keys)
    none = nodes.select(*keys, F.col("_at").alias("_x")).limit(0)
    entries = cut_lineage(_entries(nodes, keys, none))

    def every(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, a, places, to_, entered, _ in _groups(batches, keys):
            leaves, last, steps = _followed(places, to_)
            of = np.concatenate([np.arange(len(places)), np.searchsorted(places, entered)])
            key = {k: np.repeat(pdf[k].iloc[a], len(of)) for k in keys}
            yield pd.DataFrame(key | {"_at": np.concatenate([places, entered]), "_entry": np.repeat([0, 1], [len(places), len(entered)]), "_exit": leaves[of], "_end": last[of], "_steps": steps[of]})

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, known = None, {}
        for pdf in batches:
            out = []
            names = list(zip(*(pdf[k].tolist() for k in keys), strict=True))
            for key, x, exit_, end, steps in zip(names, *(pdf[c].tolist() for c in ("_at", "_exit", "_end", "_steps")), strict=True):
                if key != now:
                    now, known = key, {}
                if exit_ != NONE:
                    end, more = known[exit_]
                    steps += more
                known[x] = end, steps
                out.append((end, steps))
            if out:
                yield pd.DataFrame({k: pdf[k] for k in keys} | {"_exit": pdf["_at"], "_far": [o[0] for o in out], "_more": [o[1] for o in out]})

    made = cut_lineage(_met(nodes, entries, keys, every, f"{kinds}, _at long, _entry int, _exit long, _end long, _steps long"))
    far = dealt(made.where("_entry = 1"), keys, F.desc("_at")).mapInPandas(follow, f"{kinds}, _exit long, _far long, _more long")
    found = made.where("_entry = 0").join(far, [*keys, "_exit"], "left").select(*keys, F.col("_at").alias(at), F.coalesce("_far", "_end").alias("end"), (F.col("_steps") + F.coalesce("_more", F.lit(0))).alias("steps"))
    return rows.join(found, [*keys, at])
