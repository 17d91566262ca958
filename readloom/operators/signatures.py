"""Grouping of signatures by position: the strict and the relaxed scan.

Both are greedy scans over the signatures of one subject and type, which never look back. So where each goes next from
a place is a pointer that needs the rows around this place only, and ``orbits`` follows the pointers over bins of the
axis, however dense it is. The strict scan works on places and counts, the relaxed one on the rows that it leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.config import SvOptions
from readloom.operators.intervals import islands, running, whole_groups
from readloom.operators.scratch import cut_lineage, dealt
from readloom.operators.orbits import BIN, ends, orbit

KEYS = ["sid", "type"]


def _windows(window: int, bin_size: int):
    """For each occupied place of a bin (rows: keys, _bin, p, c; places just behind the bin included) the middle of the
    fullest window of a scan that stands there, whether windows go on beyond those seen, and the place's own window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, offset = bin_size + 3 * window + 4, np.arange(window + 1)
        for pdf, parts in whole_groups(batches, [*KEYS, "_bin"]):
            place, count, number = (pdf[c].to_numpy() for c in ("p", "c", "_bin"))
            for a, b in parts:
                start = int(number[a]) * bin_size
                c = np.zeros(size, np.int64)
                c[place[a:b] - start] = count[a:b]
                total = np.concatenate([[0], np.cumsum(c)])
                p = place[a:b][place[a:b] < start + bin_size] - start
                if not len(p):
                    continue
                occupied = c > 0
                ahead = occupied[p[:, None] + window + 1 + offset]  # places behind the first window's next one
                more = np.where(occupied[p + window], 0, np.cumprod(ahead, axis=1).sum(axis=1))
                # the first window holds ``window`` places, each further one a place more
                sizes = np.stack([total[p + t + window + (t > 0)] - total[p + t] for t in offset], axis=1)
                sizes[offset[None, :] > np.minimum(more, window)[:, None]] = -1
                best = np.argmax(sizes, axis=1)
                full = sizes[np.arange(len(p)), best]
                middle = lambda x, n: np.searchsorted(total, total[x] + n // 2, side="right") - 1
                own = total[p + window + 1] - total[p]
                inside = np.cumprod(occupied[p[:, None] + offset], axis=1)[:, -1] > 0
                key = {k: np.repeat(pdf[k].iloc[a], len(p)) for k in KEYS}
                yield pd.DataFrame(key | {"p": p + start, "c": c[p], "size": full, "mid": middle(p + best, full) + start, "long": more > window, "inside": inside, "own": own, "own_mid": middle(p, own) + start})

    return run


def _strict_places(places: DataFrame, window: int, bin_size: int) -> DataFrame:
    """keys, p, c, mid: where the middle of the group lies that a strict scan standing at place p makes."""
    own = F.floor(F.col("p") / bin_size).cast("long")
    behind = (F.col("p") - own * bin_size) < 3 * window + 4
    placed = places.select(*KEYS, "p", "c", F.explode(F.when(behind, F.array(own, own - 1)).otherwise(F.array(own))).alias("_bin"))
    seen = cut_lineage(dealt(placed, [*KEYS, "_bin"], "p").mapInPandas(_windows(window, bin_size), "sid long, type int, p long, c long, size long, mid long, long boolean, inside boolean, own long, own_mid long"))
    if seen.where("long").isEmpty():
        return seen
    # more windows follow than were seen: the fullest of those inside the run of occupied places behind
    runs = islands(seen.withColumn("e", F.col("p") + 1), KEYS, "p", "e", 0)
    best = F.max_by(F.struct("own", "own_mid"), F.struct("own", -F.col("p"))).alias("best")
    runs = runs.where("inside").groupBy(*KEYS, "_island").agg(best).join(runs.groupBy(*KEYS, "_island").agg(F.min("p").alias("first")), [*KEYS, "_island"])
    found = seen.where("long").select(*KEYS, "p", (F.col("p") + window + 1).alias("first")).join(runs, [*KEYS, "first"]).select(*KEYS, "p", "best")
    return seen.join(found, [*KEYS, "p"], "left").withColumn("mid", F.when(F.col("best.own") > F.col("size"), F.col("best.own_mid")).otherwise(F.col("mid")))


def _strict(places: DataFrame, options: SvOptions, bin_size: int) -> DataFrame:
    """Places in a strict group: keys, p, start (the place at which the scan stood)."""
    distance = options.strict_distance
    seen = cut_lineage(_strict_places(places, options.strict_window, bin_size).select(*KEYS, "p", "c", "mid", (F.col("mid") + distance + 1).alias("to")))
    stood = orbit(seen, KEYS, "p", "to", bin_size=bin_size).withColumn("_on", F.lit(True))
    flagged = seen.join(stood, [*KEYS, "p"], "left").withColumns({"_p": F.when(F.col("_on"), F.col("p")), "_m": F.when(F.col("_on"), F.col("mid"))})
    within = running(flagged, KEYS, ["p"], {"start": ("_p", "max", True), "middle": ("_m", "max", True)}, bin_size).where(F.abs(F.col("p") - F.col("middle")) <= distance)
    within = cut_lineage(within.select(*KEYS, "p", "c", "start"))
    enough = within.groupBy(*KEYS, "start").agg(F.sum("c").alias("n")).where(F.col("n") >= options.strict_members)
    return within.join(enough.drop("n"), [*KEYS, "start"]).drop("c")


def _alike(a: Column, b: Column, share: float, most: int) -> Column:
    apart = F.abs(a - b)
    return (apart <= share * F.greatest(a, b)) & (apart <= most)


def _followers(rows: DataFrame, window: int, share: float, most: int, bin_size: int) -> DataFrame:
    """Add ``to``: the place k of the first row behind, at most ``window`` away, that is like this one in length (null: none).

    Rows: keys, k (places from 0), sfrom, len. A bin holds ``bin_size`` rows. What lies behind it is the same for all
    its rows of one length, so it is looked up once for a bin and length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, parts in whole_groups(batches, [*KEYS, "_bin"]):
            for a, b in parts:
                s, size, k = (pdf[c].to_numpy()[a:b] for c in ("sfrom", "len", "k"))
                to, end = np.full(b - a, -1, np.int64), np.searchsorted(s, s + window, side="right")
                for i in range(b - a):
                    other = size[i + 1 : end[i]]
                    apart = np.abs(other - size[i])
                    good = (apart <= share * np.maximum(other, size[i])) & (apart <= most)
                    j = int(np.argmax(good)) if len(good) else 0
                    if len(good) and good[j]:
                        to[i] = k[i + 1 + j]
                yield pdf.iloc[a:b].assign(_to=to, _open=(to < 0) & (end == b - a))

    binned = rows.withColumn("_bin", F.floor(F.col("k") / bin_size).cast("long"))
    kinds = ", ".join(f"{n} {t}" for n, t in binned.dtypes)
    near = cut_lineage(dealt(binned, [*KEYS, "_bin"], "k").mapInPandas(run, f"{kinds}, _to long, _open boolean"))
    first = near.groupBy(*KEYS, "_bin", "len").agg(F.min(F.struct("k", "sfrom")).alias("first"))
    asked = near.where("_open").select(*KEYS, "_bin", "len").distinct()
    asked = asked.withColumn("_like", F.explode(F.sequence(F.greatest(F.lit(0), F.col("len") - most), F.col("len") + most))).where(_alike(F.col("len"), F.col("_like"), share, most))
    both = first.select(*KEYS, "_bin", F.col("len").alias("_like"), F.lit(None).cast("long").alias("len"), "first").unionByName(asked.withColumn("first", F.lit(None).cast("struct<k:bigint,sfrom:bigint>")))
    later = Window.partitionBy(*KEYS, "_like").orderBy(F.desc("_bin")).rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_first", F.min("first").over(later)).where("len is not null and _first is not null").groupBy(*KEYS, "_bin", "len").agg(F.min("_first").alias("_then"))
    out = near.join(found, [*KEYS, "_bin", "len"], "left")
    there = F.when(F.col("_open") & (F.col("_then.sfrom") <= F.col("sfrom") + window), F.col("_then.k"))
    return out.withColumn("to", F.coalesce(F.when(F.col("_to") >= 0, F.col("_to")), there)).drop("_bin", "_to", "_open", "_then")


def _relaxed(rest: DataFrame, options: SvOptions, bin_size: int, share: float = 0.1, most: int = 50) -> DataFrame:
    """Members of the relaxed groups of rows (keys, k, sfrom, len, ...): all columns, start (k of the anchor), member.

    A scan that stands at a row follows the rows of like length, each within reach of the last; enough of them are a
    group, and the scan stands behind the last one; else it goes on by one row. The anchor is the last member.
    """
    led = cut_lineage(_followers(rest, options.relaxed_window, share, most, bin_size))
    whole = cut_lineage(ends(led, KEYS, "k", "to", bin_size))
    anchors = cut_lineage(orbit(whole.where(F.col("steps") >= options.relaxed_followers).withColumn("next", F.col("end") + 1), KEYS, "k", "next", bin_size=bin_size))
    path = orbit(whole, KEYS, "k", "to", anchors, bin_size)
    members = whole.drop("to", "end", "steps").join(path, [*KEYS, "k"]).withColumn("_one", F.lit(1))
    members = members.join(anchors.withColumn("_anchor", F.lit(True)), [*KEYS, "k"], "left")
    members = running(members, KEYS, ["k"], {"_n": ("_one", "sum", False)}, bin_size).withColumns({"_a": F.when(F.col("_anchor"), F.col("k")), "_m": F.when(F.col("_anchor"), F.col("_n"))})
    members = cut_lineage(running(members, KEYS, ["k"], {"start": ("_a", "max", True), "_from": ("_m", "max", True)}, bin_size))
    sizes = members.groupBy(*KEYS, "start").agg((F.count("*") - 1).alias("_last"))
    nth = F.when(F.col("_anchor"), F.col("_last")).otherwise(F.col("_n") - F.col("_from") - 1)
    return members.join(sizes, [*KEYS, "start"]).withColumn("member", nth.cast("int")).drop("_one", "_anchor", "_n", "_a", "_m", "_from", "_last")


def group_signatures(sigs: DataFrame, options: SvOptions = SvOptions(), bin_size: int = BIN) -> DataFrame:
    """Groups of signatures (qid, sid, type, sfrom, len): sid, type, pass, island, group_nth, member, qid, sfrom, len.

    Order within a subject and type: sfrom, then qid, then len. Pass 1, strict: a scan stands at the first place that is
    left. Windows start there and at the places after it. The first holds ``strict_window`` places; if the place behind
    it is empty, as many windows follow as places beyond that one are occupied without a break, each of a place more.
    The first of the fullest windows gives the middle, its member at half of its number; all that are left within
    ``strict_distance`` of it are a group, if they are enough, and the scan goes on behind them in any case. Pass 2,
    relaxed (see ``_relaxed``), sees what pass 1 left. An island is a stretch without a gap wider than both scans reach
    over, numbered along the subject; groups are numbered within their island and pass.
    """
    widest = max(options.strict_distance, options.relaxed_window, options.strict_window + 1)
    rows = sigs.select(*(F.col(c).cast("int" if c == "type" else "long").alias(c) for c in ("qid", "sid", "type", "sfrom", "len"))).withColumn("_one", F.lit(1))
    numbered = cut_lineage(running(rows, KEYS, ["sfrom", "qid", "len"], {"n": ("_one", "sum", False)}, bin_size).drop("_one"))
    places = cut_lineage(numbered.groupBy(*KEYS, F.col("sfrom").alias("p")).agg(F.count("*").alias("c")))
    strict = cut_lineage(_strict(places, options, bin_size))
    marked = cut_lineage(numbered.join(strict.withColumnRenamed("p", "sfrom"), [*KEYS, "sfrom"], "left"))
    one = marked.where("start is not null")
    one = one.join(one.groupBy(*KEYS, "start").agg(F.min("n").alias("_first")), [*KEYS, "start"]).select(*KEYS, F.lit(1).alias("pass"), "start", F.col("start").alias("head"), (F.col("n") - F.col("_first")).cast("int").alias("member"), "qid", "sfrom", "len")
    rest = running(marked.where("start is null").drop("start").withColumn("_one", F.lit(1)), KEYS, ["n"], {"k": ("_one", "sum", False)}, bin_size).drop("_one", "n")
    two = _relaxed(rest.withColumn("k", F.col("k").cast("long")), options, bin_size)
    two = two.join(two.where(F.col("k") == F.col("start")).select(*KEYS, "start", F.col("sfrom").alias("head")), [*KEYS, "start"]).select(*KEYS, F.lit(2).alias("pass"), "start", "head", "member", "qid", "sfrom", "len")
    found = cut_lineage(one.unionByName(two))
    stretches = islands(places, KEYS, "p", "p", widest, bin_size=bin_size).select(*KEYS, F.col("p").alias("head"), F.col("_island").cast("long").alias("island"))
    heads = found.select(*KEYS, "pass", "start", "head").distinct().join(stretches, [*KEYS, "head"]).withColumn("_one", F.lit(1))
    heads = cut_lineage(running(heads, [*KEYS, "pass"], ["start"], {"_n": ("_one", "sum", False)}, bin_size))
    heads = heads.join(heads.groupBy(*KEYS, "pass", "island").agg(F.min("_n").alias("_first")), [*KEYS, "pass", "island"]).select(*KEYS, "pass", "start", "island", (F.col("_n") - F.col("_first")).cast("int").alias("group_nth"))
    return found.join(heads, [*KEYS, "pass", "start"]).select(*KEYS, "pass", "island", "group_nth", "member", "qid", "sfrom", "len")


def with_group_ids(groups: DataFrame) -> DataFrame:
    """Consecutive group ids from 0 a subject: insertions strict, relaxed, then deletions strict, relaxed.

    Groups are counted in bins of islands, so only one row a bin of a subject meets.
    """
    heads = groups.select("sid", "type", "pass", "island", "group_nth").distinct().withColumn("_one", F.lit(1))
    # one axis a subject: type and pass first, then the island
    axis = ((F.when(F.col("type") > 0, 0).otherwise(2) + F.col("pass") - 1).cast("long") * (1 << 44)) + F.col("island")
    ids = running(heads.withColumn("_axis", axis), ["sid"], ["_axis", "group_nth"], {"group_id": ("_one", "sum", False)})
    return groups.join(ids.drop("_one", "_axis").withColumn("group_id", F.col("group_id").cast("long")), ["sid", "type", "pass", "island", "group_nth"])


def first_of_each_read(groups: DataFrame) -> DataFrame:
    """Members with a read's first place in its group only."""
    order = Window.partitionBy("sid", "type", "pass", "island", "group_nth", "qid").orderBy("member")
    return groups.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def with_reads(members: DataFrame, reads: DataFrame) -> DataFrame:
    """Group members with their raw reads: adds ``seq`` of the read (rid, seq); members without one are dropped."""
    return members.join(reads.select(F.col("rid").alias("qid"), "seq"), "qid")


def most_alike(members: DataFrame, keys: list[str], most: int = 50, share: float = 0.2, size: str = "len") -> DataFrame:
    """Groups of more than ``most`` members keep the ``most`` that are like most others in length.

    The number of alike members comes from counts by length, not from pairs of members.
    """
    n = members.groupBy(*keys, size).agg(F.count("*").alias("k"))
    other = n.select(*keys, F.col(size).alias("_size"), F.col("k").alias("_k"))
    alike = F.abs(F.col(size) - F.col("_size")) <= share * F.greatest(size, "_size")
    votes = n.join(other, keys).where(alike).groupBy(*keys, size).agg((F.sum("_k") - 1).alias("votes"))
    whole = n.groupBy(*keys).agg(F.sum("k").alias("_all"))
    ranked = members.join(votes, [*keys, size]).join(whole, keys).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("votes"), "qid", "sfrom")))
    return ranked.where((F.col("_all") <= most) | (F.col("_n") <= most)).drop("_n", "_all")


def simple_calls(groups: DataFrame) -> DataFrame:
    """One call a group: median place and length (the element at half), and the number of distinct reads."""
    return groups.groupBy("sid", "type", "group_id").agg(F.sort_array(F.collect_list("sfrom")).alias("s"), F.sort_array(F.collect_list("len")).alias("l"), F.countDistinct("qid").alias("support")).select("sid", "type", "group_id", F.element_at("s", (F.floor(F.size("s") / 2) + 1).cast("int")).alias("pos"), F.element_at("l", (F.floor(F.size("l") / 2) + 1).cast("int")).alias("len"), "support")
