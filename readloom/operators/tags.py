"""Tags of reads by the pattern of their alignments: perfect, repeat, circular, rcdup, tandem-repeat or unperfect."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.intervals import whole_groups
from readloom.operators.scratch import cut_lineage, dealt
from readloom.schemas import REV

#: Bases that may be missing at an end, or uncovered; points by which identities differ.
SLACK, LEAD = 200, 8.0
# Names of the tags, in the order in which they are looked for.
NAMES = ("perfect", "repeat", "circular", "rcdup", "tandem-repeat", "unperfect")


def _covered(begin: np.ndarray, end: np.ndarray) -> int:
    """Places that intervals cover together."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    before = np.concatenate([[begin[0]], reach[:-1]])
    return int(np.maximum(0, reach - np.maximum(begin, before)).sum())


def _tandem(places: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int, slack: int) -> bool:
    """Do alignments that start within ``slack`` of the first of them (places rising) cover the read? The next lot starts behind."""
    first = 0
    while first < len(places):
        behind = int(np.searchsorted(places, places[first] + slack, side="right"))
        if behind - first > 1 and size - _covered(begin[first:behind], end[first:behind]) <= slack:
            return True
        first = behind
    return False


def _tandem_reads(rows: DataFrame, slack: int) -> DataFrame:
    """Reads with a tandem repeat: several alignments of a strand to one place of a subject, of its left or right ends,
    cover the read together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, groups in whole_groups(batches, ["qid", "sid", "qdir"]):
            found = []
            for a, b in groups:
                if b - a > 1:
                    g = pdf.iloc[a:b]
                    soff, send, q, e = (g[c].to_numpy() for c in ("soff", "send", "qoff", "qend"))
                    back, size = np.argsort(-send, kind="stable"), int(g["qsize"].iloc[0])
                    if _tandem(soff, q, e, size, slack) or _tandem(-send[back], q[back], e[back], size, slack):
                        found.append(int(g["qid"].iloc[0]))
            yield pd.DataFrame({"qid": pd.Series(found, dtype="int64")})

    return dealt(rows, ["qid", "sid", "qdir"], "soff", "send", "qoff").mapInPandas(run, "qid long").distinct()


def _turned_reads(rows: DataFrame, slack: int) -> DataFrame:
    """Reads of which one part aligns forward, another one reversed, to nearly the same place, and both cover the read."""
    side = lambda dir_, x: rows.where(F.col("qdir") == REV if dir_ else F.col("qdir") != REV).select("qid", "sid", "qsize", *(F.col(c).alias(f"{x}_{c}") for c in ("qoff", "qend", "soff", "send")))
    d = side(0, "f").join(side(1, "r").drop("qsize"), ["qid", "sid"])
    within = lambda a, b: (F.col(f"{b}_soff") <= F.col(f"{a}_soff") + slack) & (F.col(f"{a}_send") <= F.col(f"{b}_send") + slack)
    begin, end = F.col("qsize") - F.col("r_qend"), F.col("qsize") - F.col("r_qoff")
    both = F.greatest(F.lit(0), F.least("f_qend", end) - F.greatest("f_qoff", begin))
    covered = F.col("f_qend") - F.col("f_qoff") + end - begin - both
    return d.where((within("r", "f") | within("f", "r")) & (F.col("qsize") - covered <= slack)).select("qid").distinct()


def _reaches(left: str, right: str, slack: int) -> Column:
    return (F.col(f"{left}off") <= slack) & (F.col(f"{right}size") - F.col(f"{right}end") <= slack)


def tag_reads(rows: DataFrame, min_identity: float, slack: int = SLACK, lead: float = LEAD) -> DataFrame:
    """Tag of each read with an alignment of nearly ``min_identity``: qid, qsize, tag.

    rows: qid, qdir, sid, qsize, qoff, qend (in the read's own direction), ssize, soff, send, ident. Alignments of an
    identity of ``min_identity`` less ``lead``, or more, count. Whole ones reach both ends of the read or of the subject,
    but for ``slack``: a read with one, or with a best one that leads by more than ``lead``, is perfect, with more of them a
    repeat. Without any: circular, if two alignments of a strand to a subject reach its start and the read's end, and
    its end and the read's start (wherever they meet); rcdup, see ``_turned_reads``; tandem-repeat, see
    ``_tandem_reads``; else unperfect. A read's alignments to one subject and strand are a group of a task.
    """
    good = rows.where(F.col("ident") + lead >= min_identity)
    back = F.col("qdir") == REV
    turned = {"qoff": F.when(back, F.col("qsize") - F.col("qend")).otherwise(F.col("qoff")), "qend": F.when(back, F.col("qsize") - F.col("qoff")).otherwise(F.col("qend"))}
    good = cut_lineage(good.withColumns(turned).select("qid", "qdir", "sid", *(F.col(c).cast("long").alias(c) for c in ("qsize", "qoff", "qend", "ssize", "soff", "send")), "ident"))
    whole = good.where(_reaches("q", "q", slack) | _reaches("s", "s", slack))
    nth = Window.partitionBy("qid").orderBy(F.desc("ident"))
    best = whole.withColumn("_n", F.row_number().over(nth)).where("_n <= 2").groupBy("qid").agg(F.max("ident").alias("_a"), F.min("ident").alias("_b"), F.count("*").alias("_k"))
    tagged = best.select("qid", F.when((F.col("_k") == 1) | (F.col("_a") - F.col("_b") > lead), 0).otherwise(1).alias("rank"))
    left = cut_lineage(good.join(tagged, "qid", "left_anti"))
    round_ = left.groupBy("qid", "sid", "qdir").agg(F.max(_reaches("s", "q", slack)).alias("l"), F.max(_reaches("q", "s", slack)).alias("r")).where("l and r").select("qid").distinct()
    found = tagged.unionByName(round_.withColumn("rank", F.lit(2))).unionByName(_turned_reads(left, slack).withColumn("rank", F.lit(3))).unionByName(_tandem_reads(left, slack).withColumn("rank", F.lit(4)))
    every = good.groupBy("qid").agg(F.max("qsize").alias("qsize")).join(found.groupBy("qid").agg(F.min("rank").alias("rank")), "qid", "left")
    names = F.array(*(F.lit(n) for n in NAMES))
    return every.select("qid", "qsize", F.element_at(names, F.coalesce("rank", F.lit(len(NAMES) - 1)) + 1).alias("tag"))
