"""From alignments to SV reads, in one order of rules with early ends, and from their aligned strings to signatures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.config import SvOptions
from readloom.functions import alignment as al
from readloom.operators import hits, intervals
from readloom.operators.scratch import cut_lineage


def sv_reads(rows: DataFrame, chain: Callable[[DataFrame], DataFrame], options: SvOptions = SvOptions(), effective: str = "ident", masked: str | None = None, order: str = "aid") -> DataFrame:
    """The alignment that makes a read an SV read, at most one each: qid, sid, qdir, qsize, qoff, qend, soff, send, kind, left_id, right_id.

    A read goes through the rules until one decides. Reads under ``min_seq_size`` go. Of one subject and strand,
    alignments inside others go. A read with any complete alignment is decided by these: its only or best one (see
    ``hits.best_complete``) or, if none is good enough, far enough ahead or outside the mask, nothing. Of the others,
    alignments that repeat each other go, and a read with any pair of duals is decided by these: a single pair on one
    strand and in order is offered to ``chain``, which gets the pairs (as ``hits.unique_duals``, with qsize) and returns
    those that it joins, with their places (it may change them), else nothing. kind is complete or dual; left_id and
    right_id are the alignments' ``order`` ids.

    The rules are joins and anti-joins on the read, so each row is shuffled by read once; a read's alignments are folded
    in the order of ``order`` where a rule looks at them one after the other.
    """
    big = rows.where(F.col("qsize") >= options.min_seq_size)
    left = cut_lineage(intervals.drop_contained(big, ["qid", "sid", "qdir"], [order]))
    whole = left.where(hits.complete(options.end_tolerance)).select("qid").distinct()
    best = hits.best_complete(left, options.identity, tol=options.end_tolerance, effective=effective, masked=masked)
    columns = ["qid", "sid", "qdir", "qsize", "qoff", "qend", "soff", "send"]
    done = best.select(*columns, F.lit("complete").alias("kind"), F.col(order).alias("left_id"), F.col(order).alias("right_id"))
    open_ = intervals.drop_repeats(left.join(whole, "qid", "left_anti"), "qid", [order])
    pairs = hits.dual_pairs(open_, options.identity, options.max_dual_gap, options.end_tolerance, effective, masked)
    sizes = left.groupBy("qid").agg(F.max("qsize").alias("qsize"))
    duals = chain(hits.unique_duals(pairs).join(sizes, "qid"))
    return done.unionByName(duals.select(*columns, F.lit("dual").alias("kind"), "left_id", "right_id"))


def signatures_of(aligned: DataFrame, options: SvOptions = SvOptions()) -> DataFrame:
    """Signatures of aligned reads (qid, sid, qdir, soff, q_aln, s_aln): qid, sid, qdir, type, qfrom, qto, sfrom, sto, len.

    Each run of at least ``min_indel`` gaps is one: type 0 where the query lacks bases, 6 where it has more. Query places
    count from the aligned part's first base, along the aligned strand. Alignments whose identity without long gaps is
    under ``identity`` give none.
    """
    good = aligned.where(al.effective_identity("q_aln", "s_aln") >= options.identity)
    runs = good.select("qid", "sid", "qdir", F.explode(al.gap_runs("q_aln", "s_aln", F.lit(0), F.col("soff"), options.min_indel)).alias("g")).select("qid", "sid", "qdir", "g.*")
    gone = F.col("kind") == "D"
    size = F.when(gone, F.col("sto") - F.col("sfrom")).otherwise(F.col("qto") - F.col("qfrom"))
    return runs.select("qid", "sid", "qdir", F.when(gone, 0).otherwise(6).alias("type"), "qfrom", "qto", "sfrom", "sto", size.cast("long").alias("len"))
