"""Selection among alignments: top-k, completeness, pairing of broken ones, overlap classes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.intervals import islands
from readloom.schemas import REV


def complete(tol: int = 300) -> Column:
    """Does the alignment reach both ends of the query?"""
    return (F.col("qoff") <= tol) & (F.col("qsize") - F.col("qend") <= tol)


def overlap_class(tol: int = 100) -> Column:
    """contained, contains, dovetail, overhang or partial, by which ends an alignment reaches."""
    ql, qr = F.col("qoff") <= tol, F.col("qsize") - F.col("qend") <= tol
    sl, sr = F.col("soff") <= tol, F.col("ssize") - F.col("send") <= tol
    return F.when(ql & qr, "contained").when(sl & sr, "contains").when((ql & sr) | (qr & sl), "dovetail").when(ql | qr, "overhang").otherwise("partial")


def both_ends(rows: DataFrame, tol: int = 100) -> DataFrame:
    """Rows of queries that overlap others at their left and at their right end."""
    lol = (F.col("qoff") <= tol) & (F.col("ssize") - F.col("send") <= tol)
    rol = (F.col("qsize") - F.col("qend") <= tol) & (F.col("soff") <= tol)
    good = rows.groupBy("qid").agg(F.max(lol.cast("int")).alias("l"), F.max(rol.cast("int")).alias("r")).where("l = 1 and r = 1").select("qid")
    return rows.join(good, "qid", "left_semi")


def covers(bases: int, percent: float, start: str = "qoff", end: str = "qend", size: str = "qsize") -> Column:
    span = F.col(end) - F.col(start)
    return (span >= bases) | (100 * span >= percent * F.col(size))


def best_scores(rows: DataFrame) -> DataFrame:
    """The best score of each query and subject: qid, sid, best."""
    return rows.groupBy("qid", "sid").agg(F.max("score").alias("best"))


def top_subjects(rows: DataFrame, k: int, one_each: bool = False) -> DataFrame:
    """Rows of each query's ``k`` best subjects by their best score; one_each: only the best row of each.

    Ties go to the smaller subject and the smaller row id. The best score of a pair is a partial aggregation; only
    the pairs, not their rows, are ranked.
    """
    best = best_scores(rows)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("best"), "sid"))
    chosen = best.withColumn("subject_rank", rank).where(F.col("subject_rank") <= k).select("qid", "sid", "subject_rank")
    kept = rows.join(chosen, ["qid", "sid"])
    if one_each:
        first = F.row_number().over(Window.partitionBy("qid", "sid").orderBy(F.desc("score"), "aid"))
        kept = kept.withColumn("_n", first).where("_n = 1").drop("_n")
    return kept


def top_hsps(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query and subject."""
    order = Window.partitionBy("qid", "sid").orderBy(F.desc("score"), "aid")
    return rows.withColumn("hsp_rank", F.row_number().over(order)).where(F.col("hsp_rank") <= k)


def top_window_hsps(rows: DataFrame, k: int, gap: int = 500, more_windows: int = 2, each: int = 3) -> DataFrame:
    """The first ``k`` rows of each query and subject, window by window.

    Windows are the rows of a strand that lie at most ``gap`` apart on the subject, the one with the best row first
    (then by strand and place); no more than ``k`` + ``more_windows`` of them are looked at, and in each the ``each``
    best rows. Adds window and hsp_rank.
    """
    own = Window.partitionBy("qid", "sid", "qdir", "_island")
    d = islands(rows, ["qid", "sid", "qdir"], "soff", "send", gap, ("aid",), bin_size=None)
    d = d.withColumns({"_best": F.max("score").over(own), "_first": F.min("soff").over(own), "_nth": F.row_number().over(own.orderBy(F.desc("score"), "aid"))})
    pair = Window.partitionBy("qid", "sid")
    d = d.withColumn("window", F.dense_rank().over(pair.orderBy(F.desc("_best"), "qdir", "_first"))).where((F.col("window") <= k + more_windows) & (F.col("_nth") <= each))
    d = d.withColumn("hsp_rank", F.row_number().over(pair.orderBy("window", "_nth"))).where(F.col("hsp_rank") <= k)
    return d.drop("_best", "_first", "_nth", "_island")


def top_support(rows: DataFrame, k: int) -> DataFrame:
    """Each subject's ``k`` best supporting queries; Spark keeps ``k`` a subject in each task before they meet."""
    best = rows.groupBy("sid", "qid").agg(F.max("score").alias("score"))
    order = Window.partitionBy("sid").orderBy(F.desc("score"), "qid")
    return best.withColumn("support_rank", F.row_number().over(order)).where(F.col("support_rank") <= k)


def best_complete(rows: DataFrame, identity: float, lead: float = 10.0, tol: int = 300, effective: str = "ident", masked: str | None = None) -> DataFrame:
    """Each query's complete alignment: its only one, if of the identity; of several, by the column ``effective``
    (identity without long gaps), the only one of the identity, or the best if it leads by more than ``lead``.

    A winner that the boolean column ``masked`` marks yields nothing, nor does another of its query.
    """
    order = Window.partitionBy("qid").orderBy(F.desc("_by"), "aid")
    found = rows.where(complete(tol)).withColumn("_all", F.count("*").over(Window.partitionBy("qid")))
    found = found.withColumn("_by", F.when((F.col("_all") == 1) & (F.col("ident") >= identity), F.col("ident")).otherwise(F.col(effective))).where(F.col("_by") >= identity)
    ranked = found.withColumn("_n", F.row_number().over(order)).withColumn("_next", F.lead("_by").over(order))
    ranked = ranked.where((F.col("_n") == 1) & (F.col("_next").isNull() | (F.col("_by") - F.col("_next") > lead)))
    return (ranked.where(~F.col(masked)) if masked else ranked).drop("_n", "_next", "_all", "_by")


def dual_pairs(rows: DataFrame, identity: float = 70.0, most: int = 30_000, tol: int = 300, effective: str = "ident", masked: str | None = None) -> DataFrame:
    """Two incomplete alignments of one query to one subject, that reach its left and its right end.

    They overlap on the subject, or are at most ``most`` apart; their strands may differ. Rows that the boolean column
    ``masked`` marks take no part; those under the identity do if the column ``effective`` reaches it.
    """
    good = rows.where((F.col("ident") >= identity) | (F.col(effective) >= identity))
    good = good.where(~F.col(masked)) if masked else good
    at_left = (F.col("qoff") <= tol) & (F.col("qsize") - F.col("qend") > tol)
    at_right = (F.col("qoff") > tol) & (F.col("qsize") - F.col("qend") <= tol)
    side = lambda where, name, x: good.where(where).select("qid", "sid", F.col("aid").alias(f"{name}_id"), F.col("qdir").alias(f"{x}dir"), F.col("qoff").alias(f"{x}qb"), F.col("qend").alias(f"{x}qe"), F.col("soff").alias(f"{x}b"), F.col("send").alias(f"{x}e"))
    near = (F.greatest("lb", "rb") - F.least("le", "re")) <= most
    return side(at_left, "left", "l").join(side(at_right, "right", "r"), ["qid", "sid"]).where(near)


def unique_duals(pairs: DataFrame) -> DataFrame:
    """The only pair of a query, over all subjects, if both are on one strand and in order: its hull.

    Seen along the subject's strand, the query's left part comes first; on the reverse strand that is the pair's right.
    """
    alone = pairs.withColumn("_n", F.count("*").over(Window.partitionBy("qid"))).where("_n = 1 and ldir = rdir")
    ordered = F.when(F.col("ldir") == REV, F.col("rb") <= F.col("lb")).otherwise(F.col("lb") <= F.col("rb"))
    hull = {"qoff": F.least("lqb", "rqb"), "qend": F.greatest("lqe", "rqe"), "soff": F.least("lb", "rb"), "send": F.greatest("le", "re")}
    return alone.where(ordered).select("qid", "sid", F.col("ldir").alias("qdir"), "left_id", "right_id", *(c.alias(n) for n, c in hull.items()))


def broken_pairs(rows: DataFrame, tol: int = 50) -> DataFrame:
    """Pairs of alignments of one query, subject and strand that continue each other, in order of preference.

    One starts at an end of the subject or of the query, the other ends at one, and together they run forward. The
    eight cases count in this order, x and y being the two in either role: x at the subject's start and y at the
    subject's, or the query's, end; x at the subject's end and y at the subject's, or query's, start; x at the query's
    start and y at the query's, or subject's, end; x at the query's end and y at the query's, or subject's, start.
    Returns qid, sid, a, b (in the roles), case (1 to 8), the hull, and rank: from 1 by the earlier and the later of
    both alignments, the earlier in role x first.
    """
    side = lambda x: rows.select("qid", "sid", "qdir", *(F.col(c).alias(f"{x}_{c}") for c in ("aid", "qoff", "qend", "qsize", "soff", "send", "ssize")))
    d = side("x").join(side("y"), ["qid", "sid", "qdir"]).where("x_aid <> y_aid")
    starts = {f"{x}{o}": F.col(f"{x}_{o}off") <= tol for x in "xy" for o in "qs"}
    ends = {f"{x}{o}": F.col(f"{x}_{o}size") - F.col(f"{x}_{o}end") <= tol for x in "xy" for o in "qs"}
    forward = {f"{x}{o}": F.col(f"{x}_{o}off") < F.col(f"{'y' if x == 'x' else 'x'}_{o}end") for x in "xy" for o in "qs"}
    cases = [
        starts["xs"] & ends["ys"] & forward["xq"], starts["xs"] & ends["yq"] & forward["xs"], ends["xs"] & starts["ys"] & forward["yq"], ends["xs"] & starts["yq"] & forward["ys"],
        starts["xq"] & ends["yq"] & forward["xs"], starts["xq"] & ends["ys"] & forward["xq"], ends["xq"] & starts["yq"] & forward["ys"], ends["xq"] & starts["ys"] & forward["yq"],
    ]
    case = F.coalesce(*(F.when(c, n) for n, c in enumerate(cases, 1)))
    d = d.withColumn("case", case).where(F.col("case").isNotNull())
    from_x = F.col("case").isin(1, 2, 5, 6)
    hull = {c: F.when(from_x, F.col(f"{p}_{c}")).otherwise(F.col(f"{o}_{c}")) for c, p, o in (("qoff", "x", "y"), ("qend", "y", "x"), ("soff", "x", "y"), ("send", "y", "x"))}
    order = Window.partitionBy("qid", "sid").orderBy(F.least("x_aid", "y_aid"), F.greatest("x_aid", "y_aid"), F.col("x_aid") > F.col("y_aid"))
    d = d.withColumns(hull).withColumn("rank", F.row_number().over(order))
    return d.select("qid", "sid", "qdir", F.col("x_aid").alias("a"), F.col("y_aid").alias("b"), "case", *hull, "rank")


def resolved_overlaps(rows: DataFrame, identity: float = 80.0, tol: int = 50, reach: int = 300, effective: str = "ident", realign: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One overlap of each query and subject at most: the first whole one, else the first pair of broken ones that makes one.

    Rows under the identity take no part. An overlap is whole if it contains or is contained or runs from an end of one
    to an end of the other, within ``reach``. Pairs come from ``broken_pairs`` (ends within ``tol``), in its order, and
    only for queries and subjects without a whole overlap; a pair counts if its hull is a whole overlap. ``realign``
    takes the pairs (qid, sid, qdir, the hull, qsize, ssize, rank, left_ident, right_ident), aligns their hulls anew and
    returns those that are good enough, with new ends; without it hulls stay as they are. Returns qid, sid, qdir, a, b
    (the pair; b null: one whole overlap) and qoff, qend, soff, send.
    """
    whole = overlap_class(reach).isin("contained", "contains", "dovetail")
    good = rows.where(F.col(effective) >= identity)
    ends = ("qdir", "a", "b", "qoff", "qend", "soff", "send")
    first = good.where(whole).groupBy("qid", "sid").agg(F.min_by(F.struct("qdir", F.col("aid").alias("a"), F.lit(None).cast(rows.schema["aid"].dataType).alias("b"), *ends[3:]), "aid").alias("r"))
    left = good.join(first.select("qid", "sid"), ["qid", "sid"], "left_anti")
    of = lambda x, *more: left.select(F.col("aid").alias(x), F.col(effective).alias("left_ident" if x == "a" else "right_ident"), *more)
    pairs = broken_pairs(left, tol).join(of("a", "qsize", "ssize"), "a").join(of("b"), "b")
    pairs = (realign(pairs) if realign else pairs).where(whole)
    second = pairs.groupBy("qid", "sid").agg(F.min_by(F.struct(*ends), "rank").alias("r"))
    return first.unionByName(second).select("qid", "sid", "r.*")


def to_sv_reads(rows: DataFrame) -> DataFrame:
    """SV reads of alignments: dist is the mean span's mismatching part, cut to a whole number."""
    dist = F.floor((F.col("qend") - F.col("qoff") + F.col("send") - F.col("soff")) * (100 - F.col("ident")) / 200).cast("int")
    return rows.select("qid", "qdir", "qoff", "qend", "qsize", "sid", "soff", "send", dist.alias("dist"))


def last_writer(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, that of the greatest ``order``."""
    fields = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("r")).select(key, "r.*")


def subject_coverage(rows: DataFrame) -> DataFrame:
    """Reads, residues and coverage a subject."""
    return rows.groupBy("sid").agg(F.countDistinct("qid").alias("reads"), F.sum(F.col("qend") - F.col("qoff")).alias("residues"), F.round(F.sum(F.col("qend") - F.col("qoff")) / F.max("ssize"), 6).alias("coverage"))
