"""Pileup consensus: votes, coverage and the best path; correction of a group's reads by each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.config import ConsensusOptions
from readloom.functions import alignment as al
from readloom.operators import align, intervals, kmers, mapping, traceback
from readloom.operators.scratch import dealt

#: Seeds within a pair of reads.
KMER, STEP, SEED_SCORE = 10, 6, 50


#: Votes that a task collects before it sums equal ones, and sums that it holds before it gives them on.
AT_ONCE, HELD = 1 << 20, 1 << 20


def _tally(which: np.ndarray, first: np.ndarray, weigh: np.ndarray, qs: list[str], ss: list[str]) -> list[np.ndarray]:
    """Summed votes of alignments of groups ``which`` from ``first`` on: group, t_pos, delta, base, p_delta, p_base, weight, n."""
    sizes = np.array([len(s) for s in ss], np.int64)
    ends = np.cumsum(sizes)
    a, has = al.letters(qs, sizes).astype(np.int32), al.letters(ss, sizes) != ord("-")
    row, starts = np.repeat(np.arange(len(ss)), sizes), ends - sizes
    seen, n = np.concatenate([[0], np.cumsum(has)]), np.arange(len(has))
    at = seen[1:] + (first - 1 - seen[starts])[row]
    delta = n - np.maximum(np.maximum.accumulate(np.where(has, n, -1)), (starts - 1)[row])
    p_delta, p_base = (np.concatenate([np.zeros(1, v.dtype), v[:-1]]) for v in (delta, a))
    p_delta[starts], p_base[starts] = 0, ord(".")
    return _summed([which[row], at, delta, a, p_delta, p_base, weigh[row], None])


def _summed(cols: list) -> list[np.ndarray]:
    """Equal votes as one. The column n may be missing where each row is one vote."""
    keys, weigh, n = cols[:-2], cols[-2], cols[-1]
    code, size, whole = np.zeros(len(weigh), np.int64), 1, True
    lows, ranges = [int(c.min()) for c in keys], [int(c.max()) - int(c.min()) + 1 for c in keys]
    for c, low, wide in zip(keys, lows, ranges, strict=True):
        if size > (1 << 62) // wide:
            code, whole = np.unique(code, return_inverse=True)[1].astype(np.int64), False
            size = int(code.max()) + 1
        code = code * wide + (c - low)
        size *= wide
    if whole and n is None and (weigh == 1).all():  # the columns are read from the code, no row need be found again
        code, n = np.unique(code, return_counts=True)
        out = []
        for c, low, wide in zip(keys[::-1], lows[::-1], ranges[::-1], strict=True):
            code, rest = np.divmod(code, wide)
            out.append((rest + low).astype(c.dtype))
        return [*out[::-1], n.astype(np.float64), n]
    _, first, which = np.unique(code, return_index=True, return_inverse=True)
    return [*(c[first] for c in keys), np.bincount(which, weigh), np.bincount(which, n).astype(np.int64)]


def votes(rows: DataFrame, group: str, q: str = "q_aln", s: str = "s_aln", start: str = "soff", weight: str | None = None) -> DataFrame:
    """Votes of the columns of alignments: group, t_pos, delta, base, those of the column before, weight, n.

    t_pos is the subject's place, delta counts insertions behind it. Running counts over the columns of one alignment.
    A task sums equal votes (weight) and counts them (n) before it gives them on, as far as it can hold them.
    """
    kind = rows.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict = {}  # of each group that votes are held of
        fresh, held, size = [], [], 0

        def summed(more: list, least: int) -> list:
            """What is held, summed if it is more than so many votes."""
            both = [*held, *more]
            return [_summed([np.concatenate(c) for c in zip(*both, strict=True)])] if len(both) > 1 and sum(len(h[0]) for h in both) > least else both

        def tally() -> list:
            which, first, weigh, qs, ss = zip(*fresh, strict=True)
            return [_tally(np.array(which), np.array(first, np.int64), np.array(weigh, np.float64), qs, ss)]

        def give(type_: pa.DataType) -> Iterator[pa.RecordBatch]:
            names = pa.array(list(number), type_)
            for which, at, delta, base, p_delta, p_base, weigh, n in held:
                p_at = at - (delta == 0)  # the same place, behind which the base is, or the one before
                letters = [c.astype(np.uint32).view("U1") for c in (base, p_base)]
                cols = [which, at, delta.astype(np.int32), letters[0], p_at, p_delta.astype(np.int32), letters[1], weigh, n]
                for i in range(0, len(which), 1 << 16):
                    part = [pa.array(c[i : i + (1 << 16)]) for c in cols]
                    yield pa.RecordBatch.from_arrays([names.take(part[0]), *part[1:]], names=["group", *_VOTE[1:], "weight", "n"])

        for batch in batches:
            for name, x, y, first, weigh in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if x and y:
                    fresh.append((number.setdefault(name, len(number)), first, weigh, x, y))
                    size += len(y)
                    if size >= AT_ONCE:
                        held = summed(tally(), HELD)
                        fresh, size = [], 0
                        if sum(len(h[0]) for h in held) > HELD:
                            yield from give(batch.column(0).type)
                            held, number = [], {}
        held = summed(tally() if fresh else [], 0)
        if held:
            yield from give(batch.column(0).type)

    weigh = (F.col(weight) if weight else F.lit(1.0)).cast("double")
    made = rows.select(F.col(group).alias("group"), F.col(q).alias("_q"), F.col(s).alias("_s"), F.col(start).cast("long").alias("_at"), weigh.alias("_w"))
    return made.mapInArrow(run, f"group {kind}, t_pos long, delta int, base string, p_t_pos long, p_delta int, p_base string, weight double, n long")


_VOTE = ["group", "t_pos", "delta", "base", "p_t_pos", "p_delta", "p_base"]


def pileup(votes: DataFrame) -> DataFrame:
    """Votes summed by place, base and predecessor."""
    return votes.groupBy(*_VOTE).agg(F.sum("weight").alias("weight"))


def covered(votes: DataFrame) -> DataFrame:
    """``pileup`` with the number of alignments that cover each place (cov; 0: none but in insertions)."""
    summed = votes.groupBy(*_VOTE).agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))
    own = F.sum(F.when(F.col("delta") == 0, F.col("n")).otherwise(0)).over(Window.partitionBy("group", "t_pos"))
    return summed.withColumn("cov", own).drop("n")


def consensus(piled: DataFrame, factor: float = 0.4) -> DataFrame:
    """The best path through each group's pileup (``covered``): group, seq (gaps dropped).

    A node's score is its weight less ``factor`` times the coverage of its place, plus the best score of its
    predecessor. The dynamic programme runs over a group's summed votes, which grow with the length, not the reads.
    """
    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        best: dict[tuple, tuple[float, tuple | None]] = {}
        rows = pdf.sort_values(["t_pos", "delta", "base", "p_t_pos", "p_delta", "p_base"])
        for r in rows.itertuples(index=False):
            node, before = (r.t_pos, r.delta, r.base), (r.p_t_pos, r.p_delta, r.p_base)
            score = r.weight - factor * r.cov + (best[before][0] if before in best else 0.0)
            if node not in best or score > best[node][0]:
                best[node] = (score, before if before in best else None)
        at = max(best, key=lambda k: (best[k][0], k))
        out = []
        while at is not None:
            out.append(at[2])
            at = best[at][1]
        return pd.DataFrame({"group": [pdf["group"].iloc[0]], "seq": ["".join(reversed(out)).replace("-", "")]})

    return piled.groupBy("group").applyInPandas(path, f"group {piled.schema['group'].dataType.simpleString()}, seq string")


def group_pairs(reads: DataFrame) -> DataFrame:
    """All ordered pairs of two reads (group, rid) of a group: group, qid, sid. Groups have at most 50 or so members
    (``signatures.most_alike``)."""
    return reads.select("group", F.col("rid").alias("qid")).join(reads.select("group", F.col("rid").alias("sid")), "group").where("qid != sid")


def correct(reads: DataFrame, identity: float, exact: bool, options: ConsensusOptions = ConsensusOptions()) -> DataFrame:
    """Correct each read by the others of its group: group, rid, seq, from, to, raw_size.

    reads: group and rid (of any type), seq. The others are aligned to it, on the strand and along the chain of the
    best score, then refined between anchors or, if ``exact``, aligned anew by banded affine gaps; alignments must
    cover a share of either read. Then as ``_assembled``. Reads without one are left out, as are null and empty ones.
    """
    name = lambda rid: F.concat_ws(":", "group", rid)
    keyed = reads.where("seq != ''").withColumn("_key", name("rid"))
    by_key = keyed.select(F.col("_key").alias("rid"), "seq")
    pairs = group_pairs(keyed).select(name("qid").alias("qid"), name("sid").alias("sid"))
    both = kmers.strands(by_key)
    asked = kmers.occurrences(both.withColumn("_who", F.struct("rid", "qdir")), KMER, STEP, "_who").select("rid.rid", "rid.qdir", "off", "kmer")
    seeds = kmers.pair_seeds(pairs, asked, kmers.occurrences(by_key, KMER, 1))
    best = F.max_by(F.struct("qdir", "seeds"), F.struct("score", -F.col("qdir")))
    chained = align.chains(seeds, KMER, SEED_SCORE, 1).groupBy("qid", "sid").agg(best.alias("b")).select("qid", "b.qdir", "sid", F.lit(1).alias("nth"), F.lit(0).alias("score"), "b.seeds")
    d = mapping.along_chains(chained, both, by_key, KMER).where(F.col("send") - F.col("soff") >= options.min_overlap)
    again = traceback.refined.asNondeterministic()("q_aln", "s_aln") if not exact else traceback.align_banded.asNondeterministic()(F.replace("q_aln", F.lit("-"), F.lit("")), F.replace("s_aln", F.lit("-"), F.lit("")))
    d = d.select("sid", "soff", "send", again.alias("p")).select("sid", "soff", "send", "p.*")
    d = traceback.measured(d).where(F.col("ident") >= identity).select("sid", "soff", "send", "q_aln", "s_aln")
    made = _assembled(by_key, mapping.cut_lineage(d), options).withColumnRenamed("rid", "_key")
    return keyed.drop("seq").join(made, "_key").select("group", "rid", "seq", "from", "to", "raw_size")


def _assembled(reads: DataFrame, aligned: DataFrame, options: ConsensusOptions, splice: bool = True, share: float = 0.0) -> DataFrame:
    """Reads (rid, seq) by their alignments (sid, soff, send, q_aln, s_aln): rid, seq, from, to, raw_size.

    The longest stretch of enough coverage is replaced by the consensus, which is then from ``from`` to ``to`` of seq;
    without ``splice``, seq is the consensus alone, and ``from`` and ``to`` say what it replaces. Reads of which the stretch
    is less than ``share`` are left out.
    """
    run = intervals.longest_covered(aligned.select("sid", F.col("soff").alias("from"), F.col("send").alias("to")), ["sid"], options.min_cov, options.min_size).withColumnRenamed("sid", "group")
    v = votes(aligned, "sid").join(run, "group").where("t_pos >= `from` and t_pos < `to`").drop("from", "to")
    made = consensus(covered(v), options.coverage_factor).withColumnRenamed("seq", "_c")
    out = reads.join(run.join(made, "group").withColumnRenamed("group", "rid"), "rid").withColumn("raw_size", F.length("seq")).where(F.col("to") - F.col("from") >= share * F.col("raw_size"))
    if not splice:
        return out.select("rid", F.col("_c").alias("seq"), "from", "to", "raw_size")
    head, tail = F.substring(F.col("seq"), F.lit(1), F.col("from").cast("int")), F.substring(F.col("seq"), (F.col("to") + 1).cast("int"), F.col("raw_size"))
    return out.select("rid", F.concat(head, "_c", tail).alias("seq"), "from", (F.col("from") + F.length("_c")).alias("to"), "raw_size")


def _unsaturated(rows: DataFrame, full: int, slack: int) -> DataFrame:
    """Supporters that count, taken in order of rank: sid, qid.

    rows: sid, qid, rank (from 0), cb, ce (where the supporter's chain lies on sid), sb, se (its alignment; null: none that
    counts), size. From the rank ``full`` on, one is passed over if fewer than ``slack`` places of its chain are covered
    less than ``full`` times by those before it; once so many count, none is taken if that holds for the whole read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, groups in intervals.whole_groups(batches, ["sid"]):
            sid, qid, rank, cb, ce, sb, se, size = (pdf[c].to_numpy() for c in ("sid", "qid", "rank", "cb", "ce", "sb", "se", "size"))
            kept = []
            for a, b in groups:
                cover, taken = np.zeros(int(size[a]), np.int32), 0
                for i in range(a, b):
                    saturated = rank[i] >= full and (cover[cb[i] : ce[i]] < full).sum() < slack
                    if saturated or sb[i] < 0:
                        continue
                    cover[sb[i] : se[i]] += 1
                    kept.append(i)
                    taken += 1
                    if taken >= full and (cover < full).sum() < slack:
                        break
            yield pd.DataFrame({"sid": sid[kept], "qid": qid[kept]})

    return dealt(rows, ["sid"], "rank").mapInPandas(run, "sid long, qid long")


def correct_long(reads: DataFrame, candidates: DataFrame, identity: float, options: ConsensusOptions = ConsensusOptions(), splice: bool = True, most: int = 80, full: int = 12, slack: int = 200) -> DataFrame:
    """Correct long reads by partial supporters: rid, seq, from, to, raw_size, added (supporters that count).

    reads: rid (long), seq; candidates: qid, sid (of reads), score. Reads under ``min_size`` or with fewer than
    ``min_cov`` candidates are left out. Each read takes its ``most`` best candidates in order of score (ties: the smaller
    id), on the strand and along the chain of the best score, aligned over the chain's part; those of the identity count
    until their places are saturated (see ``_unsaturated``). Then as ``_assembled``: with ``splice`` the corrected stretch
    replaces the read's own; without, it must be 0.8 of the read and is returned alone.

    A read's candidates are bounded by ``most``, so nothing grows with the depth; the first ``full`` are aligned, and of the
    others those whose place isn't yet saturated by these.
    """
    whole = reads.where("seq is not null").where(F.length("seq") >= options.min_size).select(F.col("rid").cast("long").alias("rid"), "seq")
    best = Window.partitionBy("sid").orderBy(F.desc("score"), "qid")
    ranked = candidates.where("qid <> sid").groupBy("qid", "sid").agg(F.max("score").alias("score")).join(whole.select(F.col("rid").alias("sid"), F.length("seq").cast("long").alias("size")), "sid")
    ranked = ranked.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < most)
    enough = ranked.groupBy("sid").agg(F.count("*").alias("k")).where(F.col("k") >= options.min_cov).select("sid")
    ranked = mapping.cut_lineage(ranked.join(enough, "sid", "left_semi"))
    named = ranked.select(F.col("sid").alias("rid")).union(ranked.select("qid")).distinct()
    every = mapping.cut_lineage(reads.where("seq <> ''").select(F.col("rid").cast("long").alias("rid"), "seq").join(named, "rid", "left_semi"))
    both = kmers.strands(every)
    seeds = kmers.pair_seeds(ranked, kmers.words(every, KMER, STEP, reverse=True), kmers.words(every, KMER))
    strand = F.max_by(F.struct("qdir", "seeds"), F.struct("score", -F.col("qdir"))).alias("b")
    chained = align.chains(seeds, KMER, SEED_SCORE, 1).groupBy("qid", "sid").agg(strand).select("qid", "b.qdir", "sid", F.lit(1).alias("nth"), F.lit(0).alias("score"), "b.seeds")
    placed = chained.join(ranked.select("qid", "sid", "rank", "size"), ["qid", "sid"]).withColumns({"cb": F.col("seeds")[0].soff, "ce": F.element_at("seeds", -1).soff + KMER})
    placed = mapping.cut_lineage(placed)

    def aligned(rows: DataFrame) -> DataFrame:
        d = mapping.along_chains(rows.drop("rank", "size", "cb", "ce"), both, every, KMER).where(F.col("send") - F.col("soff") >= options.min_overlap)
        again = d.select("qid", "sid", "soff", "send", traceback.refined.asNondeterministic()("q_aln", "s_aln").alias("p")).select("qid", "sid", "soff", "send", "p.*")
        return mapping.cut_lineage(traceback.measured(again).where(F.col("ident") >= identity).select("qid", "sid", "soff", "send", "q_aln", "s_aln"))

    first = aligned(placed.where(F.col("rank") < full))
    depths = intervals.depth(first.select("sid", F.col("soff").alias("from"), F.col("send").alias("to")), ["sid"])
    later = placed.where(F.col("rank") >= full).withColumns({"from": F.col("cb"), "to": F.col("ce"), "_id": F.concat_ws(":", "sid", "qid")})
    later = intervals.saturated(later, depths, ["sid"], "_id", full, slack).where("not full").drop("from", "to", "_id", "full")
    done = first.unionByName(aligned(later))
    spans = placed.select("sid", "qid", "rank", "cb", "ce", "size").join(done.select("sid", "qid", F.col("soff").alias("sb"), F.col("send").alias("se")), ["sid", "qid"], "left").fillna(-1, ["sb", "se"])
    kept = mapping.cut_lineage(_unsaturated(spans, full, slack))
    made = _assembled(whole, mapping.cut_lineage(done.join(kept, ["sid", "qid"], "left_semi")), options, splice, 0.0 if splice else 0.8)
    return made.join(kept.groupBy(F.col("sid").alias("rid")).agg(F.count("*").alias("added")), "rid")


def two_rounds(reads: DataFrame, options: ConsensusOptions = ConsensusOptions()) -> DataFrame:
    """``correct``, and once more with the corrected reads and the second identity."""
    first = mapping.cut_lineage(correct(reads, options.identity_first, False, options))
    return correct(first.select("group", "rid", "seq"), options.identity_second, True, options)
