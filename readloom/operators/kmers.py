"""k-mers: occurrences, frequencies, the seed join, candidate pairs. A pair is a read's strand and a subject: qid, qdir, sid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.functions.sequence import reverse_complement

SEGMENT, SKIP = 300, 200


def occurrences(reads: DataFrame, k: int, step: int, read_id: str = "rid", seq: str = "seq", sample: bool = False) -> DataFrame:
    """k-mers at 0, step, 2*step, ...: rid, off, kmer. The k-mer itself is the join key, no code is needed.

    sample: only those that ``sampled`` keeps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size, last = [], 0, b.num_rows - 1
            for row, text in enumerate(b.column(1)):
                text = text.as_py()
                at = np.arange(0, len(text) - k + 1, step)
                at = at[at % (SEGMENT + SKIP) <= SEGMENT - k] if sample else at
                if text.isascii():
                    words = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text.encode(), np.uint8), k)[at]
                    ends = np.arange(0, (len(at) + 1) * k, k, dtype=np.int32)
                    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(words)))
                else:
                    words = pa.array([text[i : i + k] for i in at.tolist()], pa.string())
                held.append((row, at, words))
                size += len(at)
                if size >= 1 << 16 or row == last:
                    rows = pa.array(np.repeat([h[0] for h in held], [len(h[1]) for h in held]))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array(np.concatenate([h[1] for h in held])), pa.concat_arrays([h[2] for h in held])], names=["rid", "off", "kmer"])
                    held, size = [], 0

    long = reads.where(F.length(seq) >= k).select(F.col(read_id).alias("rid"), F.col(seq).alias("seq"))
    return long.mapInArrow(run, T.StructType([long.schema["rid"], T.StructField("off", T.LongType()), T.StructField("kmer", T.StringType())]))


def sampled(occ: DataFrame, k: int) -> DataFrame:
    """Keep k-mers that lie in a segment of SEGMENT bases, then SKIP bases are passed over."""
    return occ.where(F.pmod("off", F.lit(SEGMENT + SKIP)) <= SEGMENT - k)


def strands(reads: DataFrame, read_id: str = "rid", seq: str = "seq") -> DataFrame:
    """Both strands of each read: rid, qdir, seq. Offsets on the reverse strand count from the read's end."""
    both = reads.where(F.col(seq).isNotNull()).select(F.col(read_id).alias("rid"), F.explode(F.array(F.lit(0), F.lit(1))).alias("qdir"), F.col(seq).alias("_s"))
    return both.select("rid", "qdir", F.when(F.col("qdir") == 1, reverse_complement("_s")).otherwise(F.col("_s")).alias("seq"))


def query_words(reads: DataFrame, k: int) -> DataFrame:
    """Sampled k-mers of both strands, one at each base of a segment: rid, qdir, off, kmer."""
    named = strands(reads).withColumn("_who", F.struct("rid", "qdir"))
    return occurrences(named, k, 1, "_who", sample=True).select("rid.rid", "rid.qdir", "off", "kmer")


def word_list(reads: DataFrame, k: int, step: int, segment: int, skip: int) -> DataFrame:
    """k-mers of both strands at every ``step`` bases of segments: rid, qdir, off, kmer.

    Segments of ``segment`` bases are followed by ``skip`` bases without words; a rest of at most a segment and two
    k-mers belongs to the segment before it.
    """
    s = strands(reads).withColumn("_n", F.length("seq")).where(F.col("_n") >= k)
    # starts of segments: the last one is that behind which at most segment + 2 k bases are left
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - 2 * segment - 2 * k) / (segment + skip)))
    s = s.withColumn("_nth", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    at = F.col("_nth") * (segment + skip)
    size = F.when(F.col("_nth") == last, F.col("_n") - at).otherwise(segment)
    pieces = s.select(F.struct("rid", "qdir", at.cast("long").alias("at")).alias("_who"), F.substring(F.col("seq"), (at + 1).cast("int"), size.cast("int")).alias("seq"))
    return occurrences(pieces, k, step, "_who").select("rid.rid", "rid.qdir", (F.col("rid.at") + F.col("off")).alias("off"), "kmer")


def frequencies(occ: DataFrame) -> DataFrame:
    return occ.groupBy("kmer").agg(F.count("*").alias("n"))


def index(occ: DataFrame, most: int) -> DataFrame:
    """Occurrences of k-mers that occur ``most`` times at most; heavier ones would only give noise."""
    frequent = frequencies(occ).where(F.col("n") > most).select("kmer")
    return occ.join(frequent, "kmer", "left_anti")


def removed(occ: DataFrame, most: int) -> DataFrame:
    """What ``index`` leaves out, in one row: kmers (distinct) and occurrences."""
    return frequencies(occ).where(F.col("n") > most).agg(F.count("*").alias("kmers"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"))


#: Codes of the bases; any other letter has none.
_CODES = np.full(256, 4, np.uint8)
_CODES[np.frombuffer(b"ACGTacgt", np.uint8)] = [0, 1, 2, 3, 0, 1, 2, 3]
#: Words that a task collects before it gives them on.
_CHUNK = 1 << 20


def codes(bases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Code of the word of ``k`` bases (two bits each, the first one highest) at each place, and where there is one."""
    n = len(bases) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, bool)
    out, have, power, size = np.zeros(n, np.int64), 0, (bases & 3).astype(np.int64), 1
    while True:  # runs of 1, 2, 4, ... bases, put together as the bits of k say
        if k & size:
            out = (out << (2 * size)) | power[have : have + n]
            have += size
        if have == k:
            break
        power, size = (power[: len(power) - size] << (2 * size)) | power[size:], 2 * size
    bad = np.concatenate([[0], np.cumsum(bases > 3)])
    return out, bad[k:] == bad[:n]


def words(reads: DataFrame, k: int, step: int = 1, reverse: bool = False, sample: bool = False, starts: list[int] | None = None, most: int | None = None) -> DataFrame:
    """Words of reads (rid long, seq) at every ``step`` bases: rid, qdir, off, kmer (a code, see ``codes``), unit.

    reverse: of both strands; sample: as ``sampled``. ``starts`` are the first ids of the volumes, or batches, that the
    reads are packed in (one number for each), and unit is a read's. A task gives no more than ``most`` + 1 occurrences
    of a unit's word at once: whoever drops words that are more frequent will still see that these are. Words with a
    letter other than A, C, G, T have no code and are left out; so are null and short reads.
    """
    bounds = None if starts is None else np.array(starts, np.int64)
    names = ["rid", "qdir", "off", "kmer", "unit"]

    def of(seq: bytes):
        bases = _CODES[np.frombuffer(seq, np.uint8)]
        for strand in (0, 1) if reverse else (0,):
            code, good = codes(bases if not strand else np.where(bases < 4, 3 - bases, 4)[::-1], k)
            at = np.arange(0, len(code), step)
            at = at[good[at] & (at % (SEGMENT + SKIP) <= SEGMENT - k)] if sample else at[good[at]]
            yield strand, at, code[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def give():
            cols = [np.concatenate([h[i] for h in held]) for i in range(5)]
            if most is not None:
                order = np.lexsort((cols[3], cols[4]))
                word, unit = cols[3][order], cols[4][order]
                new = np.concatenate([[True], (word[1:] != word[:-1]) | (unit[1:] != unit[:-1])])
                first = np.flatnonzero(new)
                nth = np.arange(len(order)) - first[np.cumsum(new) - 1]
                cols = [c[order[nth <= most]] for c in cols]
            for i in range(0, len(cols[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in cols], names=names)

        for b in batches:
            for rid, seq in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for strand, at, code in of(seq.as_py().encode()):
                    unit = 0 if bounds is None else int(np.searchsorted(bounds, rid, side="right")) - 1
                    n = len(at)
                    held.append((np.full(n, rid, np.int64), np.full(n, strand, np.int32), at.astype(np.int64), code, np.full(n, unit, np.int64)))
                    size += n
                if size >= _CHUNK:
                    yield from give()
                    held, size = [], 0
        if size:
            yield from give()

    return reads.where("seq is not null").select(F.col("rid").cast("long").alias("rid"), "seq").mapInArrow(run, "rid long, qdir int, off long, kmer long, unit long")


def _lists(occ: DataFrame, most: int, fields: list[str], name: str) -> DataFrame:
    """Places of the words that occur ``most`` times at most in a unit: kmer, and an array a word and unit."""
    listed = occ.repartition("kmer").groupBy("kmer", "unit").agg(F.collect_list(F.struct(*fields)).alias(name))
    return listed.where(F.size(name) <= most).select("kmer", name)


def places(reads: DataFrame, k: int, step: int, most: int) -> DataFrame:
    """Words at every ``step`` bases that occur ``most`` times at most: kmer (its letters), places (sorted array of rid and off).

    One shuffle: a task gives on no more than ``most`` + 1 occurrences of a word at once, by which it is known to be left out.
    """
    lists = _lists(words(reads, k, step, most=most), most, ["rid", "off"], "places")
    letters = F.translate(F.lpad(F.conv(F.col("kmer").cast("string"), 10, 4), k, "0"), "0123", "ACGT")
    return lists.select(letters.alias("kmer"), F.sort_array("places").alias("places"))


def seed_join(queries: DataFrame, subjects: DataFrame, most: int = 200, self_join: bool = True) -> DataFrame:
    """Matches of k-mers: qid, qdir, qoff, sid, soff. queries: rid, qdir, off, kmer, unit; subjects: rid, off, kmer, unit.

    Units are volumes of subjects and batches of queries, of bounded size: of each batch and volume, words take no part
    that occur more than ``most`` times in the batch, or in the volume. So a task joins ``most`` squared pairs at a time,
    and what is dropped doesn't grow with the number of reads. A DataFrame without unit is one unit. self_join: each pair
    of reads once, the subject being the smaller id.

    Each side is dealt once, by word; lists and pairs are made in that partitioning.
    """
    unit = lambda d: d if "unit" in d.columns else d.withColumn("unit", F.lit(0).cast("long"))
    asked, has = _lists(unit(queries), most, ["rid", "qdir", "off"], "x"), _lists(unit(subjects), most, ["rid", "off"], "y")
    pairs = asked.join(has, "kmer").select(F.explode("x").alias("x"), "y").select("x", F.explode("y").alias("y"))
    found = pairs.select(F.col("x.rid").alias("qid"), F.col("x.qdir").alias("qdir"), F.col("x.off").alias("qoff"), F.col("y.rid").alias("sid"), F.col("y.off").alias("soff"))
    return found.where("sid < qid") if self_join else found


def pair_seeds(pairs: DataFrame, queries: DataFrame, subjects: DataFrame, most: int = 8) -> DataFrame:
    """Matches of words of given pairs of reads (qid, sid): qid, qdir, qoff, sid, soff.

    queries: rid, qdir, off, kmer; subjects: rid, off, kmer. A word takes no part in a pair if the subject has it
    more than ``most`` times, or the query more than ``most`` times on a strand, or if the product of both is over ``most``.
    Words are counted within their reads, so it doesn't matter how many other reads have them.
    """
    lists = lambda d, keys: d.groupBy(*keys).agg(F.count("*").alias("n"), F.collect_list("off").alias("at")).where(F.col("n") <= most)  # noqa: E731  within one read
    q = lists(queries, ["rid", "qdir", "kmer"]).select(F.col("rid").alias("qid"), "qdir", "kmer", F.col("n").alias("nq"), F.col("at").alias("qat"))
    s = lists(subjects, ["rid", "kmer"]).select(F.col("rid").alias("sid"), "kmer", F.col("n").alias("ns"), F.col("at").alias("sat"))
    met = pairs.select("qid", "sid").distinct().join(q, "qid").join(s, ["sid", "kmer"]).where(F.col("nq") * F.col("ns") <= most)
    return met.select("qid", "qdir", F.explode("qat").alias("qoff"), "sid", "sat").select("qid", "qdir", "qoff", "sid", F.explode("sat").alias("soff"))


def candidates(seeds: DataFrame, min_seeds: int = 3, max_hits: int = 4) -> DataFrame:
    """Pairs of a read's strand and a read with ``min_seeds`` seeds: qid, qdir, sid, seeds, first, last.

    Places of the subject that more than ``max_hits`` seeds of the strand hit are left out first.
    """
    crowded = seeds.groupBy("qid", "qdir", "sid", "soff").agg(F.count("*").alias("k")).where(F.col("k") <= max_hits)
    pairs = crowded.groupBy("qid", "qdir", "sid").agg(F.sum("k").alias("seeds"), F.min("soff").alias("first"), F.max("soff").alias("last"))
    return pairs.where(F.col("seeds") >= min_seeds)


def window(cand: DataFrame, qsize: str = "qsize", ssize: str = "ssize", margin: int = 30_000) -> DataFrame:
    """Part of the subject to align: from the hit, to either side, 1.3 times the query's size, but no more than what
    the query has on that side and ``margin``.

    A side on which the subject has no more than the query is taken to the subject's end, and a subject that isn't
    longer than the query by over 2000 is taken whole.
    """
    reach = F.floor(F.lit(1.3) * F.col(qsize))

    def side(of_query: Column, of_subject: Column) -> Column:
        return F.when(of_subject <= of_query, of_subject).otherwise(F.least(reach, of_query + margin, of_subject))

    left = side(F.col("qoff"), F.col("soff"))
    right = side(F.col(qsize) - F.col("qoff"), F.col(ssize) - F.col("soff"))
    whole = F.col(ssize) <= F.col(qsize) + 2000
    return cand.withColumn("sfrom", F.when(whole, 0).otherwise(F.col("soff") - left).cast("long")).withColumn("sto", F.when(whole, F.col(ssize)).otherwise(F.col("soff") + right).cast("long"))


def rising(seeds: DataFrame) -> DataFrame:
    """Seeds of each pair that rise in both reads: of a query place the first subject place, if beyond all before it."""
    one = seeds.groupBy("qid", "qdir", "sid", "qoff").agg(F.min("soff").alias("soff"))
    before = F.max("soff").over(Window.partitionBy("qid", "qdir", "sid").orderBy("qoff").rowsBetween(Window.unboundedPreceding, -1))
    return one.withColumn("_top", before).where(F.col("_top").isNull() | (F.col("soff") > F.col("_top"))).drop("_top")


def diagonal_runs(chain: DataFrame, length: int) -> DataFrame:
    """Neighbouring seeds of a chain on one diagonal as one run: qid, qdir, sid, qoff, soff, size, seeds."""
    w = Window.partitionBy("qid", "qdir", "sid").orderBy("qoff")
    diagonal = F.col("qoff") - F.col("soff")
    run = F.sum(F.when(diagonal == F.col("_d"), 0).otherwise(1)).over(w)
    each = chain.select("qid", "qdir", "sid", "qoff", "soff", F.lag(diagonal).over(w).alias("_d")).withColumn("run", run)
    out = each.groupBy("qid", "qdir", "sid", "run").agg(F.min("qoff").alias("qoff"), F.min("soff").alias("soff"), (F.max("qoff") - F.min("qoff") + length).alias("size"), F.count("*").alias("seeds"))
    return out.drop("run")


def exact_matches(runs: DataFrame, reads: DataFrame, least: int) -> DataFrame:
    """Stretches of ``least`` or more equal bases inside diagonal runs: qid, qdir, sid, qoff, soff, size.

    reads (rid, seq) are joined once for each side and cut to the run at once; a run of the reverse strand is cut
    from the read's other end and then reversed.
    """
    piece = lambda of, off: F.substring(F.col("seq"), (F.col(off) + 1).cast("int"), F.col("size").cast("int")).alias(of)
    d = runs.join(reads.select(F.col("rid").alias("qid"), "seq"), "qid").withColumn("_at", F.when(F.col("qdir") == 1, F.length("seq") - F.col("qoff") - F.col("size")).otherwise(F.col("qoff")))
    d = d.select("qid", "qdir", "sid", "qoff", "soff", "size", piece("_q", "_at")).withColumn("_q", F.when(F.col("qdir") == 1, reverse_complement("_q")).otherwise(F.col("_q")))
    d = d.join(reads.select(F.col("rid").alias("sid"), "seq"), "sid").select("qid", "qdir", "sid", "qoff", "soff", "_q", piece("_s", "soff"))
    same = F.array_join(F.zip_with(F.split("_q", ""), F.split("_s", ""), lambda a, b: F.when(a == b, "=").otherwise(".")), "")
    parts = F.regexp_extract_all(same, F.lit(r"(=+|\.+)"), 1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,size:int>>").alias("out"))

    def put(acc, p):
        n = F.length(p)
        keep = (F.substring(p, 1, 1) == "=") & (n >= least)
        return F.struct((acc.at + n).alias("at"), F.when(keep, F.array_append(acc.out, F.struct(acc.at.alias("at"), n.alias("size")))).otherwise(acc.out).alias("out"))

    each = d.select("qid", "qdir", "sid", "qoff", "soff", F.explode(F.aggregate(parts, start, put, lambda a: a.out)).alias("m"))
    return each.select("qid", "qdir", "sid", (F.col("qoff") + F.col("m.at")).alias("qoff"), (F.col("soff") + F.col("m.at")).alias("soff"), F.col("m.size").cast("long").alias("size"))


def trace_points(chain: DataFrame, apart: int = 100, share: float = 0.21) -> DataFrame:
    """Seeds of a chain that alignment may pass through.

    Neighbours whose steps in both reads differ by at most ``apart`` and by at most ``share`` of the subject's step
    stand together. Kept are seeds with such a neighbour, and each pair's first and last.
    """
    w = Window.partitionBy("qid", "qdir", "sid").orderBy("qoff")
    tied = _steps(chain, apart, share).withColumn("_tied", F.coalesce(F.lag("_near").over(w), F.lit(False)))
    return tied.where("_near or _tied or _back is null or _dq is null").select("qid", "qdir", "sid", "qoff", "soff")


def segments(chain: DataFrame, apart: int = 100, share: float = 0.21, longest: int = 5000) -> DataFrame:
    """Runs of two or more seeds that stand together as in ``trace_points``, with steps of at most ``longest``.

    qid, qdir, sid, segment (from 1 in each pair, gaps possible), seeds: array of qoff and soff.
    """
    w = Window.partitionBy("qid", "qdir", "sid").orderBy("qoff")
    d = _steps(chain, apart, share).withColumn("_go", F.col("_near") & (F.greatest("_dq", "_ds") <= longest))
    d = d.withColumn("_on", F.lag("_go").over(w)).withColumn("segment", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(w))
    return d.groupBy("qid", "qdir", "sid", "segment").agg(F.sort_array(F.collect_list(F.struct("qoff", "soff"))).alias("seeds")).where(F.size("seeds") > 1)


def _steps(chain: DataFrame, apart: int, share: float) -> DataFrame:
    w = Window.partitionBy("qid", "qdir", "sid").orderBy("qoff")
    dq, ds = F.lead("qoff").over(w) - F.col("qoff"), F.lead("soff").over(w) - F.col("soff")
    ahead = chain.select("qid", "qdir", "sid", "qoff", "soff", dq.alias("_dq"), ds.alias("_ds"), F.lag("qoff").over(w).alias("_back"))
    near = (F.abs(F.col("_dq") - F.col("_ds")) <= apart) & (F.abs(1.0 - F.col("_dq").cast("double") / F.col("_ds")) <= share)
    return ahead.withColumn("_near", F.coalesce(near, F.lit(False)))
