"""Reads, alignments, signatures and masks made of the given tables, in Spark and in DuckDB's SQL.

The tables hold no sequences; these deterministic views (whole numbers only) stand for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALPHABET, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LETTERS = bytes.maketrans((ALPHABET + ALPHABET.upper()).encode(), (BASES * 2).encode())
_OTHERS = bytes(b for b in range(256) if chr(b).lower() not in ALPHABET)


@F.arrow_udf(T.StringType())
def _bases(text: pa.Array) -> pa.Array:
    """Letters as bases; all bytes of other characters go."""
    return pa.array([x if x is None else x.encode().translate(_LETTERS, _OTHERS) for x in text.to_pylist()], pa.binary()).cast(pa.string())


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, name, seq: a document's letters as bases."""
    seq = _bases("text")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rid"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("name"), seq.alias("seq"))


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, len of the reads; letters are counted, not mapped."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rid"), F.length(F.regexp_replace("text", "[^A-Za-z]", "")).cast("long").alias("len"))


_ALN = """l_orderkey AS qid, CAST(l_linenumber % 2 AS INT) AS qdir, l_suppkey % 4 AS sid, 2800 + (l_orderkey * 7919) % 5000 AS qsize,
 CASE WHEN l_partkey % 3 <> 0 THEN l_partkey % 300 ELSE 301 + (l_partkey * 13) % 900 END AS qoff, (l_partkey * 101) % 60000 AS soff,
 CAST(60 + (l_partkey * 7 + l_linenumber) % 40 AS INT) AS ident, CAST(l_quantity AS BIGINT) AS q, l_partkey AS pk, l_linenumber AS ln"""
_ALN2 = """qid, qdir, sid, qsize, qoff, qsize - CASE WHEN q % 3 <> 0 THEN q * 5 ELSE 301 + (q * 37) % 900 END AS qend, soff, ident, pk, ln, q"""
_ALN3 = """qid * 1000000000 + pk * 10000 + ln * 1000 + q * 4 + sid AS aid, qid, qdir, sid, qsize, qoff, qend, soff, soff + qend - qoff AS send, 70000 AS ssize, ident"""
#: Whole DuckDB CTEs, to be put behind WITH.
ALN_SQL = f"""a1 AS (SELECT DISTINCT {_ALN} FROM lineitem), a2 AS (SELECT {_ALN2} FROM a1), a3 AS (SELECT {_ALN3} FROM a2),
aln AS (SELECT CAST(aid AS BIGINT) AS aid, CAST(qid AS BIGINT) AS qid, qdir, CAST(sid AS BIGINT) AS sid, CAST(qsize AS BIGINT) AS qsize, CAST(qoff AS BIGINT) AS qoff, CAST(qend AS BIGINT) AS qend, CAST(soff AS BIGINT) AS soff, CAST(send AS BIGINT) AS send, CAST(ssize AS BIGINT) AS ssize, ident,
 CAST(8 * (qend - qoff) - ((qend - qoff) * ident) // 100 AS BIGINT) AS score FROM a3)"""


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments: aid (unique), qid qdir sid qsize qoff qend soff send ssize ident score."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity")
    # dealt by read before anything is made of the columns: what is done by read below needs no further shuffle
    a = rows.repartition("l_orderkey").selectExpr(*_columns(_ALN)).distinct().selectExpr(*_columns(_ALN2)).selectExpr(*_columns(_ALN3))
    longs = ("aid", "qid", "sid", "qsize", "qoff", "qend", "soff", "send", "ssize")
    a = a.withColumns({c: F.col(c).cast("long") for c in longs})
    return a.withColumn("score", F.expr("8 * (qend - qoff) - ((qend - qoff) * ident) div 100").cast("long"))


def _columns(text: str) -> list[str]:
    """The columns of a select list."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[last:i])
            last = i + 1
    return [*out, text[last:]]


SIG_SQL = """sig AS (SELECT event_id AS qid, CAST(user_id % 2 AS BIGINT) AS sid, CAST(CASE WHEN event_type IN ('click', 'view') THEN 6 ELSE 0 END AS INT) AS type,
 CAST(floor((epoch(ts) - 1704067200) / 60) AS BIGINT) AS sfrom, CAST(40 + CAST(floor(value) AS BIGINT) % 60 AS BIGINT) AS len FROM events)"""


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures: qid, sid, type (6 insertion, 0 deletion), sfrom, len."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("qid"), (F.col("user_id") % 2).alias("sid"), F.when(F.col("event_type").isin("click", "view"), 6).otherwise(0).alias("type"),
        F.expr("timestampdiff(MINUTE, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("long").alias("sfrom"), (40 + F.floor("value") % 60).cast("long").alias("len"),
    )


_MASK = "o_custkey % 4 AS sid, (o_orderkey * 97) % 60000 AS {0}, (o_orderkey * 97) % 60000 + 1 + o_custkey % 400 AS {1}"
MASK_SQL = f"mask AS (SELECT CAST(s AS BIGINT) AS sid, CAST(f AS BIGINT) AS f, CAST(t AS BIGINT) AS t FROM (SELECT {_MASK.format('f', 't').replace('AS sid', 'AS s')} FROM orders))"


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked intervals: sid, from, to."""
    return table(spark, sf_dir, "orders").selectExpr(*_columns(_MASK.format("`from`", "`to`")))


#: Of the mask, the intervals longer than this; all of them together cover every subject.
LONG = 390


READS_SQL = f"""reads AS (SELECT doc_id AS rid, 'r' || CAST(doc_id AS VARCHAR) AS name, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{ALPHABET}', '{BASES}') AS seq FROM documents)"""


#: Bases of the pieces that neighbouring reads are compared in.
PIECE = 120


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring reads side by side, in pieces of PIECE bases that cover both, padded with gaps: pid, q_aln, s_aln.

    pid is the first read times 10,000 and the piece. Every fifth pair has a gap of 45 in the query, every seventh one
    of 50 in the subject.
    """
    r = reads(spark, sf_dir).select("rid", "seq").where("seq is not null")
    other = r.select((F.col("rid") - 1).alias("rid"), F.col("seq").alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, q, s, n = [], [], [], 0
            for row, (rid, x, y) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True), 1):
                k = -(-max(len(x), len(y)) // PIECE)
                ids.append(rid * 10_000 + np.arange(k))
                q.append(x.ljust(k * PIECE, "-"))
                s.append(y.ljust(k * PIECE, "-"))
                n += k
                if n and (n >= 1 << 12 or row == b.num_rows):
                    yield pieces(np.concatenate(ids), "".join(q), "".join(s))
                    ids, q, s, n = [], [], [], 0

    def pieces(pid: np.ndarray, *texts: str) -> pa.RecordBatch:
        out = [np.frombuffer(bytearray(x.encode()), np.uint8).reshape(-1, PIECE) for x in texts]
        out[0][pid % 5 == 0, 40:85] = ord("-")
        out[1][pid % 7 == 3, 40:90] = ord("-")
        ends = pa.py_buffer(np.arange(0, (len(pid) + 1) * PIECE, PIECE, dtype=np.int32))
        return pa.RecordBatch.from_arrays([pa.array(pid), *(pa.StringArray.from_buffers(len(pid), ends, pa.py_buffer(x)) for x in out)], names=["pid", "q_aln", "s_aln"])

    return r.join(other, "rid").select(F.col("rid").cast("long").alias("rid"), "seq", "other").mapInArrow(run, "pid long, q_aln string, s_aln string")


PAIRS_SQL = f"""{READS_SQL}, pieces AS (SELECT x.rid * 10000 + k AS pid, rpad(substr(x.seq, {PIECE} * k + 1, {PIECE}), {PIECE}, '-') AS b, rpad(substr(y.seq, {PIECE} * k + 1, {PIECE}), {PIECE}, '-') AS c
 FROM reads x JOIN reads y ON y.rid = x.rid + 1, unnest(range(0, CAST(ceil(greatest(length(x.seq), length(y.seq)) / {PIECE}.0) AS BIGINT))) AS t(k)),
pairs AS (SELECT pid, CASE WHEN pid % 5 = 0 THEN substr(b, 1, 40) || repeat('-', 45) || substr(b, 86) ELSE b END AS q_aln,
 CASE WHEN pid % 7 = 3 THEN substr(c, 1, 40) || repeat('-', 50) || substr(c, 91) ELSE c END AS s_aln FROM pieces)"""


_OVERLAP = "aid, qid, qdir, sid % 2 AS sid, qsize, aid % 3 * 60 AS qoff, qsize - aid % 7 * 25 AS qend, aid % 4 * 40 AS soff, 1500 + aid % 11 * 9 AS send, 1500 + aid % 11 * 9 + aid % 5 * 40 AS ssize, ident, score"
#: A further CTE behind ALN_SQL.
OVERLAP_SQL = f"ovl AS (SELECT {_OVERLAP} FROM aln)"


def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignments moved to the ends of query and subject, so that some reach them and others don't."""
    return alignments(spark, sf_dir).selectExpr(*_columns(_OVERLAP))


_BROKEN = """aid, qid, qdir, sid % 2 AS sid, qsize + 2000 AS qsize, CASE WHEN aid % 7 = 0 THEN 0 WHEN aid % 8 < 4 THEN aid % 3 * 40 ELSE 450 END AS qoff, qsize + 2000 - CASE WHEN aid % 7 = 0 THEN aid % 3 * 200 WHEN aid % 8 < 4 THEN 500 ELSE aid % 3 * 40 END AS qend,
 CASE WHEN aid % 8 < 4 THEN aid % 5 * 20 ELSE 900 END AS soff, CASE WHEN aid % 8 < 4 THEN 1700 ELSE 2500 - aid % 5 * 20 END AS send, 2500 AS ssize, ident, score"""
BROKEN_SQL = f"ovl AS (SELECT {_BROKEN} FROM aln)"


def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignments as halves of overlaps that reach one end of query or subject each, and a few whole ones."""
    return alignments(spark, sf_dir).selectExpr(*_columns(_BROKEN))


#: Places of variants, and the bases of every subject, in a cycle.
LOCUS, CYCLE = 6000, "ACGTTGCA"


def variants(rows: DataFrame) -> DataFrame:
    """Alignments (aid, sid, soff, send) as aligned strings: adds q_aln and s_aln.

    Of alignments that span a locus, the query lacks some 40 to 70 bases there, or has as many more, like all others at
    this locus of the subject; places and lengths differ by a few. Else both strings are the subject's bases.
    """
    locus = (F.floor(F.col("soff") / LOCUS) + 1) * LOCUS
    d = rows.withColumns({"_n": (40 + (locus / LOCUS * 7 + F.col("sid")) % 28 + F.col("aid") % 3).cast("int"), "_at": (locus + F.col("aid") % 4 - F.col("soff")).cast("int"), "_more": (locus / LOCUS).cast("int") % 2 == 1})
    d = d.withColumn("_s", F.substring(F.repeat(F.lit(CYCLE), F.lit(10_000)), (F.col("soff") % len(CYCLE) + 1).cast("int"), (F.col("send") - F.col("soff")).cast("int")))
    has = F.col("_at") + F.col("_n") + 10 < F.length("_s")
    put = lambda middle, skip: F.concat(F.substring(F.col("_s"), F.lit(1), F.col("_at")), middle, F.substring(F.col("_s"), F.col("_at") + skip + 1, F.length("_s")))
    gap, bases = F.repeat(F.lit("-"), F.col("_n")), F.substring(F.lit(CYCLE * 10), F.lit(1), F.col("_n"))
    q = F.when(~has, F.col("_s")).when(F.col("_more"), put(bases, F.lit(0))).otherwise(put(gap, F.col("_n")))
    s = F.when(has & F.col("_more"), put(gap, F.lit(0))).otherwise(F.col("_s"))
    return d.withColumns({"q_aln": q, "s_aln": s}).drop("_n", "_at", "_more", "_s", "_has")


def variants_sql(rows: str) -> str:
    """CTEs: vq (aid, qid, sid, qdir, soff, q_aln, s_aln) of the CTE ``rows``."""
    return f"""v0 AS (SELECT *, CAST(floor(soff / {LOCUS}) + 1 AS BIGINT) AS k FROM {rows}), v1 AS (SELECT *, 40 + (k * 7 + sid) % 28 + aid % 3 AS n, k * {LOCUS} + aid % 4 - soff AS pl, substr(repeat('{CYCLE}', 10000), soff % 8 + 1, send - soff) AS s FROM v0),
vq AS (SELECT aid, qid, sid, qdir, soff, CASE WHEN pl + n + 10 >= length(s) THEN s WHEN k % 2 = 1 THEN substr(s, 1, pl) || substr(repeat('{CYCLE}', 10), 1, n) || substr(s, pl + 1) ELSE substr(s, 1, pl) || repeat('-', n) || substr(s, pl + n + 1) END AS q_aln,
 CASE WHEN pl + n + 10 < length(s) AND k % 2 = 1 THEN substr(s, 1, pl) || repeat('-', n) || substr(s, pl + 1) ELSE s END AS s_aln FROM v1)"""


_SELF = "aid, qid, qdir, sid, qsize, aid % 5 * 140 AS qoff, qsize - aid % 7 * 130 AS qend, 4000 AS ssize, aid % 11 * 150 AS soff, 3900 - aid % 13 * 170 AS send, ident"
#: A further CTE behind ALN_SQL.
SELF_SQL = f"slf AS (SELECT {_SELF} FROM aln)"


def partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignments moved so that some reach no end of query or subject, some one, some both."""
    return alignments(spark, sf_dir).selectExpr(*_columns(_SELF))
