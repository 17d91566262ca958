"""Measures of gapped alignments, as column expressions over (q_aln, s_aln).

Both strings have one length; '-' is a gap. The alignment is first written as a string of operations, = match,
X mismatch, I query base without subject base, D subject base without query base: numpy compares the bytes of all
alignments of an Arrow batch at once, as the JVM could only take strings apart into arrays of letters. Runs are found by
regular expressions, in the JVM.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the scoring: reward of a column, penalty subtracted for a match, gap runs left out of the identity.
REWARD, LONG_GAP = 8, 20


#: Bytes of one side's strings that are compared at once.
AT_ONCE = 1 << 20


@F.pandas_udf(T.StringType())
def _operations(q: pd.Series, s: pd.Series) -> pd.Series:
    """The alignments of a batch, many short ones or few long ones at once, as bytes."""
    out: list = [None] * len(q)
    some, size = [], 0
    for i in np.flatnonzero((q.notna() & s.notna()).to_numpy()).tolist():
        some.append(i)
        size += len(q.iat[i])
        if size >= AT_ONCE:
            _compare(q, s, some, out)
            some, size = [], 0
    _compare(q, s, some, out)
    return pd.Series(out, dtype=object)


def _compare(q: pd.Series, s: pd.Series, some: list[int], out: list) -> None:
    pairs = [(q.iat[i].encode(), s.iat[i].encode()) for i in some]
    sizes = np.array([max(len(a), len(b)) for a, b in pairs], np.int64)
    x, y = (np.frombuffer(b"".join(p[k].ljust(n, b"?") for p, n in zip(pairs, sizes.tolist(), strict=True)), np.uint8) for k in (0, 1))
    gap, other = x == ord("-"), y == ord("-")
    ops = np.where(gap, np.uint8(ord("D")), np.where(other, np.uint8(ord("I")), np.where(x == y, np.uint8(ord("=")), np.uint8(ord("X")))))
    keep = ~(gap & other)
    ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(sizes)])]
    text = ops[keep].tobytes().decode()
    for i, a, b in zip(some, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        out[i] = text[a:b]


def operations(q: str | Column, s: str | Column) -> Column:
    """One letter a column; columns where both have gaps are left out."""
    return _operations(q, s)


def runs(ops: Column, letters: str, least: int = 1) -> Column:
    return F.regexp_extract_all(ops, F.lit(f"([{letters}]{{{least},}})"), 1)


def total(parts: Column) -> Column:
    return F.coalesce(F.aggregate(F.transform(parts, F.length), F.lit(0), lambda a, x: a + x), F.lit(0))


def matches(ops: Column) -> Column:
    return F.length(F.regexp_replace(ops, "[^=]", ""))


def identity(q: str, s: str) -> Column:
    """Percentage of matching columns."""
    return 100.0 * matches(operations(q, s)) / F.length(q)


def distance(q: str, s: str) -> Column:
    return F.length(q) - matches(operations(q, s))


def column_score(q: str, s: str) -> Column:
    """The reward goes to every column, less one for each match."""
    return REWARD * F.length(q) - matches(operations(q, s))


def effective_identity(q: str, s: str) -> Column:
    """Percentage of matching columns, gap runs of LONG_GAP or more being left out."""
    ops = operations(q, s)
    left_out = total(F.regexp_extract_all(ops, F.lit(f"(I{{{LONG_GAP},}}|D{{{LONG_GAP},}})"), 1))
    n = F.length(ops) - left_out
    return F.when(n > 0, 100.0 * matches(ops) / n).otherwise(0.0)


def cigar(q: str, s: str, extended: bool = False) -> Column:
    """Run lengths of M (or =, X), I and D."""
    ops = operations(q, s)
    ops = ops if extended else F.translate(ops, "=X", "MM")
    return F.array_join(F.transform(F.regexp_extract_all(ops, F.lit("(=+|X+|M+|I+|D+)"), 1), lambda r: F.concat(F.length(r).cast("string"), F.substring(r, 1, 1))), "")


def letters(texts: list[str], sizes: np.ndarray) -> np.ndarray:
    """The letters of all texts behind each other, each text filled up to its size with zeros: bytes, or code points if any isn't ASCII."""
    text = "".join(x.ljust(n, "\0") for x, n in zip(texts, sizes.tolist(), strict=True))
    return np.frombuffer(bytearray(text.encode()), np.uint8) if text.isascii() else np.frombuffer(bytearray(text.encode("utf-32-le")), np.uint32)


def texts(flat: np.ndarray, ends: np.ndarray) -> list[str]:
    """The texts that end at ``ends`` of such letters."""
    text = flat.tobytes().decode("ascii" if flat.dtype == np.uint8 else "utf-32-le")
    return [text[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _each_lot(q: pd.Series, s: pd.Series):
    """Rows of a batch without nulls, many short ones or few long ones at once: their numbers and strings."""
    some, size = [], 0
    for i in np.flatnonzero((q.notna() & s.notna()).to_numpy()).tolist():
        some.append(i)
        size += max(len(q.iat[i]), len(s.iat[i]))
        if size >= AT_ONCE:
            yield some, [q.iat[j] for j in some], [s.iat[j] for j in some]
            some, size = [], 0
    if some:
        yield some, [q.iat[j] for j in some], [s.iat[j] for j in some]


@F.pandas_udf(T.StringType())
def _md(q: pd.Series, s: pd.Series) -> pd.Series:
    out: list = [None] * len(q)
    for some, xs, ys in _each_lot(q, s):
        for i, text in zip(some, mds(xs, ys), strict=True):
            out[i] = text
    return pd.Series(out, dtype=object)


def mds(qs: list[str], ss: list[str]) -> list[str]:
    """MD strings of alignments, all columns of all of them at once.

    Behind an alignment's last column stands an end. Each mismatch, run of deleted bases and end is a token: the number of
    matches since the one before, ^ for a run, the subject's base unless it is an end; further bases of a run have no number.
    """
    sizes = np.array([max(len(x), len(y)) + 1 for x, y in zip(qs, ss, strict=True)], np.int64)
    x, y = letters(qs, sizes), letters(ss, sizes)
    end = np.zeros(len(x), bool)
    end[np.cumsum(sizes) - 1] = True
    keep = np.flatnonzero(end | ((y != ord("-")) & (y != 0)))
    x, y, end = x[keep], y[keep], end[keep]
    same, gone = (x == y) & ~end, (x == ord("-")) & ~end
    later = gone & np.concatenate([[False], gone[:-1]])
    at = np.flatnonzero(~same)
    y, end, start, mark = y[at], end[at], ~later[at], (gone & ~later)[at]
    n = np.diff(np.cumsum(same)[at], prepend=0)
    digits = start.astype(np.int64)
    power = 10
    while len(n) and power <= n.max():
        digits += start & (n >= power)
        power *= 10
    ends = np.cumsum(digits + mark + ~end)
    first = ends - (digits + mark + ~end)
    out = np.zeros(ends[-1] if len(ends) else 0, y.dtype)
    for i in range(int(digits.max(initial=0))):
        has = digits > i
        out[(first + digits)[has] - 1 - i] = ord("0") + n[has] // 10**i % 10
    out[(first + digits)[mark]] = ord("^")
    out[ends[~end] - 1] = y[~end]
    return texts(out, ends[end])


def md(q: str, s: str) -> Column:
    """The MD string: match counts, the subject's bases at mismatches, ^ and its bases in deletions."""
    return _md(q, s)


def anchored(q: str, s: str, anchor: int = 8) -> tuple[Column, Column]:
    """First and end column between the first and the last run of ``anchor`` matches; 0, 0 without one."""
    ops = F.array_join(F.zip_with(F.split(q, ""), F.split(s, ""), lambda a, b: F.when(a == b, "=").otherwise(".")), "")
    first, last = F.instr(ops, "=" * anchor), F.instr(F.reverse(ops), "=" * anchor)
    return F.when(first > 0, first - 1).otherwise(0), F.when(first > 0, F.length(ops) - last + 1).otherwise(0)


@F.pandas_udf(T.StructType([T.StructField("q_aln", T.StringType()), T.StructField("s_aln", T.StringType())]))
def _split(q: pd.Series, s: pd.Series) -> pd.DataFrame:
    out: list = [(None, None)] * len(q)
    for some, xs, ys in _each_lot(q, s):
        for i, pair in zip(some, splits(xs, ys), strict=True):
            out[i] = pair
    return pd.DataFrame(out, columns=["q_aln", "s_aln"], dtype=object)


def splits(qs: list[str], ss: list[str]) -> list[tuple[str, str]]:
    """Alignments with their mismatches split, all columns of all of them at once."""
    sizes = np.array([max(len(x), len(y)) for x, y in zip(qs, ss, strict=True)], np.int64)
    x, y = letters(qs, sizes), letters(ss, sizes)
    other = (x != y) & (x != ord("-")) & (y != ord("-")) & (x != 0) & (y != 0)
    ends, first, made = np.cumsum(1 + other), np.cumsum(sizes), []
    for side, late in ((x, 0), (y, 1)):
        flat = np.repeat(side, 1 + other)
        flat[ends[other] - 2 + late] = ord("-")
        keep = flat != 0
        upto = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])[first]]
        made.append(texts(flat[keep], upto))
    return list(zip(*made, strict=True))


def split_mismatches(q: str, s: str) -> tuple[Column, Column]:
    """Both strings with each mismatch as two columns: the subject's base against a gap, then the query's."""
    both = _split(q, s)
    return both["q_aln"], both["s_aln"]


def gap_runs(q: str, s: str, qoff: Column, soff: Column, least: int = 40) -> Column:
    """Array of the alignment's gap runs of ``least`` or more: type, qfrom, qto, sfrom, sto.

    A run without query bases is a deletion (sfrom to sto spans it, qto = qfrom + 1); one without subject bases an
    insertion (qfrom to qto spans it, sto = sfrom + 1).
    """
    parts = F.regexp_extract_all(F.translate(operations(q, s), "=X", "MM"), F.lit("(M+|I+|D+)"), 1)

    def put(acc, p):
        n, kind = F.length(p).cast("long"), F.substring(p, 1, 1)
        q_to, s_to = acc.q + F.when(kind == "D", 0).otherwise(n), acc.s + F.when(kind == "I", 0).otherwise(n)
        gap = F.struct(kind.alias("kind"), acc.q.alias("qfrom"), F.when(kind == "D", acc.q + 1).otherwise(q_to).alias("qto"), acc.s.alias("sfrom"), F.when(kind == "I", acc.s + 1).otherwise(s_to).alias("sto"))
        more = F.when((kind != "M") & (n >= least), F.array_append(acc.out, gap)).otherwise(acc.out)
        return F.struct(q_to.alias("q"), s_to.alias("s"), more.alias("out"))

    start = F.struct(qoff.cast("long").alias("q"), soff.cast("long").alias("s"), F.array().cast("array<struct<kind:string,qfrom:bigint,qto:bigint,sfrom:bigint,sto:bigint>>").alias("out"))
    return F.aggregate(parts, start, put, lambda a: a.out)
