"""Significance of local alignment scores: the parameters of their extreme value distribution, and E-values as columns.

The parameters follow from the chance of each score of a pair of letters (Karlin and Altschul, 1990). A distribution has
as many entries as there are scores, so they are found once, before the plan; everything per alignment is an expression.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = (0.25, 0.25, 0.25, 0.25)


class Parameters(NamedTuple):
    """scale (lambda) and k of the distribution, entropy (H) in nats a pair."""

    scale: float
    k: float
    entropy: float


def match_scores(match: int = 1, mismatch: int = -2, bases: tuple[float, ...] = BASES) -> dict[int, float]:
    """The chance of either score of a pair of random bases."""
    same = sum(p * p for p in bases)
    return {match: same, mismatch: 1 - same}


def parameters(chances: dict[int, float]) -> Parameters:
    """Of the chance of each score. Some score must be over 0, and the mean under 0; else ValueError."""
    s = np.array(sorted(x for x in chances if chances[x] > 0), np.int64)
    p = np.array([chances[x] for x in s.tolist()]) / sum(chances.values())
    if not len(s) or s[-1] <= 0 or s @ p >= 0:
        raise ValueError("scores need a negative mean and a positive one among them")
    step = math.gcd(*s.tolist())
    s //= step
    low, high = 0.0, 1.0
    while p @ np.exp(high * s) < 1:
        high *= 2
    for _ in range(200):  # the sum falls below 1 behind 0 and rises through 1 once
        mid = (low + high) / 2
        low, high = (mid, high) if p @ np.exp(mid * s) < 1 else (low, mid)
    rate = (low + high) / 2
    mean = s * p @ np.exp(rate * s)
    one = np.zeros(int(s[-1] - s[0]) + 1)
    one[s - s[0]] = p
    of, total, term, j = np.ones(1), 0.0, 1.0, 0
    while term > 1e-13:  # sums of j scores: their chances by one more convolution each
        j += 1
        of = np.convolve(of, one)
        at = np.arange(len(of)) + j * int(s[0])
        term = float(of @ np.exp(rate * np.minimum(at, 0))) / j
        total += term
    return Parameters(rate / step, math.exp(-2 * total) / (mean * -math.expm1(-rate)), rate * mean)


def length_adjustment(par: Parameters, m: Column, n: Column, count: Column) -> Column:
    """The greatest whole length not over ln(k (m - l) (n - count l)) / entropy: what an alignment can't start in.

    m: letters of the query, n and count: letters and number of the subjects. Found by bisection; 0 where none fits.
    """
    m, n, count = (c.cast("double") for c in (m, n, count))
    fits = lambda x: (x < m) & (count * x < n) & (x * par.entropy <= math.log(par.k) + F.log((m - x) * (n - count * x)))
    halves = F.sequence(F.lit(40), F.lit(0), F.lit(-1))
    return F.aggregate(halves, F.lit(0.0), lambda x, i: F.when(fits(x + F.pow(F.lit(2.0), i)), x + F.pow(F.lit(2.0), i)).otherwise(x)).cast("long")


def with_significance(rows: DataFrame, par: Parameters, score: str = "score", query_size: str = "qsize", subject_id: str = "sid", subject_size: str = "ssize") -> DataFrame:
    """Adds bits, length_adjustment, log10_e (of the E-value) and log10_p (of one such score or more by chance).

    The subjects are those of the rows, each with its greatest size; their sum is one row, joined to all. Null scores
    and sizes give nulls. E-values of long alignments are below any double, so logarithms are returned.
    """
    all_ = rows.groupBy(subject_id).agg(F.max(subject_size).alias("_n")).agg(F.sum("_n").alias("_n"), F.count("_n").alias("_count"))
    d = rows.crossJoin(F.broadcast(all_))  # one row
    m, n, s = F.col(query_size), F.col("_n"), F.col(score).cast("double")
    d = d.withColumn("length_adjustment", length_adjustment(par, m, n, F.col("_count")))
    room = F.log((m - F.col("length_adjustment")).cast("double")) + F.log((n - F.col("_count") * F.col("length_adjustment")).cast("double"))
    ln_e = F.lit(math.log(par.k)) + room - s * par.scale
    e = F.exp(ln_e)
    ln_p = F.when(ln_e < -20, ln_e).otherwise(F.log(-F.expm1(-e)))  # 1 - exp(-e) is e where that is small
    return d.withColumns({"bits": (s * par.scale - math.log(par.k)) / math.log(2), "log10_e": ln_e / math.log(10), "log10_p": ln_p / math.log(10)}).drop("_n", "_count")
