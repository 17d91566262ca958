"""Language identification by mixture inference.

Each language is a distribution over hashed byte trigrams, counted over all training texts. A document is taken as a
mixture of languages: expectation-maximisation estimates the proportions from its trigrams' likelihoods, and the
set of languages is chosen by penalised likelihood, a language being added only if it explains more than it costs.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import partitions

BINS = 1 << 16
#: ASCII bytes that aren't letters become spaces.
WORDS = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
#: How far from its maximum a log-likelihood may stay, in nats.
SLACK = 0.05


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased words, each word between spaces."""
    x = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(WORDS).split()) + b" ", np.uint8).astype(np.uint32)
    return (((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)


def _count(batches):
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if lang not in total:
                total[lang] = np.zeros(BINS, np.int64)
            g = trigrams(t)
            if len(g) > 4096:
                total[lang] += np.bincount(g, minlength=BINS)
            else:
                np.add.at(total[lang], g, 1)
    lot = TaskContext.get().partitionId() % 64
    for lang, x in total.items():
        yield _row(lang, lot, x)


def _row(lang: str, lot: int, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"lang": [lang], "lot": [lot], "bins": [x.tobytes()]}, schema=pa.schema([("lang", pa.string()), ("lot", pa.int32()), ("bins", pa.binary())]))


def _add(batches):
    total: dict = {}
    for b in batches:
        for lang, lot, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            x = np.frombuffer(x, np.int64)
            total[lang, lot] = total[lang, lot] + x if (lang, lot) in total else x
    for (lang, lot), x in total.items():
        yield _row(lang, lot, x)


class Languages:
    """Trigram distributions of the learned languages."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.names = sorted(counts)
        c = np.array([counts[k] for k in self.names], np.float64).reshape(len(self.names), BINS) + 0.5
        self.p = np.ascontiguousarray((c / c.sum(axis=1, keepdims=True)).T)  # [bins, languages]

    def mixture(self, text: str | None, penalty: float) -> list[tuple[str, float]]:
        """Languages and proportions, the largest first; empty if there is no letter or no learned language.

        The set grows from the best single language, by the one that raises the penalised likelihood most, as long
        as one does. Adding languages raises a log-likelihood by at most total * log(largest gradient) (Jensen), so
        those that can't pay for themselves need no EM.
        """
        if not self.names or not text or not LETTER.search(text):
            return []
        f, n = np.unique(trigrams(text), return_counts=True)
        p, total = self.p[f], int(n.sum())
        cost = penalty * np.log(1 + total)
        chosen, w = [int(np.argmax(n @ np.log(p)))], np.ones(1)
        while True:
            now = p[:, chosen] @ w
            gradient = p.T @ (n / now) / total
            rest = [k for k in range(len(self.names)) if k not in chosen and total * np.log(max(gradient[k], 1e-300)) > cost]
            best, at = cost, None
            for k in rest:
                new, gain = self._gain(p[:, [*chosen, k]], n, total, w, now)
                if gain > best:
                    best, at = gain, (k, new)
            if at is None:
                break
            chosen, w = [*chosen, at[0]], at[1]
        return sorted(((self.names[k], float(x)) for k, x in zip(chosen, w, strict=True)), key=lambda x: (-x[1], x[0]))

    def _gain(self, p: np.ndarray, n: np.ndarray, total: int, w: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions of a larger set, and how much they raise the log-likelihood."""
        new = em(p, n, total, np.append(w * len(w), 1) / (len(w) + 1))
        return new, float(n @ np.log((p @ new) / now))


def em(p: np.ndarray, n: np.ndarray, total: int, w: np.ndarray, steps: list | None = None) -> np.ndarray:
    """Mixture proportions by expectation-maximisation, until the log-likelihood is within SLACK of its maximum.

    The likelihood is concave, and total * log(largest gradient) bounds what is missing. Between languages that differ
    little, plain steps are short; so from the third on, each is followed by a Newton step on the simplex, which is
    taken as far as it raises the likelihood. ``steps`` gets one item a step.
    """
    for step in itertools.count():
        gradient = p.T @ (n / (p @ w)) / total
        if total * np.log(gradient.max()) < SLACK:
            return w
        if steps is not None:
            steps.append(step)
        w = w * gradient
        w = _newton(p, n, total, w / w.sum()) if step > 1 else w


def _newton(p: np.ndarray, n: np.ndarray, total: int, w: np.ndarray) -> np.ndarray:
    """One Newton step of the log-likelihood over proportions, taken as far as it raises the likelihood.

    The step ends at the best point of the quadratic model among all points without a negative proportion, so neither
    a proportion near zero nor one at zero can hold it up. The proportions' sum is in the model as a cost and needs no constraint.
    """
    now = p @ w
    q = p / now[:, None]
    gradient, bend = q.T @ n / total, (q * (n / total)[:, None]).T @ q
    bend[np.diag_indices(len(w))] += 1e-12 * np.trace(bend)  # equal languages
    d = _model_maximum(bend, bend @ w + gradient - 1, w) - w
    value = lambda x: float(n @ np.log(np.maximum(p @ x, 1e-300)) - total * x.sum())
    have, slope = value(w), total * float((gradient - 1) @ d)
    size = 1.0
    while slope > 0 and size > 1e-12:
        new = w + size * d
        if value(new) > have + 1e-4 * size * slope:
            return new / new.sum()
        size /= 2
    return w


def _model_maximum(bend: np.ndarray, rise: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The x >= 0 of the greatest rise @ x - x @ bend @ x / 2, by active sets (Lawson and Hanson), from a given one."""
    free = x > 0
    for _ in range(10 * len(x)):
        inner = np.zeros(len(x))
        inner[free] = np.linalg.solve(bend[np.ix_(free, free)], rise[free])
        low = free & (inner <= 0)
        if low.any():
            share = np.where(low, x / np.where(low, x - inner, 1), np.inf)
            x = np.where(free, np.maximum(0, x + share.min() * (inner - x)), 0)
            free[int(np.argmin(share))] = False
            x[~free] = 0
            continue
        x = inner
        more = np.where(free, -np.inf, rise - bend @ x)
        if more.max() <= 1e-13 * np.abs(rise).max():
            break
        free[int(np.argmax(more))] = True
    return x


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Count trigrams by language over all rows with a text and a language; 512 KB a language reach the driver."""
    kinds, spark = "lang string, lot int, bins binary", docs.sparkSession
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    parts = rows.mapInArrow(_count, kinds).repartition(partitions(spark), "lang", "lot").mapInArrow(_add, kinds)
    whole = parts.withColumn("lot", F.lit(0)).repartition(min(8, partitions(spark)), "lang").mapInArrow(_add, kinds)
    return Languages({r.lang: np.frombuffer(r.bins, np.int64) for r in whole.collect()})


def identify(docs: DataFrame, languages: Languages, penalty: float = 8.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Infer the language mixture of every whole text.

    Returns doc_id, lang_pred (the language of the largest proportion; ``und`` if the text is null or has no letter,
    or nothing was learned), score (its proportion, 0 for ``und``) and languages (all chosen, with proportions). Ties
    go to the first name. Repeated rows are returned each, null ids as they are. Other columns are not read.
    One pass without a shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(languages)  # 512 KB a language

    def run(batches):
        m = model.value
        kinds = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))])
        for b in batches:
            found = [m.mixture(t, penalty) for t in b.column(1).to_pylist()]
            out = pa.RecordBatch.from_pydict({"lang_pred": [f[0][0] if f else UNKNOWN for f in found], "score": [min(1.0, f[0][1]) if f else 0.0 for f in found], "languages": [[{"lang": k, "share": v} for k, v in f] for f in found]}, schema=kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *out.columns], names=["doc_id", *kinds.names])

    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = made.schema["id"].dataType.simpleString()
    return made.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, languages array<struct<lang:string,share:double>>")
