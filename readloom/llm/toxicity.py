"""Toxicity: a logistic classifier of word presence, regularised by counterfactuals.

In labelled sentences that name a group, the group's name is swapped for others of its kind, and the change of the
score between the sentence and its counterfactual is penalised. So the weights of group names stay near each other,
and a neutral mention of a group does not raise the score.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import discard, save
from readloom.llm.hashing import LETTERS, WordHashes
from readloom.llm.linear import Sparse, bounded_sample, fit, sigmoid

BINS = 1 << 18
#: Group names that may stand for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("immigrant", "foreigner", "refugee", "native"),
    ("immigrants", "foreigners", "refugees", "natives"),
    ("old", "young", "elderly", "disabled", "blind", "deaf"),
)
SENTENCE = re.compile(r"(?<=[.!?\n])\s+")


def words(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode("utf-8", "replace").translate(LETTERS).split())


def counterfactuals(text: str, terms=IDENTITY_TERMS) -> list[tuple[bytes, bytes]]:
    """The distinct swaps of a text: for each sentence that names a group, the name and each other one of its kind.

    There are no more than pairs of names of one kind, however long the text.
    """
    out: set[tuple[bytes, bytes]] = set()
    for sentence in SENTENCE.split(text):
        w = words(sentence)
        for kind in terms:
            names = {k.encode() for k in kind}
            out.update((name, other) for name in w & names for other in names - w)
    return sorted(out)


class Scorer(dict):
    """Weights of words, a bounded number of them remembered."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.hashes = weights, bias, WordHashes()

    def __missing__(self, word: bytes) -> float:
        w = float(self.weights[self.hashes[word] & (BINS - 1)])
        if len(self) < 300_000:
            self[word] = w
        return w

    def score(self, text: str | None) -> float:
        return float(sigmoid(self.bias + sum(map(self.__getitem__, words(text)))))


def _features(terms):
    def run(batches):
        known = WordHashes()
        number = lambda w: known[w] & (BINS - 1)
        kinds = pa.schema([("id", pa.int64()), ("y", pa.float64()), ("x", pa.list_(pa.int32())), ("gone", pa.list_(pa.int32())), ("come", pa.list_(pa.int32()))])
        for b in batches:
            out: dict = {"id": b.column(2).to_pylist(), "y": b.column(1).cast(pa.float64()).to_pylist(), "x": [], "gone": [], "come": []}
            for t in b.column(0).to_pylist():
                out["x"].append(sorted({number(w) for w in words(t)}))
                swaps = counterfactuals(t or "", terms)
                out["gone"].append([number(a) for a, _ in swaps])
                out["come"].append([number(c) for _, c in swaps])
            yield pa.RecordBatch.from_pydict(out, schema=kinds)

    return run


def train(docs: DataFrame, labels: DataFrame, max_train: int = 16_000, terms=IDENTITY_TERMS, penalty: float = 10.0, least: int = 8, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """Fit on a sample of about ``max_train`` labelled rows at most, chosen by a hash of the id.

    Rows with a null id, label or text take no part. Words in fewer than ``least`` texts of the sample get no weight.
    ``penalty`` weighs the mean square change of the score under swaps, which are all distinct swaps of the sample's
    texts. Repeated rows count each; a repeated label counts once, and an id with both labels as one row of each.
    """
    chosen = bounded_sample(labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null"), max_train, F.col("id")).distinct()
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # max_train rows
    sample = save(rows.select("text", "y", F.xxhash64("id")).mapInArrow(_features(terms), "id long, y double, x array<int>, gone array<int>, come array<int>"), "toxic-sample")
    got = sample.toPandas().sort_values(["id", "y"], kind="stable")
    discard(sample)
    joined = lambda c: np.concatenate([np.empty(0, np.int32), *got[c]])
    change = Sparse.differences(joined("gone"), joined("come"), BINS)
    x = Sparse(got["x"].tolist(), BINS).frequent(least)
    w, bias = fit(x, got["y"].to_numpy(np.float64), difference=change, penalty=penalty, l2=0.3, steps=250)
    return Scorer(w, bias)


def score_documents(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: doc_id, score (0 to 1), predicted (1 from 0.5 on).

    Null and empty texts get the score of a text without words. Repeated rows are returned each, null ids as they
    are. Without labels every score is 0.5. Other columns are not read. One pass without a shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast((scorer.weights, scorer.bias))  # 2**18 numbers, always

    def run(batches):
        s = Scorer(*model.value)
        for b in batches:
            got = np.array([s.score(t) for t in b.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = made.schema["id"].dataType.simpleString()
    return made.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
