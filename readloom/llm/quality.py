"""Quality: co-training of a text-content and a page-metadata classifier.

The content view is the words of a text and their shapes. The metadata view is what is known of a page without
reading it: source, language, length, and its layout (lines, capitals, signs, share of distinct words), in steps.
Texts are read once, to a table of feature numbers. Over some rounds each view, trained on its labelled rows, scores
all unlabelled documents and gives the other the most confident ones as pseudo-labels. Both views are then calibrated
on labelled rows kept aside, and combined to one score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import discard, save
from readloom.llm.hashing import WordHashes
from readloom.llm.linear import Sparse, bounded_sample, calibrate, fit, sigmoid

CONTENT_BINS, META_BINS = 1 << 17, 1 << 12
#: Shape of a word's bytes: a lower-case or non-ASCII letter, A capital, 0 digit, other signs as they are.
SHAPE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


def _shape(word: bytes) -> bytes:
    s = word.translate(SHAPE)
    return s[:1] + s[-3:] + (b"+" if len(s) > 12 else b"")


class Views:
    """Feature numbers of both views; words and shapes are remembered, a bounded number of them."""

    def __init__(self):
        self.hashes, self.known = WordHashes(), {}

    def word(self, w: bytes) -> tuple[int, int]:
        if (got := self.known.get(w)) is None:
            got = (self.hashes[w.lower()] & (CONTENT_BINS - 1), self.hashes[b"\1" + _shape(w)] & (CONTENT_BINS - 1))
            if len(self.known) < 300_000:
                self.known[w] = got
        return got

    def meta(self, name: str, value) -> int:
        return self.hashes[f"{name}={value}".encode("utf-8", "replace")] & (META_BINS - 1)

    def of(self, text: str | None, lang, source, n_chars) -> tuple[list[int], list[int]]:
        t = (text or "").encode("utf-8", "replace")
        all_words = t.split()
        distinct = set(all_words)
        content: set[int] = set()
        for w in distinct:
            content.update(self.word(w))
        n = len(all_words)
        step = lambda x, y: int(min(20, 20 * x / y)) if y else -1
        upper, letters = len(t) - len(t.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")), len(t) - len(t.translate(None, _LETTERS))
        signs = len(t) - len(t.translate(None, _SIGNS))
        lines = t.count(b"\n") + 1
        size = len(text or "") if n_chars is None else n_chars
        meta = [
            self.meta("source", source), self.meta("lang", lang), self.meta("size", int(np.log2(1 + max(0, size)) * 2)),
            self.meta("lines", int(np.log2(1 + len(t) / lines) * 2)), self.meta("upper", step(upper, letters)),
            self.meta("signs", step(signs * 3, len(t))), self.meta("distinct", (step(len(distinct), n), int(np.log2(1 + n)))),
            self.meta("distinct share", step(len(distinct), n)),
        ]
        return sorted(content), sorted(set(meta))


_LETTERS = bytes(b for b in range(256) if 65 <= b <= 90 or 97 <= b <= 122)
_SIGNS = bytes(b for b in range(33, 127) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))


def _features(batches):
    v = Views()
    kinds = pa.schema([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("blank", pa.bool_())])
    for b in batches:
        rows = list(zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True))
        got = [v.of(*x) for x in rows]
        out = pa.RecordBatch.from_pydict({"a": [g[0] for g in got], "b": [g[1] for g in got], "blank": [not (x[0] and x[0].strip()) for x in rows]}, schema=kinds)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *out.columns], names=["id", "row", *kinds.names])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Both views' feature numbers of every whole document, as a saved table: id, row, a, b, blank, h (hash of both).

    Documents without ``lang``, ``source`` or ``n_chars`` columns count as having nulls there. ``row`` is the column
    ``row_col`` (a long), null without one. ``blank``: the text is null or has no words.
    """
    meta = [(F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c) for c, kind in (("lang", "string"), ("source", "string"), ("n_chars", "long"))]
    made = docs.select(F.col(id_col).cast("long").alias("id"), (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row"), F.col(text_col).alias("text"), *meta)
    return save(made.mapInArrow(_features, "id long, row long, a array<int>, b array<int>, blank boolean").withColumn("h", F.xxhash64("a", "b")), "quality-features")


def _sums(column, w: np.ndarray) -> np.ndarray:
    """Sum of the weights of each row's features."""
    n = column.value_lengths().to_numpy()
    return np.bincount(np.repeat(np.arange(len(n)), n), w[column.flatten().to_numpy()], minlength=len(n))


class CoTrained:
    """Two calibrated views and their combination."""

    def __init__(self, content, meta, own, joint):
        self.content, self.meta, self.own, self.joint = content, meta, own, joint

    def views(self, a, b) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores of both views, of Arrow lists of feature numbers."""
        return _sums(a, self.content[0]) + self.content[1], _sums(b, self.meta[0]) + self.meta[1]

    def score(self, a, b) -> np.ndarray:
        """Calibrated content, metadata and combined score [rows, 3]."""
        za, zb = self.views(a, b)
        both = self.joint[0] * za + self.joint[1] * zb + self.joint[2]
        return np.stack([sigmoid(self.own[0][0] * za + self.own[0][1]), sigmoid(self.own[1][0] * zb + self.own[1][1]), sigmoid(both)], axis=1)


def _fitted(rows: list, y: list, bins: int, least: int) -> tuple[np.ndarray, float]:
    return fit(Sparse(rows, bins).frequent(least), np.array(y, np.float64), l2=2.0, screen=3.0)


def _confident(model, sure: float):
    """Rows that a view is sure of: id, h, view, label, p."""

    def run(batches):
        for b in batches:
            for view, z in enumerate(model.value.views(b.column(2), b.column(3))):
                p = sigmoid(z)
                for label, q in ((1, p), (0, 1 - p)):
                    at = pa.array(np.flatnonzero(q >= sure))
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.full(n, view, np.int32)), pa.array(np.full(n, label, np.int32)), pa.array(q[at.to_numpy()])], names=["id", "h", "view", "label", "p"])

    return run


def _pseudo_labels(table: DataFrame, labels: DataFrame, model: CoTrained, sure: float, most: int, had: dict) -> list:
    """Of all unlabelled documents the ``most`` of each view and label that the view is surest of: (view, label, h, a, b).

    Documents with equal features are one; what ``had`` holds for a view and label is left out.
    """
    spark = table.sparkSession
    scored = table.where("id is not null and not blank").select("id", "h", "a", "b").mapInArrow(_confident(spark.sparkContext.broadcast(model), sure), "id long, h long, view int, label int, p double")
    scored = save(scored.join(labels.select("id").distinct(), "id", "left_anti").groupBy("view", "label", "h").agg(F.max("p").alias("p")), "quality-confident")
    chosen = []
    for (view, label), old in had.items():
        top = scored.where((F.col("view") == view) & (F.col("label") == label) & ~F.col("h").isin(list(old))).orderBy(F.desc(F.round("p", 3)), F.xxhash64("h"), "h").limit(most)
        chosen += [(view, label, r.h) for r in top.collect()]
    discard(scored)
    if not chosen:
        return []
    wanted = spark.createDataFrame(sorted({(h,) for _, _, h in chosen}), "h long")
    rows = {r.h: (r.a, r.b) for r in table.join(F.broadcast(wanted), "h").groupBy("h").agg(F.first("a").alias("a"), F.first("b").alias("b")).collect()}  # four times ``most`` rows
    return [(view, label, h, *rows[h]) for view, label, h in chosen]


def train(table: DataFrame, labels: DataFrame, max_train: int = 5_000, max_pseudo: int = 400, rounds: int = 3, sure: float = 0.97, least: int = 5, id_col: str = "doc_id", label_col: str = "quality") -> CoTrained:
    """Co-train on the rows of ``features`` and the labels of some.

    Fits on at most about ``max_train`` labelled rows, chosen by id hash (a fifth of them only calibrates), and on at
    most ``max_pseudo`` pseudo-labels of each view, label and round. These are chosen from all unlabelled rows, by
    certainty to three digits and then by hash. Rows with a null id or without words take no part. An id with both
    labels counts as good. Content features in fewer than ``least`` of the fitted rows get no weight. Without labels
    of both kinds the score is constant.
    """
    labels = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    sample = bounded_sample(labels, max_train, F.col("id")).groupBy("id").agg(F.max("y").alias("y"))
    got = table.where("not blank").join(F.broadcast(sample), "id").select("id", "h", "y", "a", "b").toPandas().sort_values(["id", "h"], kind="stable")  # max_train rows
    a, b, y = got["a"].tolist(), got["b"].tolist(), got["y"].to_numpy(np.float64)
    aside = [i for i in range(len(y)) if i % 5 == 0 or len(y) <= 25]
    own = [i for i in range(len(y)) if i % 5 != 0 or len(y) <= 25]
    # what each view is trained on: feature numbers and labels
    rows, target = [[a[i] for i in own], [b[i] for i in own]], [[y[i] for i in own], [y[i] for i in own]]
    had: dict[tuple[int, int], set[int]] = {(view, label): set() for view in (0, 1) for label in (1, 0)}
    taught: list[set[int]] = [set(), set()]
    for nth in range(rounds + 1):
        model = CoTrained(_fitted(rows[0], target[0], CONTENT_BINS, least), _fitted(rows[1], target[1], META_BINS, 1), None, None)
        if nth == rounds or len(set(y[own])) < 2:
            break
        for view, label, h, xa, xb in _pseudo_labels(table, labels, model, sure, max_pseudo, had):
            had[view, label].add(h)
            if h not in taught[1 - view]:  # the first label that a view is taught stays
                taught[1 - view].add(h)
                rows[1 - view].append((xa, xb)[1 - view])
                target[1 - view].append(float(label))
    model.own, model.joint = [np.array([1.0, 0.0])] * 2, np.array([0.5, 0.5, 0.0])
    if len(set(y[aside])) > 1:
        za, zb = model.views(*(pa.array([x[i] for i in aside], pa.list_(pa.int32())) for x in (a, b)))
        model.own, model.joint = [calibrate(z[:, None], y[aside]) for z in (za, zb)], calibrate(np.column_stack([za, zb]), y[aside])
    return model


def score_documents(table: DataFrame, model: CoTrained, threshold: float = 0.5) -> DataFrame:
    """Score every row of ``features``: doc_id, row, p_content, p_metadata, score (all 0 to 1), keep (score >= threshold).

    Null texts and texts without words score 0 and are rejected. Repeated rows are returned each, null ids as they
    are. One pass without a shuffle.
    """
    shared = table.sparkSession.sparkContext.broadcast(model)  # 2**17 and 2**12 numbers, always

    def run(batches):
        for b in batches:
            p = shared.value.score(b.column(2), b.column(3))
            p[b.column(4).to_numpy(zero_copy_only=False)] = 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(p[:, i]) for i in range(3)), pa.array((p[:, 2] >= threshold) & (p[:, 2] > 0))], names=["doc_id", "row", "p_content", "p_metadata", "score", "keep"])

    return table.select("id", "row", "a", "b", "blank").mapInArrow(run, "doc_id long, row long, p_content double, p_metadata double, score double, keep boolean")
