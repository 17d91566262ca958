"""Exact top-k inner products over norm-sorted, SVD-rotated vectors.

Vectors are cut into blocks by descending length. All vectors and queries are rotated by the right singular vectors
of the whole table, so the leading coordinates carry most of each product. A query takes the blocks from the longest
vectors on: a block is skipped when the product of lengths can't reach its k-th best score so far; within a block,
sums over the leading coordinates plus the product of the remaining lengths (Cauchy-Schwarz) prune the vectors, and
only the rest get their exact integer product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import partitions, save

SCALE = 1024
BLOCK = 2048
#: Below every score, and with a negative in 64 bits.
LEAST = -(2**62)
QUERY_LOT = 4096


def _integers(col: str):
    """floor(1024 * x) of each component; null for a vector that is null or has a null or non-finite component."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(F.col(col).isNull() | F.coalesce(bad, F.lit(True)), None).otherwise(F.transform(col, lambda x: F.floor(x.cast("double") * SCALE).cast("long")))


def _matrix(col) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def _gram(batches):
    """Sums of outer products by dimension."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for d, rows in _by_dim(b, 1):
            x = _matrix(b.column(1).take(rows)).astype(np.float64)
            sums[d] = sums.get(d, 0) + x.T @ x
    for d, s in sums.items():
        yield pa.RecordBatch.from_pydict({"dim": pa.array([d], pa.int32()), "gram": [s.tobytes()]})


def _by_dim(b: pa.RecordBatch, at: int):
    dims = b.column(at).value_lengths().to_numpy()
    for d in np.unique(dims):
        if d:
            yield int(d), pa.array(np.flatnonzero(dims == d))


def _rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension, the right singular vectors of all its vectors, the strongest first (one small matrix)."""
    sums: dict[int, np.ndarray] = {}
    added = rows.select("vec_id", "v").mapInArrow(_gram, "dim int, gram binary").repartition(8).mapInArrow(_add_grams, "dim int, gram binary")
    for r in added.collect():
        sums[r.dim] = sums.get(r.dim, 0) + np.frombuffer(r.gram).reshape(r.dim, r.dim)
    return {d: np.linalg.eigh(s)[1][:, ::-1].copy() for d, s in sums.items()}


def _add_grams(batches):
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for d, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            sums[d] = sums.get(d, 0) + np.frombuffer(g)
    for d, s in sums.items():
        yield pa.RecordBatch.from_pydict({"dim": pa.array([d], pa.int32()), "gram": [s.tobytes()]})


class Queries:
    """A lot of queries of one dimension (whole numbers), and rotated ones, in floating point, for the bounds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, names: np.ndarray):
        self.ids, self.vectors, self.names = ids, vectors, names
        self.lead = max(1, vectors.shape[1] // 4)
        self.rotation = rotation
        r = vectors.astype(np.float64) @ rotation
        self.first, self.length = r[:, : self.lead], np.sqrt((r**2).sum(axis=1))
        self.rest = np.sqrt(np.maximum(0, (r[:, self.lead :] ** 2).sum(axis=1)))
        self.seed = np.full(len(ids), LEAST)  # scores known to be reached k times


class Best:
    """The k best of each query so far: scores, ids and whether the row equals the query, worst last."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), LEAST)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.own = np.zeros((n, k), bool)

    def floor(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        s, i, o = (np.concatenate([x[q], y]) for x, y in ((self.score, scores), (self.id, ids), (self.own, own)))
        order = np.lexsort((i, -s))[: self.k]
        self.score[q], self.id[q], self.own[q] = s[order], i[order], o[order]


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: 64-bit arithmetic goes round, so a sum that fits 64 bits is exact. One that doesn't is an error."""
    if (np.abs(x.astype(np.float64) @ y.astype(np.float64)) >= 2.0**63).any():
        raise OverflowError("an inner product is beyond 64 bits")
    return (x * y).sum(axis=1)


def scan(q: Queries, best: Best, ids: np.ndarray, x: np.ndarray) -> int:
    """Let a block of vectors (whole numbers) compete, best in descending length; how many exact products it took.

    Bounds are floating point with more slack than their rounding; what they leave is computed exactly.
    """
    r = x.astype(np.float64) @ q.rotation
    length = np.sqrt((r**2).sum(axis=1))
    rest = np.sqrt(np.maximum(0, (r[:, q.lead :] ** 2).sum(axis=1)))
    slack = 1e-6 * (1 + q.length * length.max(initial=0))  # more than the rounding of the bounds
    floor = np.maximum(best.floor(), q.seed).astype(np.float64)
    open_ = np.flatnonzero(q.length * length.max(initial=0) + slack >= floor)
    if not len(open_):
        return 0
    bound = q.first[open_] @ r[:, : q.lead].T + np.outer(q.rest[open_], rest) + slack[open_, None]
    done = 0

    def add(k: int, rows: np.ndarray) -> None:
        nonlocal done
        own = ids[rows] == q.ids[k]
        own[own] = (x[rows[own]] == q.vectors[k]).all(axis=1)
        best.add(k, products(x[rows], q.vectors[k]), ids[rows], own)
        done += len(rows)

    for nth, k in enumerate(open_.tolist()):
        keep = np.flatnonzero(bound[nth] >= floor[k])
        if len(keep) > 4 * best.k:  # begin with the most promising, then prune again
            lead = keep[np.argsort(-bound[nth, keep], kind="stable")[: 2 * best.k]]
            add(k, lead)
            rest_ = keep[bound[nth, keep] >= max(best.score[k, -1], q.seed[k])]
            keep = rest_[~np.isin(rest_, lead)]
        if len(keep):
            add(k, keep)
    return done


def _search(shared, k: int):
    """Stream a partition's vectors, the longest first, block by block past the queries."""

    def run(batches):
        lots: dict[int, Queries] = shared.value
        best = {d: Best(len(q.ids), k) for d, q in lots.items()}
        for b in batches:
            ids = b.column(0).to_numpy()
            for d, rows in _by_dim(b, 1):
                if d in lots:
                    x, every = _matrix(b.column(1).take(rows)), ids[rows.to_numpy()]
                    for at in range(0, len(every), BLOCK):
                        scan(lots[d], best[d], every[at : at + BLOCK], x[at : at + BLOCK])
        for d, q in lots.items():
            n, j = np.nonzero(best[d].id != np.iinfo(np.int64).max)
            yield pa.RecordBatch.from_arrays([pa.array(q.ids[n]), pa.array(q.names[n]), pa.array(best[d].id[n, j]), pa.array(best[d].score[n, j]), pa.array(best[d].own[n, j])], names=["query_id", "query", "vec_id", "score", "own"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` greatest integer inner products of each query with every other row.

    Components become floor(1024 * x). Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id; a
    query with fewer than ``k`` candidates gets all. A query's own row is one row of its id and vector; other rows
    are candidates, also those of the same id, or equal ones. Vectors that are null, or hold a null or non-finite
    component, take no part; neither do null ids; vectors only meet others of their own dimension, and empty vectors
    none. Query rows of one id but different vectors are each answered, equal ones once. Empty tables give an empty
    result. Other columns are not read. A product beyond 64 bits is an error.

    Queries are broadcast in lots of QUERY_LOT; each lot passes once over the vectors, which stand in partitions of
    descending length, sorted, and are streamed.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), _integers(vector_col).alias("v")).where("vec_id is not null and v is not null")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    dealt = rows.withColumn("n", norm).repartitionByRange(partitions(spark), F.desc("n"), "vec_id").sortWithinPartitions(F.desc("n"), "vec_id")
    rows = save(dealt, "topk-vectors")
    rotations = _rotations(rows)
    asked = queries.select(F.col(id_col).cast("long").alias("vec_id"), _integers(vector_col).alias("v")).where("vec_id is not null and v is not null").dropDuplicates(["vec_id", "v"])
    asked = save(asked.withColumn("name", F.xxhash64("vec_id", "v")), "topk-queries")
    lots = asked.count() // QUERY_LOT + 1
    longest = rows.orderBy(F.desc("n"), "vec_id").limit(BLOCK).select("vec_id", "v").toPandas()  # one block
    out = None
    for lot in range(lots):
        mine = asked.where(F.pmod("name", F.lit(lots)) == lot).toPandas()  # QUERY_LOT rows or so
        sets: dict[int, Queries] = {}
        for d, part in mine.groupby(mine["v"].map(len)):
            if d in rotations:
                q = sets[d] = Queries(part["vec_id"].to_numpy(), np.stack(part["v"].to_list()), rotations[d], part["name"].to_numpy())
                head = longest[longest["v"].map(len) == d]
                if len(head):  # the longest vectors give every task a first bound
                    best = Best(len(q.ids), k + 1)
                    scan(q, best, head["vec_id"].to_numpy(), np.stack(head["v"].to_list()))
                    q.seed = best.floor().copy()
        # one more than asked for: the query's own row may be among them
        found = rows.select("vec_id", "v").mapInArrow(_search(spark.sparkContext.broadcast(sets), k + 1), "query_id long, query long, vec_id long, score long, own boolean")
        out = found if out is None else out.union(found)
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id", F.desc("own"))
    best = out.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    own = F.row_number().over(Window.partitionBy("query_id", "query", "own").orderBy("n"))
    rest = best.withColumn("nth", own).where("not (own and nth = 1)")
    return rest.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query").orderBy("n"))).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
