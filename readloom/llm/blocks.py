"""Blocks of documents, and counts of hashes over all blocks.

A block holds some megabytes of text, never a part of a document. ``count_over_blocks`` deals the distinct hashes of
each block to buckets by their leading bits, adds up each bucket, and returns to each block what it asked for. A hash
goes through the shuffle once for each block that holds it, in packed sorted arrays, so copies, however many, are
pre-aggregated; nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import partitions, save

BLOCK_BYTES = 1 << 21
#: Text bytes whose hashes one bucket may get, about.
BUCKET_BYTES = 1 << 24
_BLOCK = pa.schema([("block", pa.int64()), ("size", pa.int64()), ("ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int32())), ("blob", pa.binary())])


def _pack(most: int):
    def run(batches):
        pid, k, held = TaskContext.get().partitionId(), 0, 0
        pack = zstandard.ZstdCompressor(level=3)
        ids: list = []
        texts: list = []

        def block():
            nonlocal k
            blob = b"".join(t or b"" for t in texts)
            out = {"block": [(pid << 32) + k], "size": [len(blob)], "ids": [ids], "lens": [[-1 if t is None else len(t) for t in texts]], "blob": [pack.compress(blob)]}
            k += 1
            return pa.RecordBatch.from_pydict(out, schema=_BLOCK)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                t = t.as_py()
                ids.append(i)
                texts.append(t)
                held += 16 + len(t or b"")
                if held >= most:
                    yield block()
                    ids, texts, held = [], [], 0
        if ids:
            yield block()

    return run


def save_blocks(docs: DataFrame, id_col: str, text_col: str, name: str, most: int = BLOCK_BYTES) -> DataFrame:
    """Rows as a saved table of blocks: block, size (text bytes), ids, lens (-1: null), blob (compressed texts)."""
    made = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return save(made.mapInArrow(_pack(most), "block long, size long, ids array<long>, lens array<int>, blob binary"), name)


def block_texts(blob: bytes, lens: list[int]) -> Iterator[bytes | None]:
    """The texts of a block."""
    data, at = zstandard.ZstdDecompressor().decompress(blob) if any(n > 0 for n in lens) else b"", 0
    for n in lens:
        yield None if n < 0 else data[at : at + n]
        at += max(0, n)


def planes(x: np.ndarray, width: int) -> bytes:
    """The leading ``width`` bytes of 64-bit values, all first bytes first: sorted values compress well this way."""
    return np.ascontiguousarray(x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(b: bytes, width: int) -> np.ndarray:
    rows = np.zeros((len(b) // width, 8), np.uint8)
    rows[:, :width] = np.frombuffer(b, np.uint8).reshape(width, -1).T
    return rows.view(">u8").reshape(-1).astype(np.uint64)


def bucket_bits(blocks: DataFrame) -> int:
    """Leading bits that make a bucket's share of all text about BUCKET_BYTES."""
    size = int(blocks.agg(F.sum("size")).first()[0] or 0)
    return max(8, (size // BUCKET_BYTES).bit_length())


_SENT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("check", pa.binary()), ("n", pa.binary())])


def sent(block: int, h: np.ndarray, check: np.ndarray | None, n: np.ndarray, bits: int, width: int) -> pa.RecordBatch:
    """A block's distinct sorted hashes (with further bits and how often it has them), as one row for each bucket."""
    bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(h) else np.empty(0, np.int64)
    ends = np.append(first[1:], len(h))
    out: dict = {"bucket": bucket[first], "block": np.full(len(first), block, np.int64), "hashes": [], "check": [], "n": []}
    for a, b in zip(first.tolist(), ends.tolist(), strict=True):
        out["hashes"].append(planes(h[a:b], width))
        out["check"].append(b"" if check is None else check[a:b].astype(np.uint32).tobytes())
        out["n"].append(np.ascontiguousarray(n[a:b].astype(">u4").view(np.uint8).reshape(-1, 4).T).tobytes())
    return pa.RecordBatch.from_pydict(out, schema=_SENT)


def _counted(width: int, answer: Callable):
    """Add up one bucket after the other; rows of a bucket follow each other."""

    def bucket(rows: list[tuple]):
        h = [from_planes(r[1], width) for r in rows]
        ends = np.cumsum([len(x) for x in h])
        h = np.concatenate(h)
        n = np.concatenate([np.frombuffer(r[3], np.uint8).reshape(4, -1).T.copy().view(">u4").reshape(-1) for r in rows]).astype(np.int64)
        keys = [h] if not rows[0][2] else [np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows]), h]
        order = np.lexsort(keys)
        new = np.zeros(len(h), bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[order[1:]] != k[order[:-1]]
        group = np.empty(len(h), np.int64)
        group[order] = np.cumsum(new) - 1
        total = np.bincount(group, weights=n).astype(np.int64)[group]
        a = 0
        for r, b in zip(rows, ends.tolist(), strict=True):
            got = answer(h[a:b], total[a:b])
            if got:
                yield r[0], got
            a = b

    def run(batches):
        now, rows = None, []

        def flush():
            got = list(bucket(rows))
            if got:
                yield pa.RecordBatch.from_pydict({"block": [g[0] for g in got], "bucket": [now] * len(got), "got": [g[1] for g in got]}, schema=pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("got", pa.binary())]))

        for b in batches:
            for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != now and rows:
                    yield from flush()
                    rows = []
                now = k
                rows.append(tuple(row))
        if rows:
            yield from flush()

    return run


def count_over_blocks(rows: DataFrame, width: int, answer: Callable) -> DataFrame:
    """``rows`` as ``sent`` makes them. Returns for each block its answers in the order of its hashes: block, got.

    ``answer`` makes bytes of the hashes that a block sent to a bucket and their totals over all blocks. A block gets
    no more than it sent.
    """
    dealt = rows.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket", "block")
    back = dealt.mapInArrow(_counted(width, answer), "block long, bucket long, got binary")
    return back.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "got"))).alias("got")).select("block", F.col("got.got").alias("got"))
