"""Minimax contiguous sharding, with DataFrame operations only.

Texts are the atomic groups: rows with equal texts share a shard. Groups stand in the order of a 64-bit text hash,
so the shard of a row follows from its own hash and the 15 cut keys, without a join. The smallest feasible shard
capacity is found by binary search, each capacity being checked greedily over the ordered group sizes. The driver
holds a histogram of hash ranges, never the groups: ranges in which a cut may fall are opened further, by eight
bits of the hash at a time, until each cut lies on the edge of a single group.

The greedy filling only checks a capacity. The cuts themselves are evened out: within the smallest capacity each one
stands where the rest is shared out most equally, as a greedy filling would leave the last shards short.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import save

FIRST_BITS, STEP_BITS = 12, 8
SLOT_BUCKETS = 1024


class _Ranges:
    """Ordered hash ranges: first key, bytes, number of groups, largest group."""

    def __init__(self, rows: list[tuple]):
        rows = sorted(rows)
        self.shift, self.bucket = [np.array([r[i] for r in rows], dtype=np.int64) for i in (4, 5)]
        self.key, self.bytes, self.groups, self.largest = [np.array([r[i] for r in rows], dtype=np.int64) for i in range(4)]
        self.edge = np.concatenate([[0], np.cumsum(self.bytes)])
        self.rows = rows

    def greedy(self, capacity: int, shards: int, wanted: set[int]) -> bool:
        """Does a greedy filling with whole ranges end within ``shards``? wanted: ranges of several groups that it would cut."""
        at = 0
        for _ in range(shards):
            at = self.fill(at, capacity, wanted)
            if at == len(self.bytes):
                return True
        return False

    def fill(self, at: int, capacity: int, wanted: set[int]) -> int:
        end = int(np.searchsorted(self.edge, self.edge[at] + capacity, side="right")) - 1
        if end < len(self.bytes) and self.groups[end] > 1:
            wanted.add(end)
        return end


def _search(r: _Ranges, shards: int, wanted: set[int]) -> int:
    """The smallest capacity that whole ranges allow; wanted gets what decided it."""
    low, high = int(max(r.largest.max(), -(-r.edge[-1] // shards))), int(r.edge[-1])
    seen: dict[int, set[int]] = {}
    while low < high:
        mid = (low + high) // 2
        if r.greedy(mid, shards, seen.setdefault(mid, set())):
            high = mid
        else:
            low = mid + 1
    floor = int(max(r.largest.max(), -(-r.edge[-1] // shards)))
    for c in (low, low - 1):
        if c >= floor:
            r.greedy(c, shards, wanted)
    # the true capacity lies between the fluid bound and low: open also what the probes between them would cut
    for c, found in seen.items():
        if floor <= c <= low:
            wanted |= found
    return low


def _cuts(r: _Ranges, shards: int, capacity: int, wanted: set[int]) -> list[int]:
    """First ranges of shards 1, 2, ...: as near to equal as the capacity allows, hot groups alone.

    No shard exceeds the capacity. A cut lies between the earliest place from which the rest still fits (greedy
    from the end) and the latest place that the capacity allows (greedy from the last cut).
    """
    n, total = len(r.bytes), int(r.edge[-1])
    earliest, end = [n], n
    for _ in range(shards):
        begin = int(np.searchsorted(r.edge, r.edge[end] - capacity, side="left"))
        if begin > 0 and r.groups[begin - 1] > 1:
            wanted.add(begin - 1)
        end = begin
        earliest.append(end)
    earliest = earliest[::-1]  # earliest[j]: where shard j may begin at the earliest
    cuts, at = [], 0
    for j in range(1, shards):
        left, rest = shards - j + 1, total - int(r.edge[at])
        goal, own = rest / left, r.largest[at:]
        for _ in range(left):  # groups over the goal take shards of their own
            hot = own[own > goal]
            new = (rest - int(hot.sum())) / max(1, left - len(hot)) if len(hot) < left else goal
            if new >= goal:
                break
            goal = new
        last = r.fill(at, capacity, set())
        end = int(np.searchsorted(r.edge, r.edge[at] + goal, side="right")) - 1
        if end < n and r.groups[end] > 1:
            wanted.add(end)
        if end < n and r.bytes[end] <= goal and r.edge[end + 1] - r.edge[at] - goal < goal - (r.edge[end] - r.edge[at]):
            end += 1
        end = max(end, at + 1 if at < n else at, earliest[j])
        if end < n and end > last and r.groups[min(last, n - 1)] > 1:
            wanted.add(min(last, n - 1))
        at = min(end, max(last, at + (at < n)), n)
        cuts.append(at)
    return cuts


def cut_keys(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the first hash keys of shards 1, 2, ... of ``groups`` (key, bytes)."""

    def histogram(df: DataFrame, shift: int) -> list[tuple]:
        b = F.shiftright("key", shift) if shift else F.col("key")
        got = df.groupBy(b.alias("b")).agg(F.min("key"), F.sum("bytes"), F.count("*"), F.max("bytes")).collect()
        return [(*map(int, x[1:]), shift, int(x[0])) for x in got]

    shift = 64 - FIRST_BITS
    rows = histogram(groups, shift)
    if not rows:
        return 0, []
    while True:
        r = _Ranges(rows)
        wanted: set[int] = set()
        capacity = _search(r, shards, wanted)
        even = r.edge[-1] / shards
        wanted |= {int(i) for i in np.flatnonzero((r.groups > 1) & (r.bytes > even / 8))}
        cuts = _cuts(r, shards, capacity, wanted)
        if not wanted:
            return capacity, [int(r.key[i]) if i < len(r.key) else None for i in cuts]
        keep = [x for i, x in enumerate(r.rows) if i not in wanted]
        for s in {int(r.shift[i]) for i in wanted}:
            ids = [int(r.bucket[i]) for i in wanted if r.shift[i] == s]
            of = F.shiftright("key", s) if s else F.col("key")
            keep += histogram(groups.where(of.isin(ids)), max(0, s - STEP_BITS))
        rows = keep


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` shards of nearly equal bytes; rows with equal texts stay together.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in each shard), grown_shard (null).
    Size is the text's UTF-8 bytes plus 1. A null text has size 1 and a null crc32, and all null texts form one
    group; an empty text is a group of its own. Repeated rows are kept, each with its slot. A null id sorts first.
    An empty table gives an empty result. If there are fewer groups than shards, the last shards stay empty. No
    shard exceeds the minimax capacity; within it the cuts are evened out, not greedy.
    Other columns are not read. Shard sizes differ by more than a group only where one text's copies exceed an
    even share: such a group has its shard to itself.
    """
    rows = save(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(text_col).alias("text_crc32"),
            F.xxhash64(text_col).alias("key"),
        ),
        "shard-rows",
    )
    groups = save(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    _, cuts = cut_keys(groups, shards)
    shard = sum((F.when(F.col("key") >= F.lit(c), 1).otherwise(0) for c in cuts if c is not None), F.lit(0))
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SLOT_BUCKETS)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "bucket").orderBy("key", "doc_id")
    return (
        placed.withColumn("nth", F.row_number().over(own))
        .join(F.broadcast(first), ["shard", "bucket"])  # at most shards * SLOT_BUCKETS rows
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
