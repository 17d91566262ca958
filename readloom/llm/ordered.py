"""Numbers and running values within ordered groups that may be larger than a task.

Rows are dealt by ranges of (group, order), so a group of any size is cut over several tasks. Each task counts from
its own first row; the last row of every task, one row a task, says what the next one has to add.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.common import save


def starts(values: pa.Array, before: tuple | None) -> np.ndarray:
    """Where a new group begins, in a batch whose groups follow each other; ``before``: the group that came last, in a tuple."""
    null = values.is_null().to_numpy(zero_copy_only=False)
    plain = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
    new = np.ones(len(plain), bool)
    new[1:] = (plain[1:] != plain[:-1]) | (null[1:] != null[:-1])
    if before is not None:
        new[0] = values[0].as_py() != before[0]
    return new


def _local(group: str, xor: tuple[str, ...]):
    def run(batches):
        part, before, count, held = TaskContext.get().partitionId(), None, 0, [0] * len(xor)
        for b in batches:
            size = b.num_rows
            if not size:
                continue
            ids = b.column(b.schema.get_field_index(group))
            new = starts(ids, before)
            first = np.flatnonzero(new)
            if not new[0]:
                first = np.concatenate([[0], first])
            else:
                count, held = 0, [0] * len(xor)
            segment = np.searchsorted(first, np.arange(size), side="right") - 1
            n = np.arange(size) - first[segment]
            n[segment == 0] += count
            columns = dict(zip(b.schema.names, b.columns, strict=True))
            for k, name in enumerate(xor):
                run_ = np.bitwise_xor.accumulate(columns[name].to_numpy())
                at_start = np.concatenate([[0], run_[first[1:] - 1]])
                at_start[0] ^= held[k]
                columns[name] = pa.array(run_ ^ at_start[segment])
                held[k] = int(columns[name][-1].as_py())
            before, count = (ids[-1].as_py(),), int(n[-1]) + 1
            columns |= {"part": pa.array(np.full(size, part, np.int32)), "n": pa.array(n.astype(np.int64))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def running(rows: DataFrame, group: str, order: list[Column], name: str, xor: tuple[str, ...] = ()) -> DataFrame:
    """``rows``, saved, with ``n``, each one's place in its group (from 0), and the ``xor`` columns (long) XORed up to it.

    ``group`` is a long; null is a group. Rows that tie in ``order`` may stand in any order among themselves.
    """
    sort = [F.col(group).asc_nulls_first(), *order]
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType())])
    out = save(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(_local(group, xor), schema), name)
    key = F.struct(F.col(group).isNotNull().alias("some"), F.col(group).alias("id"))
    ends = out.groupBy("part").agg(F.min(key).alias("first"), F.max(F.struct(key.alias("key"), "n", *xor)).alias("last")).orderBy("part").collect()  # a row a task
    add: list[tuple] = []
    carry: tuple | None = None
    for r in ends:
        first = tuple(r["first"])
        more = carry[1:] if carry and carry[0] == first else (0,) * (1 + len(xor))
        if any(more):
            add.append((r["part"], r["first"]["id"], *more))
        last = (r["last"]["n"] + 1, *(r["last"][x] for x in xor))
        if tuple(r["last"]["key"]) == first:
            last = (last[0] + more[0], *(a ^ b for a, b in zip(last[1:], more[1:], strict=True)))
        carry = (tuple(r["last"]["key"]), *last)
    if add:
        fields = [T.StructField(c, T.LongType()) for c in ("_group", "_n", *(f"_{x}" for x in xor))]
        found = rows.sparkSession.createDataFrame(add, T.StructType([T.StructField("_part", T.IntegerType()), *fields]))
        both = out.join(F.broadcast(found), (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")), "left")
        plus = {"n": F.col("n") + F.coalesce("_n", F.lit(0))} | {x: F.col(x).bitwiseXOR(F.coalesce(f"_{x}", F.lit(0))) for x in xor}
        made = both.withColumns(plus).select(*out.columns)
        made._readloom_path = out._readloom_path
        out = made
    return out
