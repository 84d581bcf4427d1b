"""Greedy selection along an order, where each choice depends on the one before it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.workers import findable


def picks(at: np.ndarray, need: np.ndarray, last: int | None) -> list[int]:
    """Places of the rows picked, of one key's rows in order; ``last`` is the time picked before them, if any.

    A row is picked if at - need >= last. Rows up to the last pick can't fulfil that while every need is positive, so that the next
    pick is found by binary search in the running maximum of at - need: a step for each pick, not for each row."""
    n = len(at)
    if not n:
        return []
    out = []
    if last is None:
        out, last = [0], int(at[0])
    free = at - need
    if need.min() <= 0:
        for i in range(len(out), n):
            if free[i] >= last:
                out.append(i)
                last = int(at[i])
        return out
    highest = np.maximum.accumulate(free)
    while (i := int(np.searchsorted(highest, last, "left"))) < n:
        out.append(i)
        last = int(at[i])
    return out


def starts(columns: list[pa.Array]) -> np.ndarray:
    """Where in a batch another key begins; 0 is always one."""
    n = len(columns[0])
    other = np.zeros(n, bool)
    for c in columns:
        codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        other[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(np.concatenate([[True], other[1:]]))


def picked(rows: DataFrame, keys: list[str], at: str, need: str, order: list[str] | None = None) -> DataFrame:
    """``rows`` and the column ``last``: the value of ``at`` of the last row picked, up to and with this one.

    Along each key in the order of ``at`` (and ``order``, for ties), the first row is picked, and then each whose ``at`` is ``need`` or more
    beyond the last picked. A row is picked if ``last = at`` and it is the first with it, which ``picked`` tells. ``at`` and ``need`` aren't null.

    The rows of a key go by in sorted batches and only the last pick is kept, so that memory doesn't grow with a key;
    a frame over (OVER ...) can't express it, and gathering a key's rows in an array would."""
    findable(rows.sparkSession)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, last bigint, picked boolean"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(k) for k in keys]
            times, needs = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (at, need))
            lasts, flags = np.empty(n, np.int64), np.zeros(n, bool)
            cuts = starts(columns)
            for a, b in zip(cuts, [*cuts[1:], n], strict=True):
                own = tuple(c[int(a)].as_py() for c in columns)
                if own != key:
                    key, last = own, None
                found = picks(times[a:b], needs[a:b], last)
                flags[[a + i for i in found]] = True
                edges = [0, *found, int(b - a)]
                values = [0 if last is None else last, *(times[a + i] for i in found)]
                lasts[a:b] = np.repeat(values, np.diff(edges))
                last = int(lasts[b - 1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lasts), pa.array(flags)], [*batch.schema.names, "last", "picked"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, at, *(order or [])).mapInArrow(walk, schema)


def anchored(rows: DataFrame, keys: list[str], at: str, size: int, order: list[str] | None = None) -> DataFrame:
    """``rows`` and ``window_ms``: windows of a size that begin with the first row which isn't in the window before."""
    got = picked(rows.withColumn("__need", F.lit(size).cast("long")), keys, at, "__need", order)
    return got.withColumnRenamed("last", "window_ms").drop("__need", "picked")
