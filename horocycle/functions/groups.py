"""Whole groups of rows in Arrow batches, many groups at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows, sorted by their first column, in tables that don't split a run of equal values of it."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_pylist()
        cut = len(keys) - 1
        while cut and keys[cut - 1] == keys[-1]:
            cut -= 1
        if not cut and (not kept or kept[-1].column(0)[-1].as_py() == keys[0]):
            kept.append(batch)
            continue
        yield pa.Table.from_batches([*kept, batch.slice(0, cut)])
        kept = [batch.slice(cut)]
    if kept:
        yield pa.Table.from_batches(kept)


def starts(keys: pa.ChunkedArray) -> np.ndarray:
    """Where the runs of equal values begin."""
    x = keys.to_pylist()
    return np.array([0, *(i for i in range(1, len(x)) if x[i] != x[i - 1])])


def map_groups(df: DataFrame, order: list[str], of: Callable[[pa.Table, np.ndarray], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``of(table, starts)`` of whole groups of the first column, each sorted by all of ``order``; its key is the first of ``order``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches):
            yield from of(table, starts(table.column(0)))

    return df.repartition(order[0]).sortWithinPartitions(*order).mapInArrow(run, schema)
