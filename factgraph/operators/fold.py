"""Ordered folds: rows of a key in order, where what earlier rows did decides what later ones do."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def ordered_fold(rows: DataFrame, keys: list[str], order: list[Column], start: Callable[[dict], dict], step: Callable[[dict, dict], list[dict]], finish: Callable[[dict], list[dict]], schema: StructType) -> DataFrame:
    """The rows that ``step(state, row)`` gives for each row of a key in ``order`` and ``finish(state)`` after its last; ``start(row)`` makes the state from a key's first row.

    A key's rows are sorted within one partition and pass as a stream: a task holds one state and one batch, however many rows the key has. Filter and reduce rows before, since one key's rows
    pass one after the other."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        state, at = None, None
        for b in batches:
            for begin in range(0, b.num_rows, 1024):
                for row in b.slice(begin, 1024).to_pylist():
                    key = tuple(row[k] for k in keys)
                    if state is None or key != at:
                        if state is not None:
                            out += finish(state)
                        state, at = start(row), key
                    out += step(state, row)
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if state is not None:
            out += finish(state)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
