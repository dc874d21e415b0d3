"""Ordered folds: each key's rows go in order through a state machine that holds one state, not the key's log.

Rows are hashed by key and sorted within partitions (which spills), then streamed in Arrow batches, so a key's log may be of
any length. Built-in aggregates cover what has a closed form; this is for what depends on every step before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], dict], step: Callable[[dict, dict], tuple | list[tuple] | None], schema: str, finish: Callable[[tuple, dict], list[tuple]] | None = None) -> DataFrame:
    """step(state, row) for every row, in `order` within each of keys; a row of `schema` for each tuple that it gives (one, a
    list or None), and for each that finish(key, state) gives at the key's end."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], type=f.type) for k, f in enumerate(arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        state: dict = {}
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != current:
                    if current is not None and finish:
                        found += finish(current, state)
                    current, state = key, start()
                result = step(state, row)
                if result is not None:
                    found += result if isinstance(result, list) else [result]
            yield batch_of(found)
        if current is not None and finish:
            yield batch_of(finish(current, state))

    return (rows.repartition(*keys) if keys else rows.repartition(1)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
