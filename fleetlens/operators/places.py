"""Numbering and folding in order without one task for one key: a key's rows are cut into blocks of its order.

Blocks are equal spans of the first order column (a number, a date or a timestamp), just wide enough that the
largest key's blocks hold about rows_a_block rows where they lie evenly. A row for each block is all that meets by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetlens.operators.folds import fold
from fleetlens.operators.temporal import fresh_name, same_keys

ROWS_A_BLOCK = 1_000_000
#: Rows that a task sorts for a window at a time, of keys that are far smaller than that.
ROWS_A_TASK = 500_000


def dealt(rows: DataFrame, keys: list[str], count: int | None = None) -> DataFrame:
    """rows (count of them, if known) as they are, or, if a task of the session might hold more than ROWS_A_TASK, hashed by keys into
    as many as it takes: what a task of a window by keys sorts then doesn't grow with the input. A key is never cut. A session's
    own partitions are merged by their compressed bytes until there is one a core, however many rows these are."""
    many = -(-(rows.count() if count is None else count) // ROWS_A_TASK)
    least = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(many, *keys) if keys and many > least else rows


def block_of(rows: DataFrame, keys: list[str], order: str, rows_a_block: int) -> Column | None:
    """The block of each row, or None if every key is small enough to be one."""
    return block_and_count(rows, keys, order, rows_a_block)[0]


def block_and_count(rows: DataFrame, keys: list[str], order: str, rows_a_block: int) -> tuple[Column | None, int]:
    """The same, and how many rows there are."""
    kind = rows.schema[order].dataType
    place = F.unix_micros(F.col(order).cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else F.unix_date(order) if isinstance(kind, T.DateType) else F.col(order).cast("long")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
    most = sizes.agg(F.max("n").alias("n"), F.sum("n").alias("all"), F.max(F.col("last") - F.col("first")).alias("span")).first()
    if not most.n or most.n <= rows_a_block or most.span is None:
        return None, most["all"] or 0
    return F.floor(place / F.lit(max(1, -(-(int(most.span) + 1) * rows_a_block // most.n)))), most["all"]


def places(rows: DataFrame, keys: list[str], order: list[str], rows_a_block: int = ROWS_A_BLOCK, place: str = "place", total: str = "total") -> DataFrame:
    """rows with their 0-based place among their keys' rows in `order`, and how many these are. Null keys are a key; rows that
    are equal in `order` have places in no particular order, so order should tell rows apart."""
    block, count = block_and_count(rows, keys, order[0], rows_a_block)
    if block is None:
        at = Window.partitionBy(*keys)
        return dealt(rows, keys, count).withColumns({place: (F.row_number().over(at.orderBy(*order)) - 1).cast("long"), total: F.count(F.lit(1)).over(at)})
    b, before = fresh_name("block", rows), fresh_name("before", rows)
    cut = rows.withColumn(b, block)
    by_key = Window.partitionBy(*keys)
    sums = cut.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("n"))
    sums = sums.select(*keys, b, (F.sum("n").over(by_key.orderBy(b)) - F.col("n")).alias(before), F.sum("n").over(by_key).alias(total))
    inside = dealt(cut, [*keys, b], count).withColumn(place, F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order)) - 1)
    out = inside.join(sums, same_keys(inside, sums, [*keys, b]), "left")
    return out.select(*[inside[c] for c in rows.columns], (F.col(before) + inside[place]).cast("long").alias(place), sums[total])


@dataclass(frozen=True)
class Machine:
    """A state machine with few states (0 to states - 1). step(states, row) gives the array of states after a row, for any array
    of states before; emit(before, after, row) a row of the result or None."""

    states: int
    start: int
    step: Callable[[np.ndarray, dict], np.ndarray]
    emit: Callable[[int, int, dict], tuple | None]


def summary_of(machine: Machine, rows: Iterator[dict], found: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """What rows make of every state: distinct states after them, and which of these each state before becomes. States that
    have met go on as one, so machines that forget cost little."""
    values, which = found or (np.arange(machine.states), np.arange(machine.states))
    for i, row in enumerate(rows):
        values = machine.step(values, row)
        if i % 8 == 7 and len(values) > 1:
            values, inverse = np.unique(values, return_inverse=True)
            which = inverse[which]
    return values, which


def block_fold(rows: DataFrame, keys: list[str], order: list[str], machine: Machine, schema: str, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """As fold() with machine, but a key's rows are dealt over tasks by blocks.

    Each block is summarised as a table from the state before it to the state after it, tables are applied in order to find
    every block's first state (a row of `states` numbers a block), and then all blocks run at once from there.
    """
    run = lambda state, r: _advance(machine, state, r)
    block = block_of(rows, keys, order[0], rows_a_block)
    if block is None:
        return fold(rows, keys, order, lambda: {"at": machine.start}, run, schema)
    b, first = fresh_name("block", rows), fresh_name("first_state", rows)
    cut = rows.withColumn(b, block)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    out_schema = f"{kinds + ', ' if keys else ''}{b} long, after array<int>"

    names, arrow = [*keys, b, "after"], [f.type for f in to_arrow_schema(T.StructType.fromDDL(out_schema))]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, found = None, None
        made = lambda: pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip([*current, found[0][found[1]].tolist()], arrow)], names=names)
        for batch in batches:
            listed = batch.to_pylist()
            at = 0
            while at < len(listed):
                key = tuple(listed[at][k] for k in [*keys, b])
                end = at
                while end < len(listed) and tuple(listed[end][k] for k in [*keys, b]) == key:
                    end += 1
                if key != current:
                    if current is not None:
                        yield made()
                    current, found = key, None
                found = summary_of(machine, listed[at:end], found)
                at = end
        if current is not None:
            yield made()

    tables = cut.repartition(*keys, b).sortWithinPartitions(*keys, b, *order).mapInArrow(summarise, out_schema)

    def chain(s: dict, r: dict) -> tuple:
        before, s["at"] = s["at"], r["after"][s["at"]]
        return (*(r[k] for k in keys), r[b], before)

    one = [] if keys else [F.lit(0).alias("_all")]
    starts = fold(tables.select("*", *one), keys or ["_all"], [b], lambda: {"at": machine.start}, chain, out_schema.replace("after array<int>", f"{first} int"))
    joined = cut.join(starts, same_keys(cut, starts, [*keys, b]), "left").select(*[cut[c] for c in cut.columns], starts[first])

    def go_on(s: dict, r: dict):
        if s["at"] is None:
            s["at"] = r[first]
        return run(s, r)

    return fold(joined, [*keys, b], order, lambda: {"at": None}, go_on, schema)


def _advance(machine: Machine, s: dict, r: dict):
    before = s["at"]
    s["at"] = int(machine.step(np.array([before]), r)[0])
    return machine.emit(before, s["at"], r)
