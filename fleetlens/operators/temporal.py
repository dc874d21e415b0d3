"""Joins in time: moments with the intervals that hold them, and rows with the last log entry before them.

Both are equi-joins or windows on bins of time, so no pair is tried that isn't in one bin, and both stay even if one key holds
a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: No more keys than this are heavy: it bounds what is broadcast.
MOST_HEAVY = 10_000


def fresh_name(stem: str, *frames: DataFrame) -> str:
    taken = {c.lower() for f in frames for c in f.columns}
    while stem in taken:
        stem = "_" + stem
    return stem


def heavy_keys(rows: DataFrame, keys: list[str], rows_a_task: int, parts: str) -> DataFrame:
    """keys and parts of the keys with more rows than a task should have: at most MOST_HEAVY of them, as the limit grows."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(rows_a_task, -(-total // MOST_HEAVY))
    return counts.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias(parts))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of keys in which nulls are equal."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def interval_join(moments: DataFrame, spans: DataFrame, keys: list[str], at: str, since: str, until: str, rows_a_task: int = 1_000_000) -> DataFrame:
    """moments with every span of their keys that holds them, both ends included; further columns of spans come along.

    A span is filed under the width 2^level that just exceeds its length, in the one or two bins of that width that it
    touches; a moment looks into one bin of each level in use (64 at most). So spans are copied twice at most, however long
    they are, and a bin holds few spans that miss the moment. The moments of a heavy key are dealt over several tasks, to which
    its spans are copied. Rows with a null key or time, and spans that end before they start, match nothing. Times are whole numbers.
    """
    level, bin_, salt, parts = (fresh_name(s, moments, spans) for s in ("level", "bin", "salt", "parts"))
    length = F.try_subtract(F.col(until).cast("long"), F.col(since).cast("long"))
    width = F.when(length.isNull(), F.lit(63)).when(length == 0, F.lit(0)).otherwise(F.length(F.bin(length)))
    shift = lambda c: F.expr(f"shiftright(CAST(`{c}` AS BIGINT), `{level}`)")
    filed = spans.where((F.col(since) <= F.col(until))).withColumn(level, width.cast("int")).withColumn(bin_, F.explode(F.array_distinct(F.array(shift(since), shift(until)))))
    used = sorted(r[0] for r in filed.select(level).distinct().collect())  # 64 at most
    heavy = heavy_keys(moments, keys, rows_a_task, parts)
    asked = moments.withColumn(level, F.explode(F.array(*[F.lit(x) for x in used]).cast("array<int>"))).withColumn(bin_, shift(at))
    salted = asked.join(F.broadcast(heavy), keys, "left").withColumn(salt, F.pmod(F.xxhash64(*moments.columns, F.monotonically_increasing_id()), F.coalesce(parts, F.lit(1))).cast("int")).drop(parts)
    copied = filed.join(F.broadcast(heavy), keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).drop(parts)
    return salted.join(copied, [*keys, level, bin_, salt]).where(F.col(at).between(F.col(since), F.col(until))).drop(level, bin_, salt)


def last_before(rows: DataFrame, log: DataFrame, keys: list[str], at: str, columns: list[str], order: list[str], inclusive: bool = True, rows_a_block: int = 1_000_000) -> DataFrame:
    """rows with `columns` of the last log entry (by `at`, then order) of their keys at or before them (before them, if not
    inclusive); null where there is none. Null keys are a key. rows without a time have none.

    Rows and log entries go through one window in the order of time, which carries entries forward. A key with more rows
    than rows_a_block is cut into blocks of time: a row for each block carries the last entry of the blocks before it.
    """
    kind, tie, held, block, carried = (fresh_name(s, rows, log) for s in ("kind", "tie", "held", "block", "carried"))
    entry = F.struct(*[F.col(c) for c in columns])
    entries = log.where(F.col(at).isNotNull()).select(*keys, at, F.lit(0 if inclusive else 2).alias(kind), F.struct(*order).alias(tie), entry.alias(held), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c not in (*keys, at)])
    asked = rows.select(*keys, at, F.lit(1).alias(kind), F.lit(None).cast(entries.schema[tie].dataType).alias(tie), F.lit(None).cast(entries.schema[held].dataType).alias(held), *[c for c in rows.columns if c not in (*keys, at)])
    both = asked.unionByName(entries)
    sizes = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    most = sizes.agg(F.max("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")).first()
    if not most.n or most.n <= rows_a_block or most.first is None:
        span = None
    else:
        span = max(1, -(-(int(most.last) - int(most.first) + 1) * rows_a_block // most.n))
    both = both.withColumn(block, F.lit(0).cast("long") if span is None else F.floor(F.col(at) / F.lit(span)))
    within = Window.partitionBy(*keys, block).orderBy(F.col(at), F.col(kind), F.col(tie)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn(held, F.last(held, ignorenulls=True).over(within)).where(F.col(kind) == 1)
    if span is not None:
        last = F.max_by(held, F.when(F.col(held).isNotNull(), F.struct(at, tie)))
        ends = both.groupBy(*keys, block).agg(last.alias(held))
        ends = ends.withColumn(carried, F.last(held, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1))).drop(held)
        out = out.join(ends, same_keys(out, ends, [*keys, block]), "left").select(*[out[c] for c in out.columns], carried).withColumn(held, F.coalesce(held, carried)).drop(carried)
    return out.select(*rows.columns, *[F.when(F.col(at).isNotNull(), F.col(held)[c]).alias(c) for c in columns])
