"""Control frames, event pages and task snapshots as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the most bytes of a control frame.
MOST = 64 << 10


def encode(rows: DataFrame, columns: list[str], name: str = "frame", most: int = MOST) -> DataFrame:
    """rows with a JSON frame of some columns; null where it would be too long."""
    frame = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return rows.withColumn(name, F.when(F.octet_length(frame) <= most, frame))


def decode(rows: DataFrame, column: str, schema: str, most: int = MOST) -> DataFrame:
    """rows with value (by schema; null where turned away) and accepted: short enough, JSON, and with all of the schema's fields."""
    value = F.from_json(F.when(F.octet_length(column) <= most, F.col(column)), schema, {"mode": "PERMISSIVE"})
    rows = rows.withColumn("value", value)
    whole = F.col("value").isNotNull()
    for field in rows.schema["value"].dataType.names:
        whole = whole & F.col(f"value.{field}").isNotNull()
    return rows.withColumn("accepted", whole)


def events_after(events: DataFrame, sequence: str, after: int, limit: int) -> DataFrame:
    """The next `limit` events of a reader that has seen `after`: the limit is the page."""
    return events.where(F.col(sequence) > after).orderBy(sequence).limit(limit)


def pages(events: DataFrame, sequence: str, size: int, span: int = 1 << 16) -> DataFrame:
    """events with page and last_of_page. An event's rank is its place within its span of sequences and the events of the
    spans before, so that one task ranks a span at most; a row for each span is summed up in order."""
    spans = events.withColumn("span", F.floor(F.col(sequence) / span))
    counts = spans.groupBy("span").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select("span", before.alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    ranked = spans.withColumn("place", F.row_number().over(Window.partitionBy("span").orderBy(sequence))).join(firsts, "span")
    number = F.col("before") + F.col("place")
    return ranked.withColumn("page", F.floor((number - 1) / size)).withColumn("last_of_page", (number % size == 0) | (number == F.col("all"))).drop("span", "before", "all", "place")


def snapshots(tasks: DataFrame, claimed: Column, owner: Column) -> DataFrame:
    """tasks with holder: who claimed it, else its owner."""
    return tasks.withColumn("holder", F.coalesce(claimed, owner))
