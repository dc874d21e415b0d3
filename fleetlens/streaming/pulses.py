"""Streams of pulses: counters by tick and silent nodes. Late rows are those behind the watermark; they are dropped.

The same functions run on static tables, where a watermark has no effect: a stream's final state is the batch result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(pulses: DataFrame, late: str) -> DataFrame:
    """ts as a timestamp (watermarks don't take the kind without a zone; sessions run in UTC)."""
    return pulses.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tick_counters(pulses: DataFrame, tick: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Pulses and load of each node and tick; state is one row a node for each open tick."""
    grouped = _timed(pulses, late).groupBy(F.window("ts", tick).alias("w"), "node")
    return grouped.agg(F.count("*").alias("pulses"), F.sum("k").alias("load")).select("node", F.col("w.start").alias("tick"), "pulses", "load")


def silences(pulses: DataFrame, dead: str = "8 hours", late: str = "1 day") -> DataFrame:
    """Runs of pulses without a silence of `dead`: a run that closed is a node that was given up at `lost_at`."""
    grouped = _timed(pulses, late).groupBy(F.session_window("ts", dead).alias("w"), "node")
    return grouped.agg(F.count("*").alias("pulses")).select("node", F.col("w.start").alias("since"), F.col("w.end").alias("lost_at"), "pulses")
