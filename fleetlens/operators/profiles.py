"""Performance profiles as mergeable states: written a day at a time, merged on read.

A day's state of a key is its latency histogram (32 counts), its number of observations and failures, its largest memory, its
first latency and its moving average as an affine map: after n observations an average that was `a` is keep * a + moved, with
keep = (1 - ALPHA)^n. Histograms, counts and maxima merge in any order; maps are applied in the order of days, beginning with
the first latency of all, which seeds the average. So a late day is written again by itself, and nothing else is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.aggregates import ewma, histogram_quantiles, latency_histogram
from fleetlens.operators.placement import KEYS

ALPHA = 0.2
#: Observations beyond so many newest ones of a day weigh less than a double's precision.
DEPTH = 200
STATE = "task_type string, variant_id string, input_bucket long, histogram map<int,bigint>, samples long, failures long, peak_memory_bytes long, first double, keep double, moved double, day date"


def day_states(observations: DataFrame) -> DataFrame:
    """STATE of each key and day of observations (KEYS, latency_ticks, peak_memory_bytes, failed, ts, event_id)."""
    rows = observations.withColumn("day", F.to_date("ts"))
    keys = [*KEYS, "day"]
    counts = latency_histogram(rows, keys, "latency_ticks").groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "n")))).alias("histogram"))  # 32 at most
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if("failed").alias("failures"), F.max("peak_memory_bytes").alias("peak_memory_bytes"),
        F.min_by(F.col("latency_ticks").cast("double"), F.struct("ts", "event_id")).alias("first"),
    )
    moved = ewma(rows, keys, F.col("latency_ticks"), [F.desc("ts"), F.desc("event_id")], ALPHA, 0.0, DEPTH, "moved").select(*keys, "moved")
    out = counts.join(sums, keys).join(moved, keys).withColumn("keep", F.pow(F.lit(1 - ALPHA), F.col("samples")))
    return out.select(*[c.split()[0] for c in STATE.split(", ")])


def merged(states: DataFrame) -> DataFrame:
    """KEYS, samples, failures, peak_memory_bytes, ewma and buckets (bucket, n) of all days of each key: a row for each day meets."""
    days = F.array_sort(F.collect_list(F.struct("day", "first", "keep", "moved")))
    sums = states.groupBy(*KEYS).agg(F.sum("samples").alias("samples"), F.sum("failures").alias("failures"), F.max("peak_memory_bytes").alias("peak_memory_bytes"), days.alias("days"))
    return sums.withColumn("ewma", average(F.col("days"))).drop("days")


def average(days: Column) -> Column:
    return F.aggregate(days, F.get(days, F.lit(0))["first"], lambda a, d: d["keep"] * a + d["moved"])


def predictions(states: DataFrame, samples: int) -> DataFrame:
    """What placement.predictions() gives of all observations, from the states of days."""
    buckets = states.select(*KEYS, F.explode("histogram").alias("bucket", "n")).groupBy(*KEYS, "bucket").agg(F.sum("n").alias("n"))
    quantiles = histogram_quantiles(buckets, KEYS, [50, 95, 99]).drop("samples")
    out = quantiles.join(merged(states), KEYS)
    doubt = F.greatest(F.lit(samples) - F.col("samples"), F.lit(0)) / float(samples)
    out = out.withColumns({"failure": F.col("failures") / F.col("samples"), "throughput": 1 / F.greatest(F.col("ewma"), F.lit(2.220446049250313e-16)), "doubt": doubt})
    return out.select(*KEYS, "samples", "p50", "p95", "p99", "failure", "ewma", "peak_memory_bytes", "throughput", "doubt")


class StoredProfiles:
    """States of days under a path, one folder for each day."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, observations: DataFrame) -> None:
        """Replace the days that observations hold, with all of these days' observations."""
        states = day_states(observations)
        states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(STATE).parquet(self.path)
