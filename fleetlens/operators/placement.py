"""Performance profiles of task types and variants, and where a list of candidates ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.fleet import latency_bucket
from fleetlens.operators.aggregates import ewma, histogram_quantiles
from fleetlens.operators.scheduling import with_required_bits

KEYS = ["task_type", "variant_id", "input_bucket"]


def profiles(observations: DataFrame) -> DataFrame:
    """Samples, histogram quantiles, failure share and peak memory by task type, variant and input bucket: observations are read
    once, for a row of each key and latency bucket."""
    bucket = latency_bucket(F.col("latency_ticks"))
    counts = observations.groupBy(*KEYS, bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if("failed").alias("failures"), F.max("peak_memory_bytes").alias("peak"))
    more = [(F.sum("failures") / F.sum("n")).alias("failure"), F.max("peak").alias("peak_memory_bytes")]
    return histogram_quantiles(counts, KEYS, [50, 95, 99], more)


def predictions(observations: DataFrame, samples: int) -> DataFrame:
    """profiles() with the moving average, throughput, and doubt: the share of `samples` that is missing."""
    average = ewma(observations, KEYS, F.col("latency_ticks"), [F.desc("ts"), F.desc("event_id")], 0.2, None, 200, "ewma").drop("samples")
    doubt = F.greatest(F.lit(samples) - F.col("samples"), F.lit(0)) / float(samples)
    rows = profiles(observations).join(average, KEYS)
    return rows.withColumn("throughput", 1 / F.greatest(F.col("ewma"), F.lit(2.220446049250313e-16))).withColumn("doubt", doubt)


def eligible(needs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Healthy nodes with all required bits, for each distinct requirement, by the inverted index of bits."""
    return with_required_bits(needs, nodes.where("healthy"))


def first_outcome(tried: DataFrame, fallbacks: int) -> DataFrame:
    """Where each task's list of candidates ends: at the first one that isn't rejected, among the first fallbacks + 1."""
    final = F.when(F.col("outcome") != "rejected", F.struct("rank", "outcome"))
    ended = tried.where(F.col("rank") <= fallbacks + 1).groupBy("task_id").agg(F.min(final).alias("x"))
    return ended.select("task_id", F.coalesce("x.rank", F.lit(0)).alias("ended_at"), F.coalesce("x.outcome", F.lit("exhausted")).alias("outcome"))
