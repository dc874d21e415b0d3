"""Benchmark reports: merged samples, use of resources over runs, throughput ratios and rotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.aggregates import distribution, median, null_safe


def merge(samples: DataFrame, keys: list[str], latency: str, medians: dict[str, str] | None = None, more: list[Column] | None = None) -> DataFrame:
    """A row for each case: the distribution of all its samples, whatever the run; medians: result name to the column whose exact
    median it is; more: further aggregates of the samples."""
    out = distribution(samples, keys, latency)
    for name, column in (medians or {}).items():
        out = null_safe(out, median(samples, keys, column, name).drop("n"), keys)
    return null_safe(out, samples.groupBy(*keys).agg(*more), keys) if more else out


def throughput(units: Column, spent: Column) -> Column:
    """Units a second of nanoseconds, of which there is one at least."""
    return units * 1e9 / F.greatest(F.lit(1.0), spent)


def merge_placement(decisions: DataFrame) -> DataFrame:
    """Placement cases (case_id, workload, latency_class, nodes, variants, top_k; decision_ns, evaluated): latency, and the median
    number of candidates that were evaluated."""
    keys = ["case_id", "workload", "latency_class", "nodes", "variants", "top_k"]
    return merge(decisions, keys, "decision_ns", {"evaluated": "evaluated"})


def merge_registry(reports: DataFrame) -> DataFrame:
    """Registry cases by acceptance and mutations of whole reports (mutation_ns, compact_ns, reopen_ns, snapshot_bytes, committed,
    log_present, first_present, last_present): latency, stage medians, disk, throughput and what was lost."""
    keys = ["acceptance", "mutations"]
    lost = [F.count_if(F.col("committed") != F.col("mutations")).alias("lost_mutations"), F.count_if(~F.col("log_present")).alias("missing_log"), F.count_if(~(F.col("first_present") & F.col("last_present"))).alias("missing_tasks")]
    out = merge(reports, keys, "mutation_ns", {"compact_median_ns": "compact_ns", "reopen_median_ns": "reopen_ns"}, [F.max("snapshot_bytes").alias("disk_bytes"), *lost])
    return out.withColumn("per_second", throughput(F.col("mutations"), F.col("median")))


def merge_windows(windows: DataFrame, most: int = 10_000) -> DataFrame:
    """Windows of mutations (acceptance, mutations, window_ns, window_mutations) of reports of up to `most`: their jitter. valid is
    false for a case whose windows aren't all of one size."""
    keys = ["acceptance", "mutations"]
    out = merge(windows.where(F.col("mutations") <= most), keys, "window_ns", None, [F.min("window_mutations").alias("window_mutations"), F.max("window_mutations").alias("largest")])
    jitter = F.col("mad") / F.greatest(F.lit(1.0), F.col("median"))
    return out.withColumns({"valid": F.col("window_mutations") == F.col("largest"), "jitter": jitter, "steady": (F.col("n") < 3) | (jitter <= 0.10)}).drop("largest")


def merge_content(samples: DataFrame, memory: int) -> DataFrame:
    """Content cases (lane, content_bytes, aggregate_bytes, concurrency, name; elapsed): the fixed-total lane has names of its own;
    pressure is the share of `memory` that all transfers take."""
    name = F.when(F.col("lane") == "fixed-total-scaling", F.replace("name", F.lit("content.localization."), F.lit("content.localization.fixed-total."))).otherwise(F.col("name"))
    out = merge(samples, ["lane", "content_bytes", "aggregate_bytes", "concurrency", "name"], "elapsed")
    return out.withColumns({"case_id": name, "pressure": F.col("aggregate_bytes") / float(max(1, memory)), "per_second": throughput(F.col("aggregate_bytes"), F.col("median"))})


def merge_faults(transitions: DataFrame) -> DataFrame:
    """Durability cases by fault stage (transition_ns, reopen_ns): latency of the transition, and the median time to reopen."""
    named = F.concat(F.lit("distributed.durability."), F.translate("stage", "_", "-"))
    return merge(transitions, ["stage"], "transition_ns", {"reopen_median_ns": "reopen_ns"}).withColumn("case_id", named)


def most_used(samples: DataFrame, keys: list[str], roles: list[str]) -> DataFrame:
    """keys and peak: each role's largest use over the runs, summed over the roles."""
    return samples.groupBy(*keys).agg(sum((F.max(r) for r in roles), F.lit(0)).alias("peak"))


def scaling(samples: DataFrame, keys: list[str], work: str, spent: str, few: int, many: int, least: float, evaluated_from: int) -> DataFrame:
    """keys, low and high (exact median throughput at either concurrency), their ratio, and passed: judged from `evaluated_from` of
    work on."""
    rows = samples.withColumn("speed", throughput(F.col(work), F.col(spent)))
    speeds = median(rows.where(F.col("concurrency").isin(few, many)), [*keys, "concurrency"], "speed", "speed")
    at = lambda c: F.max(F.when(F.col("concurrency") == c, F.col("speed")))
    wide = null_safe(rows.groupBy(*keys).agg(F.max(work).alias("work")), speeds.groupBy(*keys).agg(at(few).alias("low"), at(many).alias("high")), keys, "left")
    ratio = F.col("high") / F.greatest(F.lit(1.0), F.col("low"))
    evaluated = F.col("work") >= evaluated_from
    passed = F.col("low").isNotNull() & F.col("high").isNotNull() & (~evaluated | (ratio >= least))
    return wide.select(*keys, "low", "high", ratio.alias("ratio"), F.coalesce(passed, F.lit(False)).alias("passed"))


def rotated(values: Column, offset: Column) -> Column:
    """The list from its place offset (modulo its length) on, and then what stood before it."""
    at = F.when(F.size(values) > 0, F.pmod(offset, F.size(values))).otherwise(0).cast("int")
    return F.when(F.size(values) > 0, F.concat(F.slice(values, at + 1, F.greatest(F.size(values), F.lit(1))), F.slice(values, F.lit(1), at))).otherwise(values)


def classify(cases: DataFrame, keys: list[str]) -> DataFrame:
    """keys and classification of cases (faults: a number, regressed and noisy: yes or no): correctness first, then the fixed gates,
    then noise of most cases or of some."""
    sums = cases.groupBy(*keys).agg(F.sum("faults").alias("faults"), F.bool_or("regressed").alias("regressed"), F.avg(F.col("noisy").cast("double")).alias("share"), F.bool_or("noisy").alias("any"))
    label = F.when(F.col("faults") > 0, "framework_suspect").when(F.col("regressed"), "regression").when(F.col("share") > 0.20, "environmental").when(F.col("any"), "case_specific").otherwise("none")
    return sums.select(*keys, label.alias("classification"))
