"""Histograms, quantiles, moving averages and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.fleet import bit_length_bucket, latency_bucket


def latency_histogram(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys, latency_bucket(F.col(value)).alias("bucket")).agg(F.count("*").alias("n"))


def histogram_quantiles(histogram: DataFrame, keys: list[str], percents: list[int], more: list[Column] | None = None) -> DataFrame:
    """Upper bound of the first bucket whose running count reaches max(1, ceil(n * p / 100)); a window of 32 rows a key. more:
    further aggregates of the buckets."""
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    rows = histogram.withColumn("upto", upto).withColumn("total", total)
    quantile = lambda p: F.pow(F.lit(2.0), F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("total") * p / 100)), F.col("bucket")))).alias(f"p{p}")
    return rows.groupBy(*keys).agg(F.max("total").alias("samples"), *[quantile(p) for p in percents], *(more or []))


def ewma(rows: DataFrame, keys: list[str], value: Column, newest_first: list[Column], alpha: float, seed: float | None, depth: int, name: str) -> DataFrame:
    """Exponential moving average after the last row, in closed form over each key's `depth` newest rows.

    Older rows weigh less than (1 - alpha)^depth, below a double's precision at a fitting depth, so that the rank
    filter prunes before the shuffle and a hot key sends a bounded number of rows. Without a seed the first row seeds.
    """
    at = Window.partitionBy(*keys).orderBy(*newest_first)
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    ranked = rows.select(*keys, value.cast("double").alias("x"), F.row_number().over(at).alias("age")).where(F.col("age") <= depth)
    keep = F.pow(F.lit(1 - alpha), F.col("age") - 1)
    joined = ranked.join(n, keys)
    weight = F.when((F.col("age") == F.col("n")), keep).otherwise(F.lit(alpha) * keep) if seed is None else F.lit(alpha) * keep
    out = joined.groupBy(*keys).agg(F.max("n").alias("samples"), F.sum(F.col("x") * weight).alias(name))
    return out if seed is None else out.withColumn(name, F.col(name) + F.lit(seed) * F.pow(F.lit(1 - alpha), F.col("samples")))


def ranked_values(rows: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """keys, n and, for each of places (a 0-based place in terms of n), the exact value at it among the key's sorted ones.

    Two levels, so that a key's values never meet in one task: counts by ranges of values (an exponent and a few bits, so a key
    has a bounded number) tell which range holds a place, and only the distinct values of that range are ranked.
    """
    v = F.col(value).cast("double")
    counts = rows.where(v.isNotNull()).groupBy(*keys, v.alias("v")).agg(F.count("*").alias("c")).withColumn("part", part_of("v"))
    ranges = counts.groupBy(*keys, "part").agg(F.sum("c").alias("c"))
    at = Window.partitionBy(*keys).orderBy("part")
    ranges = ranges.withColumns({"below": F.sum("c").over(at) - F.col("c"), "n": F.sum("c").over(Window.partitionBy(*keys))})
    asked = ranges.withColumn("place", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), p.cast("long").alias("at")) for name, p in places.items()])))
    asked = asked.where((F.col("place.at") >= F.col("below")) & (F.col("place.at") < F.col("below") + F.col("c")))
    wanted = asked.groupBy(*keys, "part", "below", "n").agg(F.collect_list("place").alias("wanted"))
    near = null_safe(counts, wanted, [*keys, "part"])
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(*keys, "part").orderBy("v"))
    hits = near.withColumn("upto", upto).withColumn("w", F.explode("wanted")).where((F.col("w.at") < F.col("upto")) & (F.col("w.at") >= F.col("upto") - F.col("c")))
    return hits.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("w.name") == name, F.col("v"))).alias(name) for name in places])


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on keys in which nulls are equal; the keys are left's."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(F.col(f"_right_{k}"))
    return left.join(named, on, how).drop(*[f"_right_{k}" for k in keys])


def part_of(value: str) -> Column:
    """An ascending number for ranges of values: sixty-four to a doubling, either side of zero; infinities and, last, NaN have
    their own."""
    v = F.col(value)
    fine = F.floor(F.log2(F.abs(v)) * 64) + 100_000
    odd = F.when(F.isnan(v), F.lit(3_000_000)).when(v == float("inf"), F.lit(2_000_000)).when(v == float("-inf"), F.lit(-2_000_000)).when(v == 0, F.lit(0))
    return odd.when(v < 0, -fine).otherwise(fine).cast("long")


def nearest_rank(percent: int) -> Column:
    """The 0-based place of a nearest-rank percentile among n."""
    return F.greatest(F.ceil(F.col("n") * percent / 100) - 1, F.lit(0))


def median(rows: DataFrame, keys: list[str], value: str, name: str, more: dict[str, Column] | None = None) -> DataFrame:
    """keys, n and the median (the mean of the middle two) under `name`; more: further places by their names."""
    middle = {"m_low": F.floor((F.col("n") - 1) / 2), "m_high": F.floor(F.col("n") / 2)}
    out = ranked_values(rows, keys, value, {**middle, **(more or {})})
    return out.withColumn(name, (F.col("m_low") + F.col("m_high")) / 2).drop("m_low", "m_high")


def distribution(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact min, median, max, median absolute deviation and nearest-rank p95 and p99."""
    centre = median(rows, keys, value, "median", {"p95": nearest_rank(95), "p99": nearest_rank(99), "least": F.lit(0), "most": F.col("n") - 1})
    far = null_safe(rows.select(*keys, value), centre.select(*keys, "median"), keys).withColumn("far", F.abs(F.col(value) - F.col("median")))
    return null_safe(centre, median(far, keys, "far", "mad").drop("n"), keys)


def indexed_percentile(rows: DataFrame, keys: list[str], value: str, percent: int) -> DataFrame:
    """The value at index (n - 1) * percent // 100 of the sorted ones."""
    return ranked_values(rows, keys, value, {f"i{percent}": F.floor((F.col("n") - 1) * percent / 100)})


def bit_length_histogram(rows: DataFrame, value: Column) -> DataFrame:
    return rows.select(value.cast("long").alias("v")).groupBy(bit_length_bucket(F.col("v")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.max("v").alias("most"))


def noise_class(summary: DataFrame, gate: Column) -> DataFrame:
    """none, case_specific or environmental from mad/median > 0.10 and the share of such cases > 0.20."""
    noisy = F.col("mad") / F.col("median") > 0.10
    rows = summary.withColumn("noisy", noisy)
    share = rows.agg(F.avg(F.col("noisy").cast("double")).alias("share"))
    joined = rows.join(F.broadcast(share))
    return joined.withColumn("noise", F.when(~gate, "gate_failed").when(F.col("share") > 0.20, "environmental").when(F.col("noisy"), "case_specific").otherwise("none")).drop("share", "noisy")


def median_of_most(rows: DataFrame, keys: list[str], run: list[str], value: str) -> DataFrame:
    """The largest value of each run, and the median over the runs."""
    most = rows.groupBy(*keys, *run).agg(F.max(value).alias("most"))
    return median(most, keys, "most", "median_of_most").drop("n")
