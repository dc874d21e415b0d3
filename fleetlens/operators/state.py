"""Event-sourced state: budgets, silences, fencing, windows and grants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.folds import fold
from fleetlens.operators.places import ROWS_A_BLOCK, Machine, block_fold, places


def tick_budget(rows: DataFrame, tick: Column, cost: str, order: list[str], limit: float) -> DataFrame:
    """Per tick, cost admitted while the running sum stays within the limit; what is rejected isn't charged."""

    def step(s: dict, r: dict) -> None:
        s["offered"] += 1
        if s["used"] + r["cost"] <= limit:
            s["used"] += r["cost"]

    asked = rows.select(F.unix_micros(tick.cast("timestamp")).alias("tick"), *order, F.col(cost).cast("double").alias("cost"))
    used = fold(asked, ["tick"], order, lambda: dict(offered=0, used=0.0), step, "tick long, offered long, used double", lambda key, s: [(*key, s["offered"], s["used"])])
    return used.withColumn("tick", F.timestamp_micros("tick").cast("timestamp_ntz"))


def failure_timeline(pulses: DataFrame, suspect_s: int, dead_s: int) -> DataFrame:
    """Silences of each node until its next pulse: how many made it suspect or dead, and the longest."""
    following = F.lead("ts").over(Window.partitionBy("node").orderBy("ts", "event_id"))
    gaps = pulses.withColumn("gap", F.unix_micros(following.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")))
    second = 1_000_000
    return gaps.groupBy("node").agg(
        F.count("*").alias("pulses"), F.count_if((F.col("gap") >= suspect_s * second) & (F.col("gap") < dead_s * second)).alias("suspects"),
        F.count_if(F.col("gap") >= dead_s * second).alias("deaths"), F.max("gap").alias("longest_us"),
    )


def active_attempts(attempts: DataFrame) -> DataFrame:
    """The last active attempt of each task; an aggregate of structs, so no key's rows are sorted."""
    return attempts.where("active").groupBy("task_id").agg(F.max(F.struct("attempt", "node")).alias("x")).select("task_id", "x.attempt", "x.node")


def fence(results: DataFrame, active: DataFrame) -> DataFrame:
    """Results with accepted: attempt and node are the active ones."""
    now = active.select("task_id", F.col("attempt").alias("a_attempt"), F.col("node").alias("a_node"))
    same = (F.col("attempt") == F.col("a_attempt")) & (F.col("node") == F.col("a_node"))
    return results.join(now, "task_id", "left").withColumn("accepted", F.coalesce(same, F.lit(False))).drop("a_attempt", "a_node")


def count_windows(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """rows with batch: their key's fixed windows of `size` rows, the last of which may be short."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("batch", F.floor((number - 1) / size))


def dwell(rows: DataFrame, key: str, order: list[str], candidate: Column, over: Column, ticks: int) -> DataFrame:
    """rows with due: the same candidate has been over the margin for `ticks` observations; a miss or a change restarts."""
    at = Window.partitionBy(key).orderBy(*order)
    rows = rows.withColumn("tick", F.row_number().over(at)).withColumn("over", over).withColumn("candidate", candidate)
    goes_on = F.col("over") & F.coalesce(F.lag("over").over(at), F.lit(False)) & F.coalesce(F.lag("candidate").over(at) == F.col("candidate"), F.lit(False))
    rows = rows.withColumn("cut", F.when(~goes_on, F.col("tick")))
    start = F.max("cut").over(at.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("due", F.col("over") & (F.col("tick") - start >= ticks)).drop("tick", "over", "candidate", "cut")


#: Pressure in hundredths: the average of pressures up to 100 stays within 0 to 10,000.
SCALED = 10_000


def pressure_machine(emit) -> Machine:
    """The truncating integer average over pulses (p: pressure, taken as 0 to 100)."""
    return Machine(SCALED + 1, 0, lambda s, r: (8 * s + 200 * min(100, max(0, r["p"] or 0))) // 10, emit)


def integer_pressure(pulses: DataFrame, key: str, order: list[str], value: str, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """Pressure of each key after its last pulse: truncating integer average in hundredths, rounded and at most 100. A busy
    key's pulses are dealt over tasks."""
    rows = places(pulses.select(key, *order, F.col(value).cast("long").alias("p")), [key], order, rows_a_block)
    after = pressure_machine(lambda before, now, r: (r[key], min(100, (now + 50) // 100)) if r["place"] == r["total"] - 1 else None)
    return block_fold(rows, [key], ["place"], after, f"{key} {rows.schema[key].dataType.simpleString()}, pressure long", rows_a_block)


def latest_grants(log: DataFrame) -> DataFrame:
    """The last grant of each task: attempt, node and until."""
    return log.groupBy("task_id").agg(F.max(F.struct("attempt", "node", "until")).alias("g")).select("task_id", "g.*")


def grant_verdict(tick: Column) -> Column:
    """accepted, or why not, of a result (attempt, node) at `tick` under the grant that was in force (g_attempt, g_node, until)."""
    same = (F.col("attempt") == F.col("g_attempt")) & (F.col("node") == F.col("g_node"))
    return F.when(F.col("g_attempt").isNull(), "fenced").when(tick > F.col("until"), "grant_expired").when(F.coalesce(same, F.lit(False)), "accepted").otherwise("fenced")


def validate_results(results: DataFrame, grants: DataFrame, now: float) -> DataFrame:
    """results with verdict: an expired grant goes before a fenced attempt or node; without a grant all are fenced."""
    held = grants.select("task_id", F.col("attempt").alias("g_attempt"), F.col("node").alias("g_node"), "until")
    same = (F.col("attempt") == F.col("g_attempt")) & (F.col("node") == F.col("g_node"))
    verdict = F.when(F.col("until") <= now, "grant_expired").when(same, "accepted").otherwise("fenced")
    return results.join(held, "task_id", "left").withColumn("verdict", verdict).drop("g_attempt", "g_node", "until")
