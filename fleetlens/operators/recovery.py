"""Recovery: what a failed attempt becomes, session migration, checkpoint lineage, mirrors and restarts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.fleet import backoff
from fleetlens.operators.folds import fold
from fleetlens.operators.places import places


def restart_safe(mobility: Column, retry: Column) -> Column:
    return mobility.isin("restartable", "checkpointable") & retry.isin("idempotent", "verifiable", "compensatable")


def plan(rows: DataFrame, runners: Column, minimum_quality: float, base: int, most: int) -> DataFrame:
    """rows with action, attempt and not_before. runners: array of (runner_id, generation, plugin), of which the first that has the
    wanted generations of both runs the task; a hint must name it. The next attempt follows the last one's number, which may
    be higher than the number of attempts."""
    runner = F.get(F.filter(runners, lambda r: (r["generation"] == F.col("wanted_runner")) & (r["plugin"] == F.col("wanted_plugin"))), F.lit(0))
    rows = rows.withColumn("runner", runner["runner_id"]).withColumn("attempt", F.coalesce(F.col("last_attempt") + 1, F.lit(1)).cast("long"))
    usable = (F.col("quality") >= minimum_quality) & F.col("eligible") & F.col("inputs_recoverable")
    by_tier = (
        F.when(F.col("tier") == "ephemeral", "fail").when(F.col("tier") == "restartable", F.when(restart_safe(F.col("mobility"), F.col("retry")), "restart").otherwise("review"))
        .when(F.col("tier") == "checkpointed", F.when(F.col("has_checkpoint") & F.col("checkpoint_fits"), "restore_checkpoint").otherwise("review"))
        .when(F.col("tier") == "mirrored", F.when(F.col("has_standby"), "promote_standby").otherwise("review")).otherwise("review")
    )
    action = (
        F.when(F.col("failure").isin("suspect", "speculative") & ~F.col("allow_speculative"), "wait").when(F.coalesce(F.col("now_tick") >= F.col("deadline"), F.lit(False)), "fail")
        .when(F.col("attempts") >= F.col("max_attempts"), "fail").when(~usable, "fail").when(F.col("runner").isNull(), "fail")
        .when(F.col("hint").isNotNull() & (F.col("hint") != F.col("runner")), "fail").otherwise(by_tier)
    )
    rows = rows.withColumn("action", action)
    starts = F.col("action").isin("restart", "restore_checkpoint")
    return rows.withColumn("not_before", F.when(starts, F.col("now_tick") + backoff(F.col("attempt"), base, most))).withColumn("attempt", F.when(starts, F.col("attempt")))


def migration(leader_only: Column, dead: Column, standby: Column, has_checkpoint: Column, benefit: Column, cost: Column) -> Column:
    """What becomes of a session: a change of leader alone moves nothing; a dead worker's goes to the standby or a checkpoint;
    a live one moves if that pays."""
    lost = F.when(standby.isNotNull(), "promote_standby").when(has_checkpoint, "migrate").otherwise("degrade")
    return F.when(leader_only, "stay").when(dead, lost).when(benefit > cost, "migrate").otherwise("stay")


def lineage(checkpoints: DataFrame, key: str, order: list[str], same: list[str]) -> DataFrame:
    """checkpoints with fits: a baseline stands alone; another needs one before it with a smaller sequence and equal `same`,
    which is a baseline itself or follows one."""
    at = Window.partitionBy(key).orderBy(*order)
    before = lambda c: F.lag(c).over(at)
    follows = before("sequence").isNotNull() & (before("sequence") < F.col("sequence")) & (before("baseline") | F.lag("sequence", 2).over(at).isNotNull())
    for c in same:
        follows = follows & (before(c) == F.col(c))
    return checkpoints.withColumn("fits", F.col("baseline") | F.coalesce(follows, F.lit(False)))


@dataclass(frozen=True)
class CheckpointBudget:
    """Of one store: bytes of a checkpoint, bytes uploaded in all, and checkpoints persisted."""

    checkpoint_bytes: int
    uploaded_bytes: int
    operations: int


PERSISTED = "event_id long, outcome string, uploaded long, baseline string, previous string, changed array<int>"


def persist_checkpoints(rows: DataFrame, keys: list[str], order: list[str], same: list[str], budget: CheckpointBudget) -> DataFrame:
    """event_id, outcome (baseline, incremental, incompatible or budget_exceeded), bytes uploaded, and the manifest of each checkpoint:
    the baseline's and the previous content, and the indexes of the chunks that differ from the previous one.

    rows: sequence, attempt, generation, baseline (start anew), content and chunks (array of struct<digest, size>) in the order
    in which a store (keys) persists them. One that isn't a baseline follows the last one persisted, with a larger sequence and
    equal `same`. Only chunks that the store doesn't hold are uploaded; a budget that would be exceeded turns the checkpoint
    away, and nothing of it stays. The budget of uploads bounds the digests that the state remembers.
    """

    def step(s: dict, r: dict) -> tuple:
        chunks = [(c["digest"], c["size"]) for c in r["chunks"] or []]
        fresh = {d: n for d, n in chunks if d not in s["held"]}
        upload, last = sum(fresh.values()), s["last"]
        refused = lambda why: (r["event_id"], why, 0, None, None, None)
        if not r["attempt"] or not r["generation"]:
            return refused("incompatible")
        if s["operations"] >= budget.operations or sum(n for _, n in chunks) > budget.checkpoint_bytes or s["uploaded"] + upload > budget.uploaded_bytes:
            return refused("budget_exceeded")
        if not r["baseline"] and (last is None or r["sequence"] <= last["sequence"] or any(r[c] != last[c] for c in same)):
            return refused("incompatible")
        s["held"].update(fresh)
        s["uploaded"], s["operations"], s["last"] = s["uploaded"] + upload, s["operations"] + 1, {**r, "pairs": chunks}
        if r["baseline"]:
            s["root"] = r["content"]
            return r["event_id"], "baseline", upload, r["content"], None, list(range(len(chunks)))
        changed = [i for i, c in enumerate(chunks) if i >= len(last["pairs"]) or last["pairs"][i] != c]
        return r["event_id"], "incremental", upload, s["root"], last["content"], changed

    return fold(rows, keys, order, lambda: dict(held={}, uploaded=0, operations=0, last=None, root=None), step, PERSISTED)


@dataclass(frozen=True)
class MirrorBudget:
    sessions: int
    compute: int
    memory: int
    network: int


def mirror_admission(rows: DataFrame, keys: list[str], order: list[str], budget: MirrorBudget) -> DataFrame:
    """host, seq, outcome and sessions held after each admission or release; only critical sessions are mirrored, each once."""

    def step(live: dict, r: dict) -> tuple:
        name = r["session_id"]
        if r["op"] == "release":
            outcome = "released" if live.pop(name, None) else "unknown"
        elif not r["critical"] or name in live:
            outcome = "refused"
        else:
            asked = (r["compute"], r["memory"], r["network"])
            used = [sum(x[k] for x in live.values()) for k in range(3)]
            full = len(live) >= budget.sessions or any(u + a > m for u, a, m in zip(used, asked, (budget.compute, budget.memory, budget.network)))
            outcome = "exhausted" if full else "admitted"
            if not full:
                live[name] = asked
        return r["host"], r["seq"], outcome, len(live)

    return fold(rows, keys, order, dict, step, "host long, seq long, outcome string, sessions long")


def restarts(attempts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per task: the next attempt, and where it goes: the first node (by id) that hasn't tried the task, else local.

    A task has tried few nodes, so its place among the sorted ids is found by counting them, without pairing tasks and nodes.
    """
    ids = places(nodes.select(F.col("idx").alias("node")), [], ["node"], 100_000).select("node", (F.col("place") + 1).alias("place"))
    tried = attempts.select("task_id", "node").distinct().join(ids, "node")
    ranked = tried.withColumn("seen", F.row_number().over(Window.partitionBy("task_id").orderBy("place")))
    # The tried nodes that fill the first places without a gap; the one after them is free.
    filled = ranked.groupBy("task_id").agg(F.count_if(F.col("place") == F.col("seen")).alias("filled"))
    last = attempts.groupBy("task_id").agg(F.max("attempt").alias("last"))
    out = last.join(filled, "task_id", "left").withColumn("place", F.coalesce("filled", F.lit(0)) + 1).join(ids.withColumnRenamed("node", "target"), "place", "left")
    return out.select("task_id", (F.col("last") + 1).alias("attempt"), F.col("target").alias("node"))
