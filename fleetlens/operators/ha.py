"""High availability: failure detection by versioned pulses, leadership, elections and what may go on without a quorum."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.folds import fold


@dataclass(frozen=True)
class Detector:
    suspect: int = 8
    dead: int = 20
    active: int = 2
    stable: int = 30


def next_pulse(health: Column, pressure: Column, detector: Detector) -> Column:
    """Ticks until the next pulse: long while nothing is wrong, or while more pulses would only add load."""
    calm = ((health == "healthy") & (pressure == 0)) | health.isin("overloaded", "draining")
    return F.when(calm, detector.stable).otherwise(detector.active)


DETECTED = "event_id long, before string, disposition string, health string, pressure long"
#: A member between rows: what it said last, at which tick it was heard (tick) and at which its health last changed (since).
MEMBER = "health string, capability_version long, resource_version long, tick long, since long, pressure long"


def unseen() -> dict:
    """A member before its first registration."""
    return dict(health=None, capability_version=None, resource_version=None, tick=0, since=0, pressure=None)


def next_lapse(s: dict, detector: Detector) -> tuple[int, str] | None:
    """The tick at which a member that stays silent changes its health next, and to what. A pulse of another version doesn't
    end a silence: it holds until the tick after it only."""
    if s["health"] is None or s["health"] == "dead":
        return None
    suspect, dead = (max(s["tick"] + after, s["since"] + 1) for after in (detector.suspect, detector.dead))
    return (suspect, "suspect") if s["health"] != "suspect" and suspect < s["tick"] + detector.dead else (dead, "dead")


def lapses(s: dict, now: int, detector: Detector) -> list[tuple[int, str]]:
    """The changes of health by silence until tick `now`, oldest first; s goes along."""
    out = []
    while (due := next_lapse(s, detector)) and due[0] <= now:
        s["since"], s["health"] = due
        out.append(due)
    return out


def hear(s: dict, r: dict) -> str:
    """A registration or pulse (op, capability_version, resource_version, health, pressure, tick) and what becomes of it."""
    versions = (r["capability_version"], r["resource_version"])
    if r["op"] == "register":
        if 0 in versions or None in versions:
            return "invalid"
        disposition = "registered"
        s.update(capability_version=versions[0], resource_version=versions[1])
    elif s["health"] is None:
        return "unknown"
    elif versions != (s["capability_version"], s["resource_version"]):
        s.update(health="incompatible", since=r["tick"])
        return "full_snapshot_required"
    else:
        disposition = "accepted"
    s.update(health=r["health"], tick=r["tick"], since=r["tick"], pressure=r["pressure"])
    return disposition


def observe(detector: Detector):
    """The step of a member's state by a registration or pulse; gives a row of DETECTED."""

    def step(s: dict, r: dict) -> tuple:
        lapses(s, r["tick"], detector)
        before = s["health"]
        return r["event_id"], before, hear(s, r), s["health"], s["pressure"]

    return step


def detect(rows: DataFrame, keys: list[str], order: list[str], detector: Detector = Detector()) -> DataFrame:
    """event_id, before (health when the row comes, after the silence until then), disposition, and health and pressure after.

    A pulse of other versions makes the member incompatible and doesn't end its silence; an accepted one restores any state. A
    registration without versions is invalid.
    """
    return fold(rows, keys, order, unseen, observe(detector), DETECTED)


def changes(keys: list[str], detector: Detector):
    """The step that gives a row (keys, tick, health, cause) for every change of a member's health, silences at their tick."""

    def step(s: dict, r: dict) -> list[tuple]:
        key = tuple(r[k] for k in keys)
        out = [(*key, *due, "silence") for due in lapses(s, r["tick"], detector)]
        before, cause = s["health"], hear(s, r)
        return out + [(*key, r["tick"], s["health"], cause)] * (s["health"] != before)

    return step


def timeline_schema(rows: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", tick long, health string, cause string"


def timeline(rows: DataFrame, keys: list[str], order: list[str], until: int, detector: Detector = Detector()) -> DataFrame:
    """keys, tick, health and cause (a disposition or silence) of every change of a member's health until the tick `until`, also
    of members that are never heard again."""
    finish = lambda key, s: [(*key, *due, "silence") for due in lapses(s, until, detector)]
    return fold(rows, keys, order, unseen, changes(keys, detector), timeline_schema(rows, keys), finish)


def leader_score(capacity: Column, p95: Column, sleep_risk: Column, healthy: Column, trusted: Column) -> Column:
    return F.when(healthy & trusted, capacity - p95 - sleep_risk * 100)


def leader_transfers(rows: DataFrame, keys: list[str], order: list[str], margin: float, dwell: int) -> DataFrame:
    """event_id and transfer: the same candidate has been better by the margin for `dwell` ticks, or the leader has no score
    and the candidate has one. A miss, or another candidate, starts anew; rows without a leader's score interrupt nothing."""
    alone = F.col("current_score").isNull()
    over = F.col("candidate_score").isNotNull() & ~alone & ~(F.col("candidate_score") < F.col("current_score") + margin)
    at = Window.partitionBy(*keys, "_alone").orderBy(*order)
    marked = rows.withColumns({"_alone": alone, "_over": over})
    goes_on = F.col("_over") & F.coalesce(F.lag("_over").over(at), F.lit(False)) & F.lag("candidate").over(at).eqNullSafe(F.col("candidate"))
    marked = marked.withColumn("_goes_on", goes_on)
    since = F.max(F.when(F.col("_over") & ~F.col("_goes_on"), F.col("tick"))).over(at.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    due = F.col("_goes_on") & (F.col("tick") - since >= dwell)
    return marked.select("event_id", F.when(F.col("_alone"), F.col("candidate_score").isNotNull()).otherwise(due).alias("transfer"))


def availability(voters: int) -> Column:
    """Class of what an observer sees: alive, reachable voters, whether it leads, a grant of its own, a leader and a way there."""
    quorum = voters // 2 + 1
    reachable = F.col("reachable")
    return (
        F.when(~F.col("alive"), "safe_stop").when((reachable < quorum) & F.col("is_leader"), "quorum_lost").when((reachable < quorum) & F.col("has_grant"), "isolated").when(reachable < quorum, "safe_stop")
        .when(~F.col("has_leader"), "degraded").when(~F.col("connected"), "isolated").when(reachable == voters, "healthy").when(reachable == quorum, "degraded").otherwise("impaired")
    )


def authorise(operation: Column, voters: int) -> Column:
    """ok or why not: queries and local work always, granted work under its grant, writes under quorum and lease."""
    leads = F.col("is_leader") & F.col("has_leader") & F.col("alive") & (F.col("reachable") >= voters // 2 + 1)
    granted = F.when(~F.col("has_grant"), "grant_expired").when(~F.col("grant_current"), "fenced").otherwise("ok")
    return F.when(operation.isin("query", "local_work"), "ok").when(operation == "continue_granted", granted).when(~leads, "quorum_lost").when(~F.col("lease_valid"), "lease_expired").otherwise("ok")


def elections(nodes: DataFrame) -> DataFrame:
    """node, votes and elected: who would win its cluster if it stood. Those alive vote for one whose log isn't behind theirs;
    a witness (not is_full) or a dead node can't stand; a majority of all nodes elects."""
    size = nodes.groupBy("cluster").agg(F.count("*").alias("voters"))
    standing = nodes.where("alive and is_full").select("cluster", "node", F.col("last_index").alias("own"))
    votes = standing.join(nodes.where("alive").select("cluster", "last_index"), "cluster").groupBy("cluster", "node").agg(F.count_if(F.col("last_index") <= F.col("own")).alias("votes"))
    out = nodes.select("cluster", "node").join(votes, ["cluster", "node"], "left").join(size, "cluster")
    votes_or_none = F.coalesce("votes", F.lit(0))
    return out.select("node", votes_or_none.alias("votes"), (votes_or_none >= F.floor(F.col("voters") / 2) + 1).alias("elected"))


def open_results(results: DataFrame, grants: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Results executed but not committed: they hold their task's grant exactly, and no decision has reconciled the task."""
    held = results.join(grants, ["task_id", "attempt", "node"], "left_semi")
    return held.join(reconciled.select("task_id"), "task_id", "left_anti")
