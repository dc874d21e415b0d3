"""Durable records: the task registry's mutations, versioned upserts, acceptance, replicas, transaction chains and compaction."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators.folds import fold

TERMINAL = ("committed", "failed", "cancelled")


def apply_mutation(s: dict, r: dict) -> str:
    """accepted, conflict or rejected; s (state, last, active, staged, conflicts) is changed if the mutation is legal."""
    kind, state = r["mutation"], s["state"]
    if kind == "submit":
        if state is not None:
            return "rejected"
        s["state"] = "submitted" if r["fast"] else "persisted"
        return "accepted"
    if state is None:
        return "rejected"
    live = state not in TERMINAL
    claim = (r["attempt"], r["node"])
    if kind == "assign" and live and state != "output_staged" and r["attempt"] > s["last"]:
        s.update(state="assigned", last=r["attempt"], active=claim)
    elif kind == "running" and state == "assigned" and s["active"][0] == r["attempt"]:
        s["state"] = "running"
    elif kind == "stage" and s["active"] is not None and s["active"] != claim:
        s["conflicts"] += 1
        return "conflict"
    elif kind == "stage" and state in ("assigned", "running"):
        s.update(state="output_staged", staged=r["content"])
    elif kind == "conflict":
        s["conflicts"] += 1
    elif kind == "commit" and state == "output_staged" and s["staged"] == r["content"]:
        s.update(state="committed", active=None)
    elif kind in ("fail", "recover") and live:
        s.update(state="failed" if kind == "fail" else "recovery_required", active=None)
    elif kind == "cancel" and live:
        s.update(state="cancelled", active=None)
    else:
        return "rejected"
    return "accepted"


COMMANDED = "event_id long, outcome string, state string, active long, conflicts long"
#: A task between commands.
TASK = "state string, last long, active struct<attempt: long, node: long>, staged long, conflicts long"


def new_task() -> dict:
    return dict(state=None, last=0, active=None, staged=None, conflicts=0)


def command(s: dict, r: dict) -> tuple:
    """The step of a task by a command; gives a row of COMMANDED."""
    outcome = apply_mutation(s, r)
    return r["event_id"], outcome, s["state"] or "absent", s["active"][0] if s["active"] else None, s["conflicts"]


def task_registry(commands: DataFrame) -> DataFrame:
    """event_id, outcome, and the task's state, active attempt and conflicts after each command (task_id, pos, mutation,
    attempt, node, content, fast), in the order of pos."""
    return fold(commands, ["task_id"], ["pos"], new_task, command, COMMANDED)


def take_snapshot(s: dict, r: dict) -> str:
    """What becomes of a snapshot: one is stale if either version goes back; equal ones replace. s keeps the one held."""
    new = (r["capability_version"], r["resource_version"])
    if not r["valid"] or None in new or 0 in new:
        return "invalid"
    if s["held"] and (s["held"][0] > new[0] or s["held"][1] > new[1]):
        return "stale"
    s["held"], s["row"] = new, r
    return "stored"


def versioned_upserts(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """event_id, outcome and the versions held after each snapshot."""
    step = lambda s, r: (r["event_id"], take_snapshot(s, r), *(s["held"] or (None, None)))
    return fold(rows, keys, order, lambda: dict(held=None, row=None), step, "event_id long, outcome string, capability_version long, resource_version long")


def current_snapshots(rows: DataFrame, keys: list[str], order: list[str], schema: T.StructType) -> DataFrame:
    """The snapshot that each key holds after all of its rows, with the columns of schema."""
    finish = lambda key, s: [tuple(s["row"][c] for c in schema.names)] if s["row"] else []
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def step(s: dict, r: dict) -> None:
        take_snapshot(s, r)

    return fold(rows, keys, order, lambda: dict(held=None, row=None), step, ddl, finish)


def worker_registry(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """event_id, outcome and health of a worker after each registration (capability_version) or pulse (is_pulse)."""

    def step(s: dict, r: dict) -> tuple:
        version = r["capability_version"]
        if r["is_pulse"]:
            if s["version"] is None:
                outcome = "unregistered"
            elif s["version"] != version:
                outcome, s["health"] = "incompatible", "incompatible"
            else:
                outcome, s["health"] = "accepted", "ready" if r["valid"] else "busy"
        elif version == 0:
            outcome = "unversioned"
        elif s["version"] is not None and s["version"] > version:
            outcome = "stale"
        else:
            outcome, s["version"], s["health"] = "registered", version, "ready"
        return r["event_id"], outcome, s["health"]

    return fold(rows, keys, order, lambda: dict(version=None, health=None), step, "event_id long, outcome string, health string")


def accepts(mode: Column, wanted: Column, replicas: Column, recoverable: Column, inputs: Column, copies: Column) -> Column:
    """Whether a submission's acceptance mode can be kept: fast, durable (two copies) or critical (wanted replicas, two at least)."""
    needed = F.when(mode == "fast", 1).when(mode == "durable", 2).otherwise(wanted)
    critical = (wanted >= 2) & recoverable & ((inputs == 0) | (copies >= wanted))
    return (needed <= replicas + 1) & F.when(mode == "fast", F.lit(True)).when(mode == "durable", recoverable).otherwise(critical)


def commit_ready(mode: Column, wanted: Column, recoverable: Column, healthy: Column) -> Column:
    return F.when(mode == "fast", healthy >= 1).when(mode == "durable", recoverable & (healthy >= 1)).otherwise(recoverable & (healthy >= wanted))


def replica_acks(attempts: DataFrame, required: int) -> DataFrame:
    """attempts (entry, place, ok) with asked: replicas are asked in order until `required` have committed."""
    before = F.sum(F.col("ok").cast("int")).over(Window.partitionBy("entry").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return attempts.withColumn("asked", F.coalesce(before, F.lit(0)) < required)


def little_endian(value: Column) -> Column:
    """Eight bytes, lowest first."""
    wide = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(wide, 15 - 2 * i, 2) for i in range(8)]))


def transaction_id(previous: Column, index: Column, version: Column, payload: Column) -> Column:
    """SHA-256 of the previous id, the log index and previous version (little-endian), and the mutation's bytes."""
    return F.sha2(F.concat(previous.cast("binary"), little_endian(index), little_endian(F.coalesce(version, F.lit(0))), F.coalesce(payload.cast("binary"), F.lit(b""))), 256)


def chain_transactions(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows (version: the record's version before, payload) as a log: log_index, previous_id and transaction_id added by a
    fold, as each id takes in the one before."""

    def step(s: dict, r: dict) -> tuple:
        s["index"] += 1
        previous = s["id"]
        s["id"] = hashlib.sha256(previous.encode() + s["index"].to_bytes(8, "little") + (r["version"] or 0).to_bytes(8, "little", signed=True) + (r["payload"] or "").encode()).hexdigest()
        return (*(r[c] for c in names), s["index"], previous, s["id"])

    names = rows.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", log_index long, previous_id string, transaction_id string"
    return fold(rows, keys, order, lambda: dict(index=0, id=""), step, schema)


def check_transactions(log: DataFrame, key: str) -> DataFrame:
    """log with fault (null where there is none): index, chain, version or id; every check reads a row and the one before it."""
    at = Window.partitionBy(key).orderBy("log_index")
    version_at = Window.partitionBy(key, "record").orderBy("log_index")
    rows = log.withColumns({
        "before_index": F.coalesce(F.lag("log_index").over(at), F.lit(0)), "before_id": F.coalesce(F.lag("transaction_id").over(at), F.lit("")),
        "before_version": F.coalesce(F.lag("version").over(version_at) + 1, F.lit(0)),
    })
    own = transaction_id(F.col("previous_id"), F.col("log_index"), F.col("version"), F.col("payload"))
    fault = (
        F.when(F.col("log_index") != F.col("before_index") + 1, "index").when(F.col("previous_id") != F.col("before_id"), "chain")
        .when(F.col("version") != F.col("before_version"), "version").when(own != F.col("transaction_id"), "id")
    )
    return rows.withColumn("fault", fault).drop("before_index", "before_id", "before_version")


def compactions(rows: DataFrame, keys: list[str], order: list[str], records: int, size: int) -> DataFrame:
    """event_id, compacts, and records and bytes in the log after each append; compaction empties the log."""

    def step(s: dict, r: dict) -> tuple:
        s["n"], s["bytes"] = s["n"] + 1, s["bytes"] + r["bytes"]
        due = s["n"] >= records or s["bytes"] >= size
        if due:
            s["n"] = s["bytes"] = 0
        return r["event_id"], due, s["n"], s["bytes"]

    return fold(rows, keys, order, lambda: dict(n=0, bytes=0), step, "event_id long, compacts boolean, records long, bytes long")
