"""Audit logs: hash chains and their validation, Merkle roots, inclusion proofs, segments, metadata rules and traces."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.folds import fold
from fleetlens.operators.places import dealt

#: What a log's first hash refers to; a parameter, as logs of another origin start from another.
GENESIS = hashlib.sha256(b"fleetlens-audit").hexdigest()
#: Words that metadata keys may not be or end in (after an underscore), and the most bytes of a key and a value.
FORBIDDEN = ("secret", "token", "password", "credential", "input", "output")
KEY_BYTES, VALUE_BYTES = 64, 256


def canonical(sequence: Column, body: Column, previous: Column) -> Column:
    """What an event's hash is taken of: its place, its own canonical text and the hash before it."""
    return F.concat_ws("|", sequence.cast("string"), body, previous)


def append_events(rows: DataFrame, keys: list[str], order: list[str], genesis: str = GENESIS) -> DataFrame:
    """rows (body: the event's canonical text) with sequence, previous_hash and event_hash: each hash takes in the one before."""

    def step(s: dict, r: dict) -> tuple:
        s["n"] += 1
        previous = s["hash"]
        s["hash"] = hashlib.sha256(f"{s['n']}|{r['body']}|{previous}".encode()).hexdigest()
        return (*(r[c] for c in names), s["n"], previous, s["hash"])

    names = rows.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", sequence long, previous_hash string, event_hash string"
    return fold(rows, keys, order, lambda: dict(n=0, hash=genesis), step, schema)


def check_events(log: DataFrame, key: str, genesis: str = GENESIS) -> DataFrame:
    """log with fault (null where there is none): sequence, chain or hash. Every check reads an event and the one before it in
    the log, so a whole log is checked in parallel."""
    at = Window.partitionBy(key).orderBy("sequence")
    rows = log.withColumns({"before": F.coalesce(F.lag("sequence").over(at), F.lit(0)), "before_hash": F.coalesce(F.lag("event_hash").over(at), F.lit(genesis))})
    own = F.sha2(canonical(F.col("sequence"), F.col("body"), F.col("previous_hash")), 256)
    fault = F.when(F.col("sequence") != F.col("before") + 1, "sequence").when(F.col("previous_hash") != F.col("before_hash"), "chain").when(F.col("event_hash") != own, "hash")
    return rows.withColumn("fault", fault).drop("before", "before_hash")


def byte_budget(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """event_id and written: events whose bytes still fit the tick's budget; what doesn't fit isn't charged."""

    def step(s: dict, r: dict) -> tuple:
        ok = s["bytes"] + r["bytes"] <= most
        s["bytes"] += r["bytes"] * ok
        return r["event_id"], ok

    return fold(rows, keys, order, lambda: {"bytes": 0}, step, "event_id long, written boolean")


def metadata_allowed(metadata: Column, most: int) -> Column:
    """A map of few and short entries none of whose keys may name something sensitive; A-Z count as a-z."""
    entries = F.map_entries(metadata)

    def bad(e: Column) -> Column:
        key = F.translate(e["key"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        named = key.isin(*FORBIDDEN)
        for word in FORBIDDEN:
            named = named | key.endswith(f"_{word}")
        return (F.octet_length(e["key"]) > KEY_BYTES) | (F.octet_length(e["value"]) > VALUE_BYTES) | named

    return (F.size(entries) <= most) & ~F.exists(entries, bad)


def traces(events: DataFrame, order: str) -> DataFrame:
    """events with their places in the traces of their task, of its attempt and of their node. Both windows of a task come
    first, as one shuffle does for them."""
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    by_task = events.withColumn("in_task", place("task_id")).withColumn("in_attempt", place("task_id", "attempt"))
    return dealt(by_task, ["node"]).withColumn("in_node", place("node"))


def consistent_segments(segments: DataFrame, key: str) -> DataFrame:
    """segments (segment, first, last, previous_root, root; numbers are told apart) with consistent: numbers, sequences and roots
    go on from the segment before; the first one of a log has nothing to go on from. Neighbours meet by number, so a log of any
    length is dealt over tasks."""
    before = segments.select(F.col(key).alias("b_key"), (F.col("segment") + 1).alias("b_next"), F.col("last").alias("b_last"), F.col("root").alias("b_root"))
    firsts = segments.groupBy(F.col(key).alias("f_key")).agg(F.min("segment").alias("f_first"))
    rows = segments.join(before, F.col(key).eqNullSafe(F.col("b_key")) & (F.col("segment") == F.col("b_next")), "left").join(firsts, F.col(key).eqNullSafe(F.col("f_key")))
    goes_on = (F.col("first") == F.col("b_last") + 1) & F.col("previous_root").eqNullSafe(F.col("b_root"))
    return rows.withColumn("consistent", F.when(F.col("segment") > F.col("f_first"), F.coalesce(goes_on, F.lit(False)))).drop("b_key", "b_next", "b_last", "b_root", "f_key", "f_first")
