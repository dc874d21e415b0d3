"""Budgets and queues: what a node takes, step by step, and what turns it away."""

from __future__ import annotations

import bisect
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.folds import fold

#: Pressures from which summaries and discardable records are turned away.
SUMMARY_PRESSURE, DISCARD_PRESSURE = 90, 60


def telemetry_admission(rows: DataFrame, keys: list[str], order: list[str], budget: int) -> DataFrame:
    """event_id, accepted and used (records taken so far); correctness records are always taken and use the budget too."""
    limits = {"summary": SUMMARY_PRESSURE, "discardable": DISCARD_PRESSURE}

    def step(s: dict, r: dict) -> tuple:
        taken = r["class"] == "correctness" or s["used"] < budget and r["k"] < limits[r["class"]]
        s["used"] += taken
        return r["event_id"], taken, s["used"]

    return fold(rows, keys, order, lambda: {"used": 0}, step, "event_id long, accepted boolean, used long")


def sampling_interval(rows: DataFrame, keys: list[str], order: list[str], reset: Column, base: int, most: int) -> DataFrame:
    """rows with next_after: base doubled for each quiet row since the last reset, six times and to `most` at most."""
    at = Window.partitionBy(*keys).orderBy(*order)
    island = rows.withColumn("reset", reset.cast("int")).withColumn("island", F.sum("reset").over(at))
    quiet = F.sum(1 - F.col("reset")).over(Window.partitionBy(*keys, "island").orderBy(*order))
    return island.withColumn("next_after", F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(quiet, F.lit(6))), F.lit(float(most))).cast("long")).drop("reset", "island")


@dataclass(frozen=True)
class Network:
    bytes_a_tick: int
    control: int
    queued: int
    concurrent: int


def network_budget(rows: DataFrame, keys: list[str], order: list[str], limits: Network) -> DataFrame:
    """event_id, ok, queued and active after each operation (op: tick, enqueue, start, complete or control; bytes, k the
    pressure, forwarding); a node under pressure of 90 or more counts as reconnecting and then takes control data only."""

    def step(s: dict, r: dict) -> tuple:
        op, size = r["op"], r["bytes"]
        if op == "tick":
            ok, s["data"], s["control"] = True, 0, 0
        elif op == "enqueue":
            blocked = r["k"] >= 90 and max(r["k"], s["queued"] * 100 // limits.queued) >= 90
            ok = not r["forwarding"] and not blocked and s["queued"] + size <= limits.queued
            s["queued"] += size * ok
        elif op == "start":
            ok = s["active"] < limits.concurrent and size <= s["queued"] and s["data"] + size <= limits.bytes_a_tick - limits.control
            s["queued"], s["data"], s["active"] = s["queued"] - size * ok, s["data"] + size * ok, s["active"] + ok
        elif op == "complete":
            ok = s["active"] > 0
            s["active"] -= ok
        else:
            ok = s["control"] + size <= limits.control
            s["control"] += size * ok
        return r["event_id"], ok, s["queued"], s["active"]

    return fold(rows, keys, order, lambda: dict(queued=0, data=0, control=0, active=0), step, "event_id long, ok boolean, queued long, active long")


@dataclass(frozen=True)
class Transfers:
    chunk: int
    queued: int
    concurrent: int


def transfer_queue(rows: DataFrame, keys: list[str], order: list[str], limits: Transfers) -> DataFrame:
    """event_id, ok, started (the event that queued the chunk which starts) and held bytes after each operation."""

    def step(s: dict, r: dict) -> tuple:
        started, ok = None, False
        if r["op"] == "enqueue":
            ok = r["bytes"] <= limits.chunk and s["held"] + r["bytes"] <= limits.queued
            if ok:
                s["items"].append((r["event_id"], r["bytes"]))
                s["held"] += r["bytes"]
        elif r["op"] == "start":
            ok = s["flying"] < limits.concurrent and bool(s["items"])
            if ok:
                started, size = s["items"].popleft()
                s["held"], s["flying"] = s["held"] - size, s["flying"] + 1
        else:
            ok = s["flying"] > 0
            s["flying"] -= ok
        return r["event_id"], ok, started, s["held"]

    return fold(rows, keys, order, lambda: dict(items=deque(), held=0, flying=0), step, "event_id long, ok boolean, started long, held long")


def joint_budget(rows: DataFrame, keys: list[str], order: list[str], limits: dict[str, int]) -> DataFrame:
    """event_id, admitted and used_* after each row: it fits all budgets and is charged to all, or to none."""

    def step(s: dict, r: dict) -> tuple:
        ok = all(s[c] + r[c] <= most for c, most in limits.items())
        for c in limits:
            s[c] += r[c] * ok
        return (r["event_id"], ok, *(s[c] for c in limits))

    return fold(rows, keys, order, lambda: dict.fromkeys(limits, 0), step, "event_id long, admitted boolean, " + ", ".join(f"used_{c} long" for c in limits))


def count_budget(rows: DataFrame, keys: list[str | Column], order: list[str], most: int) -> DataFrame:
    """rows with admitted: the first `most` of each of keys; a rank needs no fold."""
    return rows.withColumn("admitted", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) <= most)


def coalesce_transfers(requests: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, requests and transfers (requests: key, since, until): one that begins before all earlier ones ended waits for them."""
    earlier = F.max("until").over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    marked = requests.withColumn("starts", earlier.isNull() | (F.col("since") >= earlier))
    return marked.groupBy(key).agg(F.count("*").alias("requests"), F.count_if("starts").alias("transfers"))


def bounded_keys(rows: DataFrame, keys: list[str], order: list[str], key: str, most: int) -> DataFrame:
    """event_id, evicted and profiles (how many are held) after each row: a new key beyond `most` drives out the smallest."""

    def step(s: dict, r: dict) -> tuple:
        held, evicted = s["held"], None
        at = bisect.bisect_left(held, r[key])
        if at == len(held) or held[at] != r[key]:
            if len(held) >= most:
                evicted = held.pop(0)
            bisect.insort(held, r[key])
        return r["event_id"], evicted, len(held)

    return fold(rows, keys, order, lambda: {"held": []}, step, "event_id long, evicted long, profiles long")
