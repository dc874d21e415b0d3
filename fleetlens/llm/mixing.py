"""Mixing sources to target weights by balanced (cube-method) sampling.

Targets: sources in code-point order, null last, take weights from a repeating list and share `share` times the total
size; a target stops at `cap` times its source's size and the excess is reshared by weight (one pass of window sums
over the sources finds the water level). A document of a source with target/size = a + p, a whole, gets a copies and
one more with inclusion probability p.

Cube method: blocks of at most about BLOCK documents of one source run the flight phase, which moves the inclusion
probabilities along the null space of the two constraints (words, documents) until at most two stay fractional; the
block's RESERVE shortest documents wait. Both meet in new blocks, so each round leaves a few of a hundred; once a
source's rest fits in one block, that is the landing problem: a last flight, rounding, and flips and swaps towards the
word target. All draws are seeded by source and block, and blocks are cut by a hash of doc_id, so reruns agree on any
cluster.

Defined cases: null text has size 0; null source is a source; null doc_ids are dealt to blocks by row; repeated rows
are sampled each; an empty table gives an empty result. Other columns pass through, whatever their names; those named as
an added one give way to it.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import WORD_PATTERN, free_name, table, written, written_by_task

BLOCK = 1024
#: The shortest documents of a block, which wait for the landing problem.
RESERVE = 12
WEIGHTS = (5.0, 2.0, 1.0)
ADDED = ("size", "source_size", "target", "copies", "taken")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, n, source_size, sid and target, from one row for each source (source, n, source_size)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(1))
    rows = sizes.withColumn("sid", F.row_number().over(order) - 1)
    rows = rows.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("most", F.lit(cap) * F.col("source_size"))
    filling = Window.orderBy(F.col("most") / F.col("w"), "sid")
    before = F.coalesce(F.sum("most").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("level", (F.lit(share) * F.sum("source_size").over(whole) - before) / F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    # Levels fall from the first source below its cap on, so the largest is the first one.
    rows = rows.withColumn("water", F.max(F.when(F.col("most") / F.col("w") > F.col("level"), F.col("level"))).over(whole))
    return rows.select("source", "n", "source_size", "sid", F.least("most", F.coalesce(F.col("water") * F.col("w"), F.col("most"))).alias("target"))


def flight(units: list[list], rng: random.Random) -> tuple[dict, list[list]]:
    """Units [key, size, p] in visiting order: what was decided (key to 0 or 1), and the at most two left fractional."""
    done: dict = {}
    active: list[list] = []
    rest = iter(units)
    while True:
        while len(active) < 3 and (unit := next(rest, None)) is not None:
            if unit[2] <= 1e-9 or unit[2] >= 1 - 1e-9:
                done[unit[0]] = int(unit[2] > 0.5)
            else:
                active.append(list(unit))
        if len(active) == 3:
            a, b, c = (u[1] for u in active)
            direction = [b - c, c - a, a - b] if not a == b == c else [1.0, -1.0, 0.0]
        elif len(active) == 2 and active[0][1] == active[1][1]:
            direction = [1.0, -1.0]
        else:
            return done, active
        up = min((1 - u[2]) / d if d > 0 else -u[2] / d for u, d in zip(active, direction) if d)
        down = min(u[2] / d if d > 0 else (u[2] - 1) / d for u, d in zip(active, direction) if d)
        step = up if rng.random() * (up + down) < down else -down
        for u, d in zip(active, direction):
            u[2] += step * d
            if u[2] <= 1e-9 or u[2] >= 1 - 1e-9:
                done[u[0]] = int(u[2] > 0.5)
        active = [u for u in active if u[0] not in done]


def land(units: list[list], decided: dict, active: list[list]) -> dict:
    """The landing problem: round the last units, then flip or swap units while that brings the words nearer to what the
    units' probabilities promise (swaps keep the number of documents; ties go to the first)."""
    took = {**decided, **{u[0]: int(u[2] >= 0.5) for u in active}}
    size = np.array([u[1] for u in units])
    x = np.array([took[u[0]] for u in units], dtype=np.float64)
    drift = float((size * (x - np.array([u[2] for u in units]))).sum())
    for _ in range(64):
        on, off = np.flatnonzero(x == 1), np.flatnonzero(x == 0)
        best = (abs(drift) - 1e-6, None)
        flips = np.abs(drift + size * (1 - 2 * x))
        if len(flips) and flips.min() < best[0]:
            best = (float(flips.min()), (int(flips.argmin()),))
        if len(on) and len(off):
            swaps = np.abs(drift + size[off][None, :] - size[on][:, None])
            if swaps.min() <= best[0]:
                i, j = np.unravel_index(int(swaps.argmin()), swaps.shape)
                best = (float(swaps.min()), (int(on[i]), int(off[j])))
        if best[1] is None:
            break
        for i in best[1]:
            drift += size[i] * (1 - 2 * x[i])
            x[i] = 1 - x[i]
    return {u[0]: int(v) for u, v in zip(units, x)}


def _flight_group(last: bool, seed: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = random.Random(zlib.crc32(f"{seed}|{'|'.join(str(int(k)) for k in key)}".encode()))
        pdf = pdf.sort_values(["size", "h", "unit"], ascending=[False, True, True], kind="stable")
        units = pdf[["unit", "size", "p"]].values.tolist()
        aside = [] if last else units[-RESERVE:]
        done, active = flight(units[: len(units) - len(aside)], rng)
        if last:
            done, active = land(units, done, active), []
        fraction = {u[0]: u[2] for u in active + aside}
        unit = pdf["unit"].tolist()
        return pd.DataFrame({"unit": pdf["unit"], "sid": pdf["sid"], "size": pdf["size"], "h": pdf["h"], "p": [fraction.get(u, 0.0) for u in unit], "took": [-1 if u in fraction else done[u] for u in unit]})

    return run


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 5, keep_text: bool = True, block: int = BLOCK) -> DataFrame:
    """docs with size, source_size, target (its source's), copies and taken (words the mix takes: copies * size)."""
    docs = docs.drop(*ADDED)
    unit = free_name(docs, "unit")
    sized = docs.withColumn("size", F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long"))
    if not keep_text:
        sized = sized.drop("text")
    # A unit is the task that wrote the row (upper 31 bits) and the row's number there (lower 33).
    part = free_name(sized.withColumn(unit, F.lit(0)), "part")
    numbered = sized.withColumn(unit, F.monotonically_increasing_id()).withColumn(part, F.shiftright(unit, 33))
    rows = written_by_task(numbered, "mix-rows", part, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sources = written(targets(rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), weights, share, cap), "mix-sources")

    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    named = sources.select(F.col("source").alias("s_source"), "n", "source_size", "sid", "target", F.floor(ratio).cast("int").alias("whole"), (ratio - F.floor(ratio)).alias("p"))
    light = rows.select(F.col(unit).alias("unit"), "source", "size", F.coalesce(F.xxhash64("doc_id"), F.xxhash64(F.col(unit))).alias("h"), F.col("doc_id").isNull().alias("no_id"))
    light = light.withColumn("h", F.when(F.col("no_id"), F.xxhash64("unit")).otherwise(F.col("h"))).join(named, F.col("source").eqNullSafe(F.col("s_source")))
    schema = "unit long, sid int, size double, h long, p double, took int"
    left = light.where((F.col("p") > 0) & (F.col("size") > 0)).select("unit", "sid", F.col("size").cast("double").alias("size"), "h", "p", F.ceil(F.col("n") / block).alias("blocks"))
    decided: DataFrame | None = None
    turn, last = 0, False
    while not last:
        most = left.groupBy("sid").count().agg(F.max("count")).first()[0] or 0
        last = most <= block
        if turn:
            counts = left.groupBy("sid").agg(F.ceil(F.count("*") / block).alias("blocks"))
            left = left.drop("blocks").join(counts, "sid")
        cut = F.pmod(F.xxhash64("h", F.lit(turn)), F.col("blocks")) if not last else F.lit(0)
        out = written(left.withColumn("block", cut.cast("long")).groupBy("sid", "block").applyInPandas(_flight_group(last, seed * 1000 + turn), schema), "mix-flight")
        fixed = out.where("took >= 0").select(F.col("unit").alias("u_unit"), "took")
        decided = fixed if decided is None else decided.unionByName(fixed)
        left = out.where("took < 0").drop("took")
        turn += 1
    # Every row's decision, as one array for each task that wrote rows, in their order: looked up by row number, it meets
    # the texts where they lie, at any size. An array is as long as a task's input has rows.
    idle = light.where(~((F.col("p") > 0) & (F.col("size") > 0))).select(F.col("unit").alias("u_unit"), F.lit(0).alias("took"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("u_unit"), F.col("took").cast("byte").alias("t"))))
    own, list_, of = free_name(rows, "own"), free_name(rows, "list"), free_name(rows, "of")  # docs may have any names
    decisions = decided.unionByName(idle).groupBy(F.shiftright("u_unit", 33).alias(own)).agg(F.transform(ordered, lambda x: x["t"]).alias(list_))
    joined = rows.join(decisions.hint("shuffle_hash"), F.col(part) == F.col(own))
    took = F.get(list_, F.expr(f"cast(`{unit}` & {(1 << 33) - 1} as int)"))
    joined = joined.withColumn(own, took).drop(list_).join(named.select(F.struct("s_source", "source_size", "target", "whole").alias(of)), F.col("source").eqNullSafe(F.col(f"{of}.s_source")))
    copies = F.col(f"{of}.whole") + F.col(own)
    return joined.select(*[F.col(f"`{c}`") for c in sized.columns], f"{of}.source_size", f"{of}.target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op5_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken", "copies")
