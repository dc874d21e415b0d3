"""Content-addressed storage: deduplication, missing and changed chunks, repair planning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.fleet import recoverable
from fleetlens.operators.folds import fold


def dedup(chunks: DataFrame) -> DataFrame:
    """Per document, chunks uploaded (the first of their digest) and bytes reused; the first comes from an aggregate."""
    first = chunks.groupBy("digest").agg(F.min(F.struct("doc_id", "chunk_index")).alias("first"))
    rows = chunks.join(first, "digest")
    uploaded = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.chunk_index") == F.col("chunk_index"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(uploaded).alias("uploaded"), F.sum(F.when(~uploaded, F.col("size")).otherwise(0)).cast("long").alias("reused_size"))


def missing(chunks: DataFrame, held: DataFrame) -> DataFrame:
    """Per document, bytes of chunks that aren't held; repeated ones count each time."""
    rows = chunks.join(held.withColumn("here", F.lit(True)), "digest", "left")
    return rows.groupBy("doc_id").agg(F.sum(F.when(F.col("here"), 0).otherwise(F.col("size"))).cast("long").alias("missing"))


def changed(chunks: DataFrame, previous: DataFrame) -> DataFrame:
    """Per document, chunks that are new or differ in digest or size from the previous manifest's at that place."""
    old = previous.select("doc_id", "chunk_index", F.col("digest").alias("old_digest"), F.col("size").alias("old_size"))
    rows = chunks.join(old, ["doc_id", "chunk_index"], "left")
    same = F.col("digest").eqNullSafe(F.col("old_digest")) & F.col("size").eqNullSafe(F.col("old_size"))
    return rows.where(~same).groupBy("doc_id").agg(F.count("*").alias("changed"))


def repair_plan(catalog: DataFrame, lanes: int, budget: int, most: int | None = None) -> DataFrame:
    """Per lane, repair jobs and bytes planned in digest order; a job over the budget is skipped, later ones may still fit,
    and the plan ends with `most` jobs."""

    def step(s: dict, r: dict) -> None:
        s["jobs"] += 1
        if (most is None or s["taken"] < most) and s["planned"] + r["bytes"] <= budget:
            s["planned"], s["taken"] = s["planned"] + r["bytes"], s["taken"] + 1

    jobs = catalog.where("policy = 'replicated' and healthy < 2 and size > 0").select((F.col("digest") % lanes).cast("long").alias("lane"), "digest", (F.col("size") * (2 - F.col("healthy"))).cast("long").alias("bytes"))
    return fold(jobs, ["lane"], ["digest"], lambda: dict(jobs=0, planned=0, taken=0), step, "lane long, jobs long, planned long, taken long", lambda key, s: [(*key, s["jobs"], s["planned"], s["taken"])])


def inputs_recoverable(inputs: DataFrame, catalog: DataFrame, least: int) -> DataFrame:
    """Per task: all inputs can be recovered (unknown ones can't), and the fewest healthy copies among the known."""
    known = catalog.select("digest", recoverable(F.col("policy"), F.col("healthy"), least).alias("ok"), "healthy")
    rows = inputs.join(known, "digest", "left")
    return rows.groupBy("task_id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("recoverable"), F.coalesce(F.min("healthy"), F.lit(0)).alias("least_copies"))


def unreferenced(removed: DataFrame, kept: DataFrame) -> DataFrame:
    """Digests of removed manifests that no kept one holds, with their size."""
    return removed.join(kept.select("digest"), "digest", "left_anti").groupBy("digest").agg(F.max("size").alias("size"))


def manifest_check(chunks: DataFrame, totals: DataFrame, most: int) -> DataFrame:
    """Per document: indexes run from 0 without gaps, sizes lie in 1 .. most and sum to the total."""
    seen = chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.min("chunk_index").alias("first"), F.max("chunk_index").alias("last"),
        F.countDistinct("chunk_index").alias("places"), F.min("size").alias("least"), F.max("size").alias("largest"), F.sum("size").alias("bytes"),
    )
    good = "first = 0 and last = chunks - 1 and places = chunks and least > 0 and largest <= {most} and bytes = total".format(most=most)
    return seen.join(totals, "doc_id").select("doc_id", "chunks", F.expr(good).alias("valid"))
