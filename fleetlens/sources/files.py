"""Stored records: audit logs as lines of JSON, snapshots, catalogues, chunk stores and benchmark reports."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators import audit
from fleetlens.operators.folds import fold
from fleetlens.sources import wal

AUDIT = "sequence long, tick long, node long, body string, previous_hash string, event_hash string"
REPORT = "run long, content_bytes long, aggregate_content_bytes long, chunk_bytes long, concurrency long, lane string, correctness map<string,long>, cases array<struct<name string, elapsed_ns array<double>>>"


class BrokenChain(ValueError):
    pass


def write_audit(events: DataFrame, path: str, budget: int | None = None) -> DataFrame:
    """Append events (AUDIT) as lines of JSON; with a budget, those beyond a tick's bytes are left out and returned."""
    lines = events.withColumn("line", F.to_json(F.struct(*[c.strip().split(" ")[0] for c in AUDIT.split(",")])))
    if budget is None:
        lines.select(F.col("line").alias("value")).write.mode("append").text(path)
        return events.where("false")
    sized = lines.select(F.col("sequence").alias("event_id"), "tick", "line", (F.octet_length("line") + 1).alias("bytes"))
    fits = audit.byte_budget(sized.drop("line"), ["tick"], ["event_id"], budget).where("written")
    sized.join(fits, "event_id", "left_semi").select(F.col("line").alias("value")).write.mode("append").text(path)
    return events.join(fits.withColumnRenamed("event_id", "sequence"), "sequence", "left_anti")


def read_audit(spark: SparkSession, path: str, key: str = "node") -> DataFrame:
    """The events of a log, whose chain is checked first; blank lines are skipped. Raises BrokenChain with the first faults."""
    log = spark.read.schema(AUDIT).json(path).where("sequence is not null")
    faults = audit.check_events(log, key).where("fault is not null").select(key, "sequence", "fault").limit(5).collect()
    if faults:
        raise BrokenChain(str([tuple(f) for f in faults]))
    return log


def write_snapshot(records: DataFrame, path: str) -> None:
    """Replace a snapshot of records as a whole; readers see the one before until the new one is committed."""
    records.write.mode("overwrite").parquet(path)


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The snapshot's records, none if there isn't one yet."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], T.StructType.fromDDL(schema))
    return spark.read.schema(schema).parquet(path)


def write_catalog(catalog: DataFrame, path: str) -> None:
    catalog.write.mode("overwrite").json(path)


def read_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def content_verdicts(parts: DataFrame, keys: list[str], place: str, content: str) -> DataFrame:
    """keys, digest (SHA-256 of the contents in the order of place; null where one is missing) of parts, a row for each chunk
    with its bytes. Chunks are sorted within partitions and taken one after the other, so no content stands in one row, and a
    content larger than a task's memory only spills."""

    def step(s: dict, r: dict) -> None:
        if r[content] is None:
            s["gone"] = True
        elif not s["gone"]:
            s["hash"].update(r[content])

    finish = lambda key, s: [(*key, None if s["gone"] else s["hash"].hexdigest())]
    rows = parts.select(*keys, place, F.col(content).cast("binary").alias(content))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return fold(rows, keys, [place], lambda: {"hash": hashlib.sha256(), "gone": False}, step, f"{kinds}, digest string", finish)


def read_contents(spark: SparkSession, chunks: str, manifests: DataFrame) -> DataFrame:
    """digest and verdict (whole, missing or corrupt) of each content (digest, chunks: array of chunk digests) whose chunks lie in
    files named by their digests: every chunk is checked where it is read, then the content as a whole, in order. A content
    without chunks is whole if its digest is that of no bytes."""
    name = F.element_at(F.split("path", "/"), -1)
    stored = spark.read.format("binaryFile").load(chunks).select(name.alias("chunk"), "content", (F.sha2("content", 256) == name).alias("sound"))
    wanted = manifests.select("digest", F.posexplode_outer("chunks").alias("place", "chunk"))
    found = wanted.join(stored, "chunk", "left")
    nothing = F.when(F.col("chunk").isNull() & F.col("place").isNull(), F.lit(b""))
    whole = content_verdicts(found.select(F.col("digest").alias("wanted"), F.coalesce("place", F.lit(0)).alias("place"), F.coalesce("content", nothing).alias("content")), ["wanted"], "place", "content")
    sound = found.groupBy(F.col("digest").alias("own")).agg(F.bool_or(F.col("place").isNotNull() & F.col("content").isNull()).alias("gone"), F.bool_or(~F.col("sound")).alias("bad"))
    joined = whole.join(sound, F.col("wanted") == F.col("own"))
    corrupt = F.coalesce(F.col("bad"), F.lit(False)) | (F.col("digest") != F.col("wanted"))
    return joined.select(F.col("wanted").alias("digest"), F.when(F.col("gone"), "missing").when(corrupt, "corrupt").otherwise("whole").alias("verdict"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """A row for each sample of each case of raw benchmark reports (JSON, one report a file); broken files are skipped."""
    reports = spark.read.schema(REPORT).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    shared = ["run", "content_bytes", "concurrency", F.coalesce("aggregate_content_bytes", F.col("content_bytes") * F.col("concurrency")).alias("aggregate_bytes"), F.coalesce("lane", F.lit("per-transfer")).alias("lane"), "correctness"]
    return reports.select(*shared, F.explode("cases").alias("case")).select("*", F.col("case.name").alias("name"), F.explode("case.elapsed_ns").alias("elapsed")).drop("case")


def write_report(cases: DataFrame, dimensions: list[str], path: str) -> None:
    """Merged cases as lines of JSON, one a case: case_id, its dimensions, and all other columns as metrics; nulls are left out. The
    report is replaced as a whole."""
    metrics = [c for c in cases.columns if c not in ("case_id", *dimensions)]
    line = F.to_json(F.struct("case_id", F.struct(*dimensions).alias("dimensions"), F.struct(*metrics).alias("metrics")))
    cases.select(line.alias("value")).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str, dimensions: str, metrics: str) -> DataFrame:
    """The cases of a report with dimensions and metrics (schemas) as columns."""
    rows = spark.read.schema(f"case_id string, dimensions struct<{dimensions}>, metrics struct<{metrics}>").json(path)
    return rows.select("case_id", "dimensions.*", "metrics.*")


def write_pairs(entries: list[tuple[int, str, bytes]], path: str) -> None:
    """A log segment of prepare and commit frames for (log index, transaction id, payload) entries, for round trips on a local path."""
    with open(path, "wb") as f:
        for index, transaction, payload in entries:
            f.write(wal.frame(wal.PREPARE, index, payload) + wal.frame(wal.COMMIT, index, transaction.encode()))
