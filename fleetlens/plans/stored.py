"""Queries of bitmap indexes, filtered joins of contents, ordered digests and stored profiles, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import bitmaps, profiles, reports
from fleetlens.plans.trusted import AUDIT, CHAIN, audit_log
from fleetlens.plans.catalog import PROFILE, query, rounded
from fleetlens.plans.scheduling import PREDICTED
from fleetlens.session import shared_path
from fleetlens.sources import files


@query("candidate_bitmaps", ["wide_needs", "wide_nodes"], "SELECT r.task_id, coalesce(e.n, 0) AS nodes, e.least, e.most FROM wide_needs r LEFT JOIN (SELECT q.need_lo, q.need_hi, count(*) AS n, min(idx) AS least, max(idx) AS most FROM (SELECT DISTINCT need_lo, need_hi FROM wide_needs) q JOIN wide_nodes w ON (w.lo & q.need_lo) = q.need_lo AND (w.hi & q.need_hi) = q.need_hi GROUP BY 1, 2) e USING (need_lo, need_hi)")
def candidate_bitmaps(needs, nodes):
    """Nodes that own all bits of each request, of 128."""
    found = bitmaps.candidates(needs, nodes, "idx").groupBy("need_lo", "need_hi").agg(F.count(F.lit(1)).alias("nodes"), F.min("idx").alias("least"), F.max("idx").alias("most"))
    return needs.join(found, ["need_lo", "need_hi"], "left").select("task_id", F.coalesce("nodes", F.lit(0)).alias("nodes"), "least", "most")


@query("wide_supply", ["wide_nodes"], "SELECT b AS bit, count(*) AS nodes FROM (SELECT unnest(range(0, 128)) AS b, lo, hi FROM wide_nodes) WHERE CASE WHEN b < 64 THEN (lo >> b) & 1 ELSE (hi >> (b - 64)) & 1 END = 1 GROUP BY 1")
def wide_supply(nodes):
    return bitmaps.supply(nodes).select(F.col("bit").cast("long").alias("bit"), "nodes")


@query("missing_bytes_filtered", ["chunks"], "SELECT c.doc_id, CAST(sum(CASE WHEN h.digest IS NULL THEN c.size ELSE 0 END) AS BIGINT) AS missing FROM chunks c LEFT JOIN (SELECT DISTINCT digest FROM chunks WHERE chunk_index = 1) h USING (digest) GROUP BY 1")
def missing_bytes_filtered(chunks):
    """Bytes that each document would upload to a store that holds second chunks only."""
    return bitmaps.missing(chunks, chunks.where("chunk_index = 1").select("digest").distinct())


@query("content_digests", ["documents"], """WITH pieces AS (SELECT doc_id, i, substr(coalesce(text, ''), i * 1000 + 1, 1000) AS piece FROM (SELECT doc_id, text, unnest(range(0, greatest(1, (length(coalesce(text, '')) + 999) // 1000))) AS i FROM documents))
, stored AS (SELECT doc_id, i, CASE WHEN (doc_id * 31 + i) % 97 = 5 THEN NULL WHEN (doc_id * 17 + i) % 89 = 7 THEN piece || '!' ELSE piece END AS piece FROM pieces)
, whole AS (SELECT doc_id, CASE WHEN count(piece) = count(*) THEN sha256(string_agg(piece, '' ORDER BY i)) END AS digest FROM stored GROUP BY 1)
SELECT doc_id, digest, CASE WHEN digest IS NULL THEN 'missing' WHEN digest <> sha256(coalesce(text, '')) THEN 'corrupt' ELSE 'whole' END AS verdict FROM whole JOIN documents USING (doc_id)""")
def content_digests(documents):
    """Documents as contents of chunks, some lost and some changed: digest in order, and verdict."""
    text = F.coalesce("text", F.lit(""))
    cut = documents.select("doc_id", F.posexplode(F.when(F.length(text) > 0, F.regexp_extract_all(text, F.lit("(?s).{1,1000}"), F.lit(0))).otherwise(F.array(F.lit("")))).alias("i", "piece"))
    damaged = F.when((F.col("doc_id") * 31 + F.col("i")) % 97 == 5, F.lit(None)).when((F.col("doc_id") * 17 + F.col("i")) % 89 == 7, F.concat("piece", F.lit("!"))).otherwise(F.col("piece"))
    found = files.content_verdicts(cut.select("doc_id", "i", F.encode(damaged, "UTF-8").alias("content")), ["doc_id"], "i", "content")
    joined = found.join(documents.select("doc_id", F.sha2(text, 256).alias("wanted")), "doc_id")
    return joined.select("doc_id", "digest", F.when(F.col("digest").isNull(), "missing").when(F.col("digest") != F.col("wanted"), "corrupt").otherwise("whole").alias("verdict"))


@query("profiles_by_day", ["observations"], f"{PROFILE}, {PREDICTED} SELECT task_type, variant_id, input_bucket, samples, p50, p95, p99, round(ewma, 6) AS ewma, peak AS peak_memory_bytes, round(failure, 6) AS failure, round(1 / greatest(ewma, 2.220446049250313e-16), 6) AS throughput, round(doubt, 6) AS doubt FROM predicted")
def profiles_by_day(observations):
    """Predictions from the states of days, as a store of profiles merges them on read."""
    return rounded(profiles.predictions(profiles.day_states(observations), 20), "ewma", "failure", "throughput", "doubt")


@query("audit_log_stored", ["events"], f"WITH RECURSIVE {AUDIT}, {CHAIN}".replace("SELECT l.event_id, l.node, l.body, r.n AS sequence", "SELECT l.node, l.body, r.n AS sequence"))
def audit_log_stored(events):
    """Audit logs written as lines of JSON and read back, their chains checked on the way."""
    path = shared_path(events.sparkSession, "audit")
    log = audit_log(events).select("sequence", F.col("sequence").alias("tick"), "node", "body", "previous_hash", "event_hash")
    files.write_audit(log, path)
    return files.read_audit(events.sparkSession, path).select("node", "body", "sequence", "previous_hash", "event_hash")


@query("snapshot_stored", ["catalog"], "SELECT digest, size, targets, healthy, policy FROM catalog")
def snapshot_stored(catalog):
    """A snapshot of the catalogue, replaced as a whole and read by its schema."""
    spark, path = catalog.sparkSession, shared_path(catalog.sparkSession, "snapshot")
    files.write_snapshot(catalog.select("digest").where("digest % 2 = 0"), path)
    files.write_snapshot(catalog.select("digest", "size", "targets", "healthy", "policy"), path)
    return files.read_snapshot(spark, path, "digest long, size long, targets long, healthy long, policy string")


@query("catalog_stored", ["catalog"], "SELECT digest, size, policy, retain_until FROM catalog")
def catalog_stored(catalog):
    """The catalogue as JSON and back."""
    path = shared_path(catalog.sparkSession, "catalog")
    files.write_catalog(catalog.select("digest", "size", "policy", "retain_until"), path)
    return files.read_catalog(catalog.sparkSession, path, "digest long, size long, policy string, retain_until int")


@query("report_stored", ["fault_transitions"], "SELECT concat('distributed.durability.', replace(stage, '_', '-')) AS case_id, stage, count(*) AS n, round(median(transition_ns), 6) AS median, median(reopen_ns) AS reopen_median_ns FROM fault_transitions GROUP BY stage")
def report_stored(transitions):
    """A report of durability cases through its sink and back."""
    path = shared_path(transitions.sparkSession, "report")
    files.write_report(rounded(reports.merge_faults(transitions), "median", "mad"), ["stage"], path)
    return files.read_report(transitions.sparkSession, path, "stage: string", "n: long, median: double, reopen_median_ns: double")
