"""Queries of joins in time and of the event page source, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import state, temporal
from fleetlens.plans.catalog import ORACLES, QUERIES, query
from fleetlens.sources import event_pages


@query("moments_authorised", ["moments", "validities"], """SELECT m.task_id, m.number, m.tick, count(v.node) AS identities, max(v.identity) AS newest, max(v.valid_until) AS until
FROM moments m LEFT JOIN validities v ON v.node = m.node AND m.tick BETWEEN v.valid_from AND v.valid_until GROUP BY m.task_id, m.number, m.tick, m.node""")
def moments_authorised(moments, validities):
    """At each moment of a node's work, how many of its identities' intervals of validity hold it, and the last of them."""
    found = temporal.interval_join(moments, validities, ["node"], "tick", "valid_from", "valid_until")
    best = found.groupBy("task_id", "number", "tick", "node").agg(F.count(F.lit(1)).alias("identities"), F.max("identity").alias("newest"), F.max("valid_until").alias("until"))
    out = moments.groupBy("task_id", "number", "tick", "node").agg(F.lit(1).alias("one")).join(best, ["task_id", "number", "tick", "node"], "left")
    return out.select("task_id", "number", "tick", F.coalesce("identities", F.lit(0)).alias("identities"), "newest", "until")


@query("results_by_grant", ["late_results", "grant_log"], """SELECT r.task_id, r.result, CASE WHEN g.g_attempt IS NULL THEN 'fenced' WHEN r.tick > g.until THEN 'grant_expired' WHEN r.attempt = g.g_attempt AND r.node = g.g_node THEN 'accepted' ELSE 'fenced' END AS verdict, g.entry
FROM late_results r LEFT JOIN (SELECT r.task_id, r.result, max(CAST(g.tick AS HUGEINT) * 1000000000000 + g.entry) AS at FROM late_results r JOIN grant_log g ON g.task_id = r.task_id AND g.tick <= r.tick GROUP BY 1, 2) x USING (task_id, result)
LEFT JOIN (SELECT task_id, tick, entry, until, attempt AS g_attempt, node AS g_node FROM grant_log) g ON g.task_id = r.task_id AND CAST(g.tick AS HUGEINT) * 1000000000000 + g.entry = x.at""")
def results_by_grant(results, grants):
    """Each result against the last grant of its task that was given until then; later grants don't count."""
    held = grants.select("task_id", "tick", "entry", "until", F.col("attempt").alias("g_attempt"), F.col("node").alias("g_node"))
    found = temporal.last_before(results, held, ["task_id"], "tick", ["entry", "until", "g_attempt", "g_node"], ["entry"])
    return found.select("task_id", "result", state.grant_verdict(F.col("tick")).alias("verdict"), "entry")


def event_source(spark, sf_dir: str):
    """The event log through its data source."""
    event_pages.register(spark)
    log = spark.read.format("event_pages").option("sequence", "event_id").option("rowsAPartition", 20_000).load(f"{sf_dir}/events.parquet")
    return log.select("event_id", "user_id", "event_type", "ts")


QUERIES["event_source"] = event_source
ORACLES["event_source"] = "SELECT event_id, user_id, event_type, ts FROM events"
