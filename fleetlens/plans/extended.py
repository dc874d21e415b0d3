"""Further queries: windows of mutations, hysteresis, grants, manifests, quorums and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import fleet
from fleetlens.operators import aggregates, content, placement, scheduling, state, trust
from fleetlens.plans.catalog import query, rounded


@query("mutation_windows", ["mutations"], "SELECT task_id, (rn - 1) // 25 AS batch, count(*) AS n, min(event_id) AS least, max(event_id) AS most FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) AS rn FROM mutations) GROUP BY 1, 2")
def mutation_windows(mutations):
    return state.count_windows(mutations, ["task_id"], ["ts", "event_id"], 25).groupBy("task_id", "batch").agg(F.count("*").alias("n"), F.min("event_id").alias("least"), F.max("event_id").alias("most"))


@query("hysteresis", ["pulses"], """, marked AS (SELECT *, k >= 50 AS over, row_number() OVER w AS tick, CASE WHEN k >= 50 AND coalesce(lag(k) OVER w, 0) >= 50 AND lag(health) OVER w = health THEN 0 ELSE 1 END AS cut FROM pulses WINDOW w AS (PARTITION BY node ORDER BY ts, event_id))
, islands AS (SELECT *, sum(cut) OVER (PARTITION BY node ORDER BY tick) AS island FROM marked)
, dwelt AS (SELECT node, over AND tick - min(tick) OVER (PARTITION BY node, island) >= 3 AS due FROM islands)
SELECT node, count(*) AS pulses, CAST(sum(CASE WHEN due THEN 1 ELSE 0 END) AS BIGINT) AS due FROM dwelt GROUP BY 1""")
def hysteresis(pulses):
    marked = state.dwell(pulses, "node", ["ts", "event_id"], F.col("health"), F.col("k") >= 50, 3)
    return marked.groupBy("node").agg(F.count("*").alias("pulses"), F.count_if("due").alias("due"))


@query("pressure_ewma", ["pulses"], "SELECT node, least(100, (list_reduce(list_prepend(CAST(0 AS BIGINT), list(k ORDER BY ts, event_id)), lambda a, p: (8 * a + 200 * p) // 10) + 50) // 100) AS pressure FROM pulses GROUP BY 1")
def pressure_ewma(pulses):
    return state.integer_pressure(pulses, "node", ["ts", "event_id"], "k")


@query("telemetry_counters", ["events"], "SELECT user_id AS node, date_trunc('day', ts) AS tick, event_type AS name, count(*) AS n FROM events GROUP BY 1, 2, 3")
def telemetry_counters(events):
    return events.groupBy(F.col("user_id").alias("node"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("tick"), F.col("event_type").alias("name")).agg(F.count("*").alias("n"))


@query("worker_load", ["attempts"], """SELECT node, CAST(sum(CASE WHEN active AND l_quantity < 30 THEN 1 ELSE 0 END) AS BIGINT) AS running, CAST(sum(CASE WHEN active AND l_quantity >= 30 AND l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS ready,
 CAST(sum(CASE WHEN active AND l_quantity >= 30 AND l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS waiting, CAST(sum(CASE WHEN active AND l_quantity >= 30 AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS blocked,
 CASE WHEN max(CASE WHEN active AND l_quantity < 30 THEN 1 ELSE 0 END) = 0 THEN 'ready' ELSE 'busy' END AS health, sum(CASE WHEN active THEN l_quantity ELSE 0 END) AS reserved FROM attempts GROUP BY 1""")
def worker_load(attempts):
    """A worker's tasks by state; it is ready only while none runs."""
    queued = F.col("active") & (F.col("l_quantity") >= 30)
    running = F.count_if(F.col("active") & (F.col("l_quantity") < 30))
    states = [F.count_if(queued & (F.col("l_returnflag") == flag)).alias(name) for flag, name in (("A", "ready"), ("N", "waiting"), ("R", "blocked"))]
    reserved = F.sum(F.when(F.col("active"), F.col("l_quantity")).otherwise(0.0)).alias("reserved")
    return attempts.groupBy("node").agg(running.alias("running"), *states, F.when(running == 0, "ready").otherwise("busy").alias("health"), reserved)


@query("inputs_recoverable", ["orders", "catalog"], """, inputs AS (SELECT o_custkey, o_orderkey FROM orders)
SELECT i.o_custkey AS task_id, bool_and(coalesce(CASE c.policy WHEN 'ephemeral' THEN false WHEN 'reconstructible' THEN true ELSE c.healthy >= 2 END, false)) AS recoverable, coalesce(min(c.healthy), 0) AS least_copies
FROM inputs i LEFT JOIN catalog c ON c.digest = i.o_orderkey GROUP BY 1""")
def inputs_recoverable(orders, catalog):
    inputs = orders.select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("digest"))
    return content.inputs_recoverable(inputs, catalog, 2)


@query("unreferenced_chunks", ["chunks"], "SELECT digest, max(size) AS size FROM chunks WHERE doc_id % 2 = 1 AND digest NOT IN (SELECT digest FROM chunks WHERE doc_id % 2 = 0) GROUP BY 1")
def unreferenced_chunks(chunks):
    """Chunks that only removed documents (odd ids) hold."""
    return content.unreferenced(chunks.where("doc_id % 2 = 1"), chunks.where("doc_id % 2 = 0"))


@query("manifest_check", ["chunks", "documents"], """, totals AS (SELECT doc_id, CAST(length(text) AS BIGINT) AS total FROM documents)
SELECT c.doc_id, count(*) AS chunks, min(chunk_index) = 0 AND max(chunk_index) = count(*) - 1 AND count(DISTINCT chunk_index) = count(*) AND min(size) > 0 AND max(size) <= 256 AND sum(size) = max(t.total) AS valid FROM chunks c JOIN totals t USING (doc_id) GROUP BY 1""")
def manifest_check(chunks, documents):
    return content.manifest_check(chunks, documents.select("doc_id", F.length("text").alias("total")), 256)


@query("granted_results", ["attempts"], """, grants AS (SELECT task_id, attempt AS g_attempt, node AS g_node, l_quantity AS until FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY attempt DESC) AS rn FROM attempts) WHERE rn = 1)
SELECT a.task_id, a.attempt, CASE WHEN g.until <= 10 THEN 'grant_expired' WHEN a.attempt = g.g_attempt AND a.node = g.g_node THEN 'accepted' ELSE 'fenced' END AS verdict FROM attempts a LEFT JOIN grants g USING (task_id)""")
def granted_results(attempts):
    grants = state.latest_grants(attempts.withColumnRenamed("l_quantity", "until"))
    return state.validate_results(attempts.select("task_id", "attempt", "node"), grants, 10).select("task_id", "attempt", "verdict")


@query("candidate_index", ["requests", "nodes"], "SELECT r.required_bits, n.node_id FROM (SELECT DISTINCT required_bits FROM requests) r JOIN nodes n ON (n.bits & r.required_bits) = r.required_bits")
def candidate_index(requests, nodes):
    return scheduling.with_required_bits(requests.select("required_bits").distinct(), nodes).select("required_bits", "node_id")


@query("governance_quorum", ["votes"], "SELECT task_id, count(*) AS signers, count(*) >= 3 AND bool_and(digest <> 'R') AS passed FROM votes GROUP BY 1")
def governance_quorum(votes):
    return trust.quorum(votes, F.col("digest") != "R", 3)


@query("heartbeat_gate", ["events"], "SELECT event_type, median(most) AS median_of_most, median(most) < 480 AS passed FROM (SELECT event_type, user_id, max(value) AS most FROM events GROUP BY 1, 2) GROUP BY 1")
def heartbeat_gate(events):
    return aggregates.median_of_most(events, ["event_type"], ["user_id"], "value").withColumn("passed", F.col("median_of_most") < 480)


@query("correctness_gate", ["observations"], "SELECT task_type, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) AS BIGINT) AS failures, bool_and(NOT failed) AS passed FROM observations GROUP BY 1")
def correctness_gate(observations):
    return observations.groupBy("task_type").agg(F.count_if("failed").alias("failures"), F.bool_and(~F.col("failed")).alias("passed"))


@query("audit_segments", ["events"], "SELECT (event_id - 1) // 1000 AS segment, count(*) AS records, min(event_id) AS first_sequence, max(event_id) AS last_sequence FROM events WHERE event_id >= 1 GROUP BY 1")
def audit_segments(events):
    return events.where("event_id >= 1").groupBy(F.expr("(event_id - 1) div 1000").alias("segment")).agg(F.count("*").alias("records"), F.min("event_id").alias("first_sequence"), F.max("event_id").alias("last_sequence"))


@query("digest_check", ["chunks"], "SELECT doc_id, chunk_index, regexp_full_match(d, '[0-9a-f]{64}') AS localisable, regexp_full_match(d, '[0-9a-fA-F]{64}') AS storable FROM (SELECT doc_id, chunk_index, CASE chunk_index % 3 WHEN 0 THEN digest WHEN 1 THEN upper(digest) ELSE substr(digest, 2) END AS d FROM chunks)")
def digest_check(chunks):
    d = F.when(F.col("chunk_index") % 3 == 0, F.col("digest")).when(F.col("chunk_index") % 3 == 1, F.upper("digest")).otherwise(F.expr("substr(digest, 2)"))
    return chunks.select("doc_id", "chunk_index", fleet.lower_digest(d).alias("localisable"), fleet.any_digest(d).alias("storable"))


@query("fallback_outcome", ["attempts"], """, tried AS (SELECT task_id, attempt, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'rejected' ELSE 'broken' END AS outcome FROM attempts WHERE attempt <= 3)
SELECT task_id, coalesce(min(CASE WHEN outcome <> 'rejected' THEN attempt END), 0) AS ended_at, coalesce(arg_min(CASE WHEN outcome <> 'rejected' THEN outcome END, CASE WHEN outcome <> 'rejected' THEN attempt END), 'exhausted') AS outcome FROM tried GROUP BY 1""")
def fallback_outcome(attempts):
    outcome = F.when(F.col("l_returnflag") == "A", "accepted").when(F.col("l_returnflag") == "R", "rejected").otherwise("broken")
    return placement.first_outcome(attempts.select("task_id", F.col("attempt").alias("rank"), outcome.alias("outcome")), 2)
