"""Queries of placement, priorities, admission and budgets, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions.oracles import fold_sql
from fleetlens.operators import flow, placement, scheduling
from fleetlens.plans.catalog import PROFILE, query, rounded

KIND = ", ".join(scheduling.KIND)
R = ", ".join(f"r.{c}" for c in scheduling.KIND)
RARE = "rare AS (SELECT m, count(*) AS n FROM (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128]) AS m, bits FROM sched_nodes) WHERE bits & m <> 0 GROUP BY 1 HAVING count(*) <= 2)"
HARD = """hard AS (SELECT k.*, n.* EXCLUDE (content_a, content_b), CASE WHEN n.content_a = k.content_a THEN 1 ELSE 0 END + CASE WHEN n.content_b = k.content_b THEN 1 ELSE 0 END AS here FROM kinds k JOIN sched_nodes n
  ON (n.bits & k.required_bits) = k.required_bits AND n.health = 'healthy' AND n.identity = 'active' AND n.integrity AND n.trust >= k.minimum_trust AND coalesce(n.os = k.required_os, true) AND coalesce(n.abi = k.required_abi, true)
  AND n.memory >= k.required_memory AND n.vram >= k.required_vram AND (NOT k.local_only OR n.idx = k.local_idx))"""
KINDS = f"kinds AS MATERIALIZED (SELECT row_number() OVER () AS kid, * FROM (SELECT DISTINCT {KIND} FROM sched_requests))"
PREDICTED = """predicted AS (SELECT p.*, greatest(20 - p.samples, 0) / 20.0 AS doubt, e.ewma, e.peak FROM profile p JOIN (SELECT task_type, variant_id, input_bucket, max(peak_memory_bytes) AS peak,
  list_reduce(list(latency_ticks ORDER BY ts, event_id), lambda a, x: a * 0.8 + x * 0.2) AS ewma FROM observations GROUP BY 1, 2, 3) e USING (task_type, variant_id, input_bucket))"""
RANKED = f"""{KINDS}, {RARE}, {HARD}
, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kid ORDER BY pressure - 5 * here, node_id) AS place FROM hard h WHERE h.required_generation IS NULL OR h.idx IN (SELECT idx FROM sched_variants p WHERE p.generation = h.required_generation)) WHERE place <= 4)
, looked AS (SELECT * FROM (SELECT n.*, v.* EXCLUDE (idx), row_number() OVER (PARTITION BY kid ORDER BY place, v) AS number FROM near n JOIN sched_variants v USING (idx)) WHERE number <= 12)
, fit AS (SELECT l.*, queue + rtt + input_transfer + execution + output_transfer + prewarm + commit_cost + recovery + jitter AS total, greatest(coalesce(p.failure, base_failure), base_failure) AS failure,
  coalesce(p.p50, execution) AS p50, coalesce(p.p95, execution + jitter) AS p95, coalesce(p.p99, execution + 2 * jitter) AS p99, coalesce(p.doubt, 1.0) AS doubt
  FROM looked l LEFT JOIN predicted p USING (task_type, variant_id, input_bucket)
  WHERE (bits & need) = need AND peak_memory <= memory AND peak_vram <= vram AND coalesce(generation = required_generation, true) AND quality >= minimum_quality AND (NOT exact OR quality >= 1))
, levels AS (SELECT *, idx = local_idx AS is_local FROM fit WHERE total <= deadline AND p95 <= max_p95 AND p99 <= max_p99 AND jitter <= max_jitter AND failure <= max_failure AND (NOT streaming OR ((max_ttft IS NULL OR coalesce(ttft <= max_ttft, false)) AND (max_steady IS NULL OR coalesce(steady <= max_steady, false)))))
, costed AS (SELECT *, queue + rtt + CASE WHEN is_local THEN 0 ELSE input_transfer + output_transfer END + prewarm + p50 + commit_cost + jitter + failure * recovery
  + CASE WHEN session_idx IS NULL THEN 0 WHEN session_idx = idx THEN -least(migration, total * 0.25) ELSE migration END + greatest(0.0, dag_cross - dag_benefit) AS remote_cost FROM levels)
, risked AS (SELECT *, remote_cost + greatest(0.0, 1 - quality) * 1000 + 25 * (SELECT count(*) FROM rare WHERE bits & m <> 0 AND required_bits & m = 0)
  + doubt * CASE WHEN latency_class IN ('cluster_safety', 'hard_realtime', 'soft_realtime') THEN 50 ELSE 10 END + energy AS risk_cost FROM costed)"""
SAME_KIND = " AND ".join(f"r.{c} IS NOT DISTINCT FROM k.{c}" for c in scheduling.KIND)


def predictions(observations):
    return placement.predictions(observations, scheduling.Limits().samples)


VALID = " AND ".join([*(f"coalesce(isfinite(CAST({c} AS DOUBLE)), false)" for c in scheduling.FINITE), *(f"{c} >= 0" for c in scheduling.NOT_NEGATIVE)])
PLACED = f"""{PROFILE}, {PREDICTED}, {RANKED}
, asked AS (SELECT r.*, k.kid, {VALID.replace("(CAST(", "(CAST(r.").replace(" AND local_cost >=", " AND r.local_cost >=").replace(" AND safety_margin >=", " AND r.safety_margin >=").replace(" AND minimum_quality >=", " AND r.minimum_quality >=").replace(" AND max_failure >=", " AND r.max_failure >=")} AS valid, r.local_only OR r.local_bound OR r.local_cost <= r.small_task OR r.latency_class = 'hard_realtime' AS stays FROM sched_requests r JOIN kinds k ON {SAME_KIND})
, good AS (SELECT a.task_id, c.node_id, c.variant_id, c.risk_cost, c.remote_cost, row_number() OVER (PARTITION BY a.task_id ORDER BY c.risk_cost, c.node_id, c.number) AS rk, count(*) OVER (PARTITION BY a.task_id) AS many
  FROM asked a JOIN risked c USING (kid) WHERE a.valid AND (c.is_local OR (NOT a.stays AND a.local_cost > c.remote_cost + a.safety_margin)))
, counted AS (SELECT kid, count(*) AS n FROM looked GROUP BY 1)
SELECT a.task_id, CASE WHEN NOT a.valid THEN 'invalid' WHEN g.task_id IS NULL THEN 'unavailable' ELSE 'placed' END AS status, g.node_id, g.variant_id, round(g.risk_cost, 6) AS risk_cost, round(g.remote_cost, 6) AS remote_cost,
  CASE WHEN g.task_id IS NOT NULL THEN CAST(least(g.many - 1, 4) AS BIGINT) END AS fallbacks, CASE WHEN a.valid THEN coalesce(n.n, 0) END AS evaluated, CASE WHEN g.task_id IS NOT NULL THEN round(a.local_cost - g.remote_cost - a.safety_margin, 6) END AS margin
FROM asked a LEFT JOIN (SELECT * FROM good WHERE rk = 1) g USING (task_id) LEFT JOIN counted n USING (kid)"""


@query("placement_full", ["sched_requests", "sched_nodes", "sched_variants", "observations"], PLACED)
def placement_full(requests, nodes, variants, observations):
    """The best candidate of each request, under its own service level, of requests of 240 kinds."""
    return rounded(scheduling.place(requests, nodes, variants, predictions(observations)), "risk_cost", "remote_cost", "margin")


@query("placement_each", ["sched_each", "sched_nodes", "sched_variants", "observations"], PLACED.replace("sched_requests", "sched_each"))
def placement_each(requests, nodes, variants, observations):
    """The same with about as many kinds as requests: each has its own node, session and contents."""
    return rounded(scheduling.place(requests, nodes, variants, predictions(observations)), "risk_cost", "remote_cost", "margin")


@query("hard_node_filter", ["sched_requests", "sched_nodes"], f", {KINDS}, {HARD}, n AS (SELECT kid, count(*) AS nodes FROM hard GROUP BY 1) SELECT {R}, count(*) AS requests, coalesce(max(n.nodes), 0) AS nodes FROM sched_requests r JOIN kinds k ON {SAME_KIND} LEFT JOIN n USING (kid) GROUP BY {R}")
def hard_node_filter(requests, nodes):
    """Requests of each kind and how many nodes pass its hard filter."""
    kinds = scheduling.with_kind(requests.groupBy(*scheduling.KIND).agg(F.count("*").alias("requests")))
    pairs = scheduling.with_required_bits(kinds.drop("content_a", "content_b"), nodes, 64)
    passed = scheduling.hard_nodes(pairs).where("not local_only or idx = local_idx").groupBy("kind").agg(F.count("*").alias("nodes"))
    return kinds.join(passed, "kind", "left").withColumn("nodes", F.coalesce("nodes", F.lit(0))).drop("kind")


@query("scarcity_penalty", ["sched_requests", "sched_nodes"], f", {RARE} SELECT r.required_bits, n.idx, (SELECT count(*) FROM rare WHERE n.bits & m <> 0 AND r.required_bits & m = 0) * 25.0 AS scarcity FROM (SELECT DISTINCT required_bits FROM sched_requests) r JOIN sched_nodes n ON (n.bits & r.required_bits) = r.required_bits")
def scarcity_penalty(requests, nodes):
    return scheduling.scarcity(requests.select("required_bits").distinct(), nodes)


@query("request_validation", ["sched_requests"], f"SELECT task_id, {VALID} AS valid FROM sched_requests")
def request_validation(requests):
    return requests.select("task_id", scheduling.finite_request().alias("valid"))


@query("priority_pop", ["priorities"], "SELECT queue, task_id, row_number() OVER (PARTITION BY queue ORDER BY safety DESC, recovery DESC, class_rank DESC, local_origin DESC, deadline DESC, dag DESC, unlock DESC, business DESC, age DESC, fair_share DESC, task_id) AS place FROM priorities")
def priority_pop(tasks):
    """The order in which each queue gives out its tasks, by all ten keys."""
    return scheduling.priority_order(tasks, "queue").select("queue", "task_id", "place")


@query("profile_prediction", ["observations"], f"{PROFILE}, {PREDICTED} SELECT task_type, variant_id, input_bucket, samples, p50, p95, p99, round(ewma, 6) AS ewma, peak AS peak_memory_bytes, round(failure, 6) AS failure, round(1 / greatest(ewma, 2.220446049250313e-16), 6) AS throughput, round(doubt, 6) AS doubt FROM predicted")
def profile_prediction(observations):
    return rounded(predictions(observations), "ewma", "failure", "throughput", "doubt")


LIVE = "list_filter(r.live, lambda x: x.u > l.tick)"
TOTAL = lambda f: f"coalesce(list_sum(list_transform({LIVE}, lambda x: x.{f})), 0)"
LIMIT = lambda most, kept: f"({most} - CASE WHEN l.remote THEN {kept} ELSE 0 END)"
OUTCOME = f"""CASE WHEN l.version <> 1 THEN 'capability_changed' WHEN l.lasts <= 0 THEN 'retry_after' WHEN l.remote AND l.pressure >= 70 THEN 'overloaded'
 WHEN {TOTAL('m')} + l.memory > {LIMIT(200, 80)} OR {TOTAL('v')} + l.vram > {LIMIT(60, 20)} THEN 'insufficient_memory' WHEN {TOTAL('c')} + l.cpu > {LIMIT(8, 4)} OR {TOTAL('t')} + l.threads > {LIMIT(8, 4)} THEN 'overloaded' ELSE 'accept' END"""
HELD = f"""CASE WHEN {OUTCOME} = 'accept' THEN list_append(list_filter({LIVE}, lambda x: x.i <> l.reservation_id), {{'i': l.reservation_id, 'c': CAST(l.cpu AS BIGINT), 'm': l.memory, 'v': l.vram, 't': CAST(l.threads AS BIGINT), 'u': l.tick + l.lasts}}) ELSE {LIVE} END"""


@query("reservation_admission", ["reservations"], ", " + fold_sql("reservations", "node", "tick", {
    "outcome": ("CAST('' AS VARCHAR)", OUTCOME), "live": ("CAST([] AS STRUCT(i VARCHAR, c BIGINT, m BIGINT, v BIGINT, t BIGINT, u BIGINT)[])", HELD),
}, "l.node, l.tick, r.outcome, CAST(coalesce(list_sum(list_transform(r.live, lambda x: x.c)), 0) AS BIGINT) AS cpu, CAST(coalesce(list_sum(list_transform(r.live, lambda x: x.m)), 0) AS BIGINT) AS memory"))
def reservation_admission(reservations):
    """Outcome of each reservation and what its node holds after it."""
    return scheduling.admit_reservations(reservations)


CLASS = "CASE l.event_id % 3 WHEN 0 THEN 'correctness' WHEN 1 THEN 'summary' ELSE 'discardable' END"
TAKEN = f"({CLASS} = 'correctness' OR (r.used < 4 AND {CLASS} = 'summary' AND l.k < 90) OR (r.used < 4 AND {CLASS} = 'discardable' AND l.k < 60))"


@query("telemetry_admission", ["pulses"], ", days AS (SELECT *, node * 100000 + date_diff('day', TIMESTAMP '2000-01-01', ts) AS slot FROM pulses), " + fold_sql("days", "slot", "ts, event_id", {
    "accepted": ("false", TAKEN), "used": ("CAST(0 AS BIGINT)", f"r.used + CASE WHEN {TAKEN} THEN 1 ELSE 0 END"),
}, "l.event_id, r.accepted, r.used"))
def telemetry_admission(pulses):
    """Which records a node takes each day: correctness always, the others within the day's budget and pressure."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("correctness", "summary", "discardable")]), (F.col("event_id") % 3 + 1).cast("int"))
    slot = F.col("node") * 100000 + F.datediff("ts", F.lit("2000-01-01"))
    return flow.telemetry_admission(pulses.select("event_id", "ts", "k", kind.alias("class"), slot.alias("slot")), ["slot"], ["ts", "event_id"], 4)


@query("sampling_interval", ["pulses"], ", " + fold_sql("pulses", "node", "ts, event_id", {"rounds": ("CAST(0 AS BIGINT)", "CASE WHEN l.health <> 'healthy' OR l.k >= 70 THEN 0 ELSE least(r.rounds + 1, 16) END")}, "l.event_id, CAST(least(2 * pow(2, least(r.rounds, 6)), 100) AS BIGINT) AS next_after"))
def sampling_interval(pulses):
    """Ticks until a node's next sample: doubled while nothing changes, reset by a change or by pressure."""
    return flow.sampling_interval(pulses, ["node"], ["ts", "event_id"], (F.col("health") != "healthy") | (F.col("k") >= 70), 2, 100).select("event_id", "next_after")


QUEUE_PERCENT = "(r.queued * 100 // 4000)"
CONTROL_ONLY = f"(l.k >= 90 AND greatest(l.k, {QUEUE_PERCENT}) >= 90)"
OK = f"""CASE l.op WHEN 'tick' THEN true WHEN 'enqueue' THEN NOT l.forwarding AND NOT {CONTROL_ONLY} AND r.queued + l.bytes <= 4000 WHEN 'start' THEN r.active < 3 AND l.bytes <= r.queued AND r.data + l.bytes <= 1500
 WHEN 'complete' THEN r.active > 0 ELSE r.control + l.bytes <= 500 END"""


@query("network_budget", ["traffic"], ", " + fold_sql("traffic", "node", "ts, event_id", {
    "ok": ("false", OK), "queued": ("CAST(0 AS BIGINT)", f"r.queued + CASE WHEN {OK} THEN CASE l.op WHEN 'enqueue' THEN l.bytes WHEN 'start' THEN -l.bytes ELSE 0 END ELSE 0 END"),
    "data": ("CAST(0 AS BIGINT)", f"CASE WHEN l.op = 'tick' THEN 0 WHEN l.op = 'start' AND {OK} THEN r.data + l.bytes ELSE r.data END"),
    "control": ("CAST(0 AS BIGINT)", f"CASE WHEN l.op = 'tick' THEN 0 WHEN l.op = 'control' AND {OK} THEN r.control + l.bytes ELSE r.control END"),
    "active": ("CAST(0 AS BIGINT)", f"r.active + CASE WHEN {OK} THEN CASE l.op WHEN 'start' THEN 1 WHEN 'complete' THEN -1 ELSE 0 END ELSE 0 END"),
}, "l.event_id, r.ok, r.queued, r.active"))
def network_budget(traffic):
    """A node's network: queue and concurrency of data, bytes a tick, and a reserve for control."""
    return flow.network_budget(traffic, ["node"], ["ts", "event_id"], flow.Network(bytes_a_tick=2000, control=500, queued=4000, concurrent=3))


TAKES = "CASE l.op WHEN 'enqueue' THEN l.bytes <= 800 AND r.held + l.bytes <= 3000 WHEN 'start' THEN r.flying < 2 AND len(r.items) > 0 WHEN 'complete' THEN r.flying > 0 END"


@query("transfer_queue", ["traffic"], ", " + fold_sql("(SELECT * FROM traffic WHERE op IN ('enqueue', 'start', 'complete'))", "node", "ts, event_id", {
    "ok": ("false", TAKES), "started": ("CAST(NULL AS BIGINT)", f"CASE WHEN l.op = 'start' AND {TAKES} THEN r.items[1].e END"),
    "held": ("CAST(0 AS BIGINT)", f"r.held + CASE WHEN l.op = 'enqueue' AND {TAKES} THEN l.bytes WHEN l.op = 'start' AND {TAKES} THEN -r.items[1].b ELSE 0 END"),
    "items": ("CAST([] AS STRUCT(e BIGINT, b BIGINT)[])", f"CASE WHEN l.op = 'enqueue' AND {TAKES} THEN list_append(r.items, {{'e': l.event_id, 'b': l.bytes}}) WHEN l.op = 'start' AND {TAKES} THEN r.items[2:] ELSE r.items END"),
    "flying": ("CAST(0 AS BIGINT)", f"r.flying + CASE WHEN l.op = 'start' AND {TAKES} THEN 1 WHEN l.op = 'complete' AND {TAKES} THEN -1 ELSE 0 END"),
}, "l.event_id, r.ok, r.started, r.held"))
def transfer_queue(traffic):
    """First in, first out: chunks queued within their bytes and started within the number in flight."""
    asked = traffic.where(F.col("op").isin("enqueue", "start", "complete"))
    return flow.transfer_queue(asked, ["node"], ["ts", "event_id"], flow.Transfers(chunk=800, queued=3000, concurrent=2))


FITS = "(r.compute + l.k <= 150 AND r.network + l.bytes <= 1500 AND r.storage + l.k * 3 <= 400)"


@query("heavy_work_budget", ["traffic"], ", days AS (SELECT *, node * 100000 + date_diff('day', TIMESTAMP '2000-01-01', ts) AS slot FROM traffic), " + fold_sql("days", "slot", "ts, event_id", {
    "admitted": ("false", FITS), "compute": ("CAST(0 AS BIGINT)", f"r.compute + CASE WHEN {FITS} THEN l.k ELSE 0 END"), "network": ("CAST(0 AS BIGINT)", f"r.network + CASE WHEN {FITS} THEN l.bytes ELSE 0 END"),
    "storage": ("CAST(0 AS BIGINT)", f"r.storage + CASE WHEN {FITS} THEN l.k * 3 ELSE 0 END"),
}, "l.event_id, r.admitted, r.compute"))
def heavy_work_budget(traffic):
    """Work that is admitted as a whole or not at all, within three budgets a tick."""
    slot = F.col("node") * 100000 + F.datediff("ts", F.lit("2000-01-01"))
    work = traffic.select("event_id", "ts", slot.alias("slot"), F.col("k").alias("compute"), F.col("bytes").alias("network"), (F.col("k") * 3).alias("storage"))
    return flow.joint_budget(work, ["slot"], ["ts", "event_id"], {"compute": 150, "network": 1500, "storage": 400}).select("event_id", "admitted", F.col("used_compute").alias("compute"))


@query("trust_counters", ["traffic"], "SELECT event_id, row_number() OVER (PARTITION BY node, op, date_trunc('day', ts) ORDER BY ts, event_id) <= 2 AS admitted FROM traffic")
def trust_counters(traffic):
    """Signatures, verifications and the like: the first few of a tick, each counted by itself."""
    return flow.count_budget(traffic, ["node", "op", F.date_trunc("day", "ts")], ["ts", "event_id"], 2).select("event_id", "admitted")


@query("coalesced_transfers", ["traffic"], """, asked AS (SELECT k AS content, ts, event_id, max(epoch_us(ts) + bytes * 10000000) OVER (PARTITION BY k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_until FROM traffic WHERE op = 'enqueue')
SELECT content, count(*) AS requests, CAST(sum(CASE WHEN open_until IS NULL OR epoch_us(ts) >= open_until THEN 1 ELSE 0 END) AS BIGINT) AS transfers FROM asked GROUP BY 1""")
def coalesced_transfers(traffic):
    """Requests for a content and the transfers they cost: those that come while one is under way wait for it."""
    asked = traffic.where("op = 'enqueue'").select(F.col("k").alias("content"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("since"), (F.unix_micros(F.col("ts").cast("timestamp")) + F.col("bytes") * 10_000_000).alias("until"))
    return flow.coalesce_transfers(asked, "content", ["since", "event_id"])


@query("flag_union", ["priorities"], "SELECT queue, CAST(bit_or(CASE WHEN safety THEN 1 ELSE 0 END | CASE WHEN recovery THEN 2 ELSE 0 END | CASE WHEN local_origin THEN 4 ELSE 0 END) AS BIGINT) AS flags FROM priorities GROUP BY 1")
def flag_union(tasks):
    flags = F.col("safety").cast("long") + F.col("recovery").cast("long") * 2 + F.col("local_origin").cast("long") * 4
    return tasks.groupBy("queue").agg(F.bit_or(flags).alias("flags"))


PROFILE_STEP = "CASE WHEN list_contains(r.held, l.profile) THEN r.held WHEN len(r.held) >= 4 THEN list_sort(list_append(r.held[2:], l.profile)) ELSE list_sort(list_append(r.held, l.profile)) END"


@query("bounded_profiles", ["pulses"], ", keyed AS (SELECT *, k % 9 AS profile FROM pulses), " + fold_sql("keyed", "node", "ts, event_id", {
    "evicted": ("CAST(NULL AS BIGINT)", "CASE WHEN NOT list_contains(r.held, l.profile) AND len(r.held) >= 4 THEN r.held[1] END"), "held": ("CAST([] AS BIGINT[])", PROFILE_STEP),
}, "l.event_id, r.evicted, CAST(len(r.held) AS BIGINT) AS profiles"))
def bounded_profiles(pulses):
    """A model of at most four profiles a node: a new one drives out the smallest key."""
    return flow.bounded_keys(pulses.withColumn("profile", F.col("k") % 9), ["node"], ["ts", "event_id"], "profile", 4)
