"""Every registered query of the engine with its DuckDB oracle; all of them read whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import fleet
from fleetlens.functions.oracles import fold_sql
from fleetlens.functions.views import BASE, oracle, view
from fleetlens.operators import aggregates, content, merkle, placement, state, trust

QUERIES: dict = {}
ORACLES: dict = {}
BUCKET = "list_sum(list_transform(range(0, 31), lambda b: CASE WHEN {v} > pow(2, b) THEN 1 ELSE 0 END))"


def query(name: str, views: list[str], sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views])
        derived = [v for v in views if v not in BASE]
        ORACLES[name] = oracle(derived, sql) if derived else sql
        return f

    return add


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


HISTOGRAM = f", hist AS (SELECT task_type, variant_id, input_bucket, CAST({BUCKET.format(v='latency_ticks')} AS INT) AS bucket, count(*) AS n FROM observations GROUP BY 1, 2, 3, 4)"
PROFILE = HISTOGRAM + """, run AS (SELECT *, sum(n) OVER (PARTITION BY task_type, variant_id, input_bucket ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY task_type, variant_id, input_bucket) AS total FROM hist)
, quant AS (SELECT task_type, variant_id, input_bucket, CAST(max(total) AS BIGINT) AS samples,
    pow(2.0, min(CASE WHEN upto >= greatest(1, ceil(total * 50 / 100)) THEN bucket END)) AS p50, pow(2.0, min(CASE WHEN upto >= greatest(1, ceil(total * 95 / 100)) THEN bucket END)) AS p95,
    pow(2.0, min(CASE WHEN upto >= greatest(1, ceil(total * 99 / 100)) THEN bucket END)) AS p99 FROM run GROUP BY 1, 2, 3)
, profile AS (SELECT q.*, f.failure FROM quant q JOIN (SELECT task_type, variant_id, input_bucket, avg(CAST(failed AS DOUBLE)) AS failure FROM observations GROUP BY 1, 2, 3) f USING (task_type, variant_id, input_bucket))"""


@query("eligible_nodes", ["requests", "nodes"], "SELECT r.task_id, coalesce(e.n, 0) AS nodes FROM requests r LEFT JOIN (SELECT q.required_bits, count(*) AS n FROM (SELECT DISTINCT required_bits FROM requests) q JOIN nodes n ON n.healthy AND (n.bits & q.required_bits) = q.required_bits GROUP BY 1) e USING (required_bits)")
def eligible_nodes(requests, nodes):
    counts = placement.eligible(requests.select("required_bits").distinct(), nodes).groupBy("required_bits").agg(F.count("*").alias("nodes"))
    return requests.join(counts, "required_bits", "left").select("task_id", F.coalesce("nodes", F.lit(0)).alias("nodes"))


@query("capability_supply", ["nodes"], "SELECT b AS bit, count(*) AS nodes FROM (SELECT unnest(range(0, 8)) AS b, bits FROM nodes) WHERE (bits >> b) & 1 = 1 GROUP BY 1")
def capability_supply(nodes):
    bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.expr("bits").bitwiseAND(F.pow(F.lit(2), b).cast("bigint")) != 0)
    return nodes.select(F.explode(bits).alias("b")).groupBy(F.col("b").cast("long").alias("bit")).agg(F.count("*").alias("nodes"))


@query("latency_histogram", ["observations"], HISTOGRAM + " SELECT * FROM hist")
def latency_histogram(observations):
    return aggregates.latency_histogram(observations, placement.KEYS, "latency_ticks")


@query("profile_quantiles", ["observations"], PROFILE + " SELECT task_type, variant_id, input_bucket, samples, p50, p95, p99, round(failure, 6) AS failure FROM profile")
def profile_quantiles(observations):
    return rounded(placement.profiles(observations).drop("peak_memory_bytes"), "failure")


@query("profile_ewma", ["observations"], "SELECT task_type, variant_id, input_bucket, count(*) AS samples, round(list_reduce(list(latency_ticks ORDER BY ts, event_id), lambda a, x: a * 0.8 + x * 0.2), 6) AS ewma FROM observations GROUP BY 1, 2, 3")
def profile_ewma(observations):
    return rounded(aggregates.ewma(observations, placement.KEYS, F.col("latency_ticks"), [F.desc("ts"), F.desc("event_id")], 0.2, None, 200, "ewma"), "ewma")


@query("bench_distribution", ["events"], """SELECT e.event_type, count(*) AS n, min(value) AS least, max(value) AS most, round(max(m.median), 6) AS median, round(median(abs(value - m.median)), 6) AS mad, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99
FROM events e JOIN (SELECT event_type, median(value) AS median FROM events GROUP BY 1) m USING (event_type) GROUP BY 1""")
def bench_distribution(events):
    return rounded(aggregates.distribution(events, ["event_type"], "value"), "median", "mad")


@query("alt_percentile", ["events"], "SELECT event_type, count(*) AS n, list_sort(list(value))[(count(*) - 1) * 95 // 100 + 1] AS i95 FROM events GROUP BY 1")
def alt_percentile(events):
    return aggregates.indexed_percentile(events, ["event_type"], "value", 95)


@query("bit_length_histogram", ["events"], "SELECT CASE WHEN v <= 0 THEN 0 ELSE least(length(bin(v)), 63) END AS bucket, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, max(v) AS most FROM (SELECT CAST(floor(value * 1000) AS BIGINT) AS v FROM events) GROUP BY 1")
def bit_length_histogram(events):
    return aggregates.bit_length_histogram(events, F.floor(F.col("value") * 1000))


@query("noise_classification", ["events"], """, d AS (SELECT event_type, user_id % 4 AS lane, median(value) AS median FROM events GROUP BY 1, 2)
, m AS (SELECT e.event_type, e.user_id % 4 AS lane, count(*) AS n, max(e.value) AS most, max(d.median) AS median, median(abs(e.value - d.median)) AS mad FROM events e JOIN d ON d.event_type = e.event_type AND d.lane = e.user_id % 4 GROUP BY 1, 2)
SELECT event_type, lane, n, CASE WHEN NOT most < 320 THEN 'gate_failed' WHEN (SELECT avg(CASE WHEN mad / median > 0.1 THEN 1.0 ELSE 0.0 END) FROM m) > 0.2 THEN 'environmental' WHEN mad / median > 0.1 THEN 'case_specific' ELSE 'none' END AS noise FROM m""".lstrip(", ").join(["WITH ", ""]))
def noise_classification(events):
    rows = aggregates.distribution(events.withColumn("lane", F.col("user_id") % 4), ["event_type", "lane"], "value")
    return aggregates.noise_class(rows, F.col("most") < 320).select("event_type", "lane", "n", "noise")


@query("throughput", ["events"], "SELECT event_type, CAST(count(*) AS DOUBLE) AS units, round(count(*) * 1e9 / greatest(1.0, sum(floor(value * 1000))), 6) AS per_second FROM events GROUP BY 1")
def throughput(events):
    spent = F.sum(F.floor(F.col("value") * 1000).cast("double"))
    return events.groupBy("event_type").agg(F.count("*").cast("double").alias("units"), F.round(F.count("*") * 1e9 / F.greatest(F.lit(1.0), spent), 6).alias("per_second"))


ACTIVE = ", live AS (SELECT task_id, attempt, node FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY attempt DESC) AS rn FROM attempts WHERE active) WHERE rn = 1)"


@query("active_attempt", ["attempts"], ACTIVE + " SELECT * FROM live")
def active_attempt(attempts):
    return state.active_attempts(attempts)


@query("fenced_results", ["attempts"], ACTIVE + " SELECT a.task_id, a.attempt, a.node, coalesce(a.attempt = l.attempt AND a.node = l.node, false) AS accepted FROM attempts a LEFT JOIN live l USING (task_id)")
def fenced_results(attempts):
    return state.fence(attempts.select("task_id", "attempt", "node"), state.active_attempts(attempts))


@query("chunk_dedup", ["chunks"], "SELECT doc_id, count(*) AS chunks, CAST(sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) AS BIGINT) AS uploaded, CAST(sum(CASE WHEN rn > 1 THEN size ELSE 0 END) AS BIGINT) AS reused_size FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY doc_id, chunk_index) AS rn FROM chunks) GROUP BY 1")
def chunk_dedup(chunks):
    return content.dedup(chunks)


@query("missing_bytes", ["chunks"], "SELECT c.doc_id, CAST(sum(CASE WHEN h.digest IS NULL THEN c.size ELSE 0 END) AS BIGINT) AS missing FROM chunks c LEFT JOIN (SELECT DISTINCT digest FROM chunks WHERE chunk_index = 0) h USING (digest) GROUP BY 1")
def missing_bytes(chunks):
    return content.missing(chunks, chunks.where("chunk_index = 0").select("digest").distinct())


@query("changed_chunks", ["chunks"], "SELECT a.doc_id, count(*) AS changed FROM chunks a LEFT JOIN chunks b ON b.doc_id = a.doc_id - 1 AND b.chunk_index = a.chunk_index WHERE NOT (a.digest IS NOT DISTINCT FROM b.digest AND a.size IS NOT DISTINCT FROM b.size) GROUP BY 1")
def changed_chunks(chunks):
    return content.changed(chunks, chunks.withColumn("doc_id", F.col("doc_id") + 1))


@query("recoverable", ["catalog"], "SELECT digest, CASE policy WHEN 'ephemeral' THEN false WHEN 'reconstructible' THEN true ELSE healthy >= 2 END AS recoverable, greatest(2 - healthy, 0) AS copies_missing FROM catalog")
def recoverable(catalog):
    return catalog.select("digest", fleet.recoverable(F.col("policy"), F.col("healthy"), 2).alias("recoverable"), F.greatest(2 - F.col("healthy"), F.lit(0)).alias("copies_missing"))


@query("gc_candidates", ["catalog"], "SELECT digest, size FROM (SELECT *, row_number() OVER (ORDER BY digest) AS rn FROM catalog WHERE refs = 0 AND retain_until <= 1) WHERE rn <= 100")
def gc_candidates(catalog):
    """The first 100 unreferenced and expired digests: the collector's own limit."""
    return catalog.where("refs = 0 and retain_until <= 1").orderBy("digest").limit(100).select("digest", "size")


FITS = "r.taken < 12 AND r.planned + l.bytes <= 500"


@query("repair_plan", ["catalog"], ", todo AS (SELECT digest % 64 AS lane, digest, CAST(size * (2 - healthy) AS BIGINT) AS bytes FROM catalog WHERE policy = 'replicated' AND healthy < 2 AND size > 0), " + fold_sql("todo", "lane", "digest", {
    "planned": ("CAST(0 AS BIGINT)", f"r.planned + CASE WHEN {FITS} THEN l.bytes ELSE 0 END"), "taken": ("CAST(0 AS BIGINT)", f"r.taken + CASE WHEN {FITS} THEN 1 ELSE 0 END"),
}, "l.lane, max(r.n) AS jobs, max(r.planned) AS planned, max(r.taken) AS taken", "n > 0 GROUP BY l.lane"))
def repair_plan(catalog):
    return content.repair_plan(catalog, lanes=64, budget=500, most=12)


@query("tick_budget", ["events"], "SELECT date_trunc('hour', ts) AS tick, count(*) AS offered, round(list_reduce(list_prepend(CAST(0.0 AS DOUBLE), list(value ORDER BY ts, event_id)), lambda a, x: CASE WHEN a + x <= 500 THEN a + x ELSE a END), 6) AS used FROM events GROUP BY 1")
def tick_budget(events):
    return rounded(state.tick_budget(events, F.date_trunc("hour", "ts").cast("timestamp_ntz"), "value", ["ts", "event_id"], 500.0), "used")


@query("failure_timeline", ["pulses"], """SELECT node, count(*) AS pulses, CAST(sum(CASE WHEN gap >= 7200000000 AND gap < 28800000000 THEN 1 ELSE 0 END) AS BIGINT) AS suspects, CAST(sum(CASE WHEN gap >= 28800000000 THEN 1 ELSE 0 END) AS BIGINT) AS deaths, max(gap) AS longest_us
FROM (SELECT node, epoch_us(lead(ts) OVER (PARTITION BY node ORDER BY ts, event_id)) - epoch_us(ts) AS gap FROM pulses) GROUP BY 1""")
def failure_timeline(pulses):
    return state.failure_timeline(pulses, 7200, 28800)


@query("network_degradation", ["pulses"], """SELECT event_id, CASE WHEN health = 'overloaded' AND k >= 90 THEN 'control_only' WHEN k >= 90 THEN 'reject_large_remote' WHEN k >= 75 THEN 'pause_remote_batch' WHEN k >= 60 THEN 'reduce_checkpointing' WHEN k >= 40 THEN 'stop_pre_replication' ELSE 'normal' END AS degradation,
CASE WHEN k < 50 THEN 'continue' WHEN k < 70 THEN 'reduce_concurrency' WHEN k < 80 THEN 'pause_checkpointable_batch' ELSE 'cancel_remote_background' END AS remote_load FROM pulses""")
def network_degradation(pulses):
    return pulses.select("event_id", fleet.degradation(F.col("k"), F.lit(0), F.col("health") == "overloaded").alias("degradation"), fleet.remote_load_action(F.col("k"), 70).alias("remote_load"))


@query("backoff_schedule", ["attempts"], "SELECT task_id, attempt, CAST(least(20, 5 * pow(2, least(attempt - 1, 63))) AS BIGINT) AS backoff FROM attempts")
def backoff_schedule(attempts):
    return attempts.select("task_id", "attempt", fleet.backoff(F.col("attempt"), 5, 20).alias("backoff"))


@query("checkpoint_interval", ["pulses"], "SELECT event_id, CASE WHEN k = 0 OR k >= 80 THEN NULL ELSE least(greatest(k * CASE WHEN k >= 50 THEN 4 ELSE 2 END, 1), 100) END AS every FROM pulses")
def checkpoint_interval(pulses):
    return pulses.select("event_id", fleet.checkpoint_interval(F.col("k"), F.lit(1), F.lit(100).cast("long"), F.col("k") / 100.0).alias("every"))


@query("effect_recovery", ["attempts"], """SELECT task_id, attempt, CASE WHEN l_returnflag = 'R' AND active THEN 'reject_while_quorum_lost' WHEN attempt % 5 = 0 THEN 'transactional_outbox' WHEN l_quantity > 10 AND task_id % 4 = 0 THEN 'retry_with_idempotency_key'
 WHEN l_quantity > 10 AND task_id % 4 = 1 THEN 'verify_external_state' WHEN l_quantity > 10 AND task_id % 4 = 2 THEN 'compensate_then_retry' ELSE 'recovery_required' END AS action FROM attempts""")
def effect_recovery(attempts):
    retry = F.element_at(F.array(*[F.lit(x) for x in ("idempotent", "verifiable", "compensatable", "unsafe")]), (F.col("task_id") % 4 + 1).cast("int"))
    action = fleet.effect_recovery(~((F.col("l_returnflag") == "R") & F.col("active")), F.col("attempt") % 5 == 0, retry, F.col("l_quantity") > 10)
    return attempts.select("task_id", "attempt", action.alias("action"))


@query("n_of_m_vote", ["votes"], "SELECT task_id, count(*) AS votes, CASE WHEN max(trusted) IS NULL THEN 'manual_review' WHEN count(*) BETWEEN 2 AND 5 AND sum(CASE WHEN digest = trusted THEN 1 ELSE 0 END) >= 2 THEN 'accepted' ELSE 'quarantined' END AS status FROM votes GROUP BY 1")
def n_of_m_vote(votes):
    return trust.n_of_m(votes, required=2, total=5)


def levels(size: int, source: str = "events") -> str:
    """Leaves, all levels and roots of segments of `size` events, as DuckDB tables."""
    return f"""leaves AS (SELECT event_id // {size} AS segment, row_number() OVER (PARTITION BY event_id // {size} ORDER BY event_id) - 1 AS i, sha256(event_type) AS h FROM {source})
, up(segment, lev, hs) AS (SELECT segment, 0, list(h ORDER BY i) FROM leaves GROUP BY 1 UNION ALL SELECT segment, lev + 1, list_transform(range(0, (len(hs) + 1) // 2), lambda j: sha256(hs[2 * j + 1] || ':' || coalesce(hs[2 * j + 2], hs[2 * j + 1]))) FROM up WHERE len(hs) > 1)
, roots AS (SELECT segment, hs[1] AS root FROM up WHERE len(hs) = 1)"""


ROOTS = " SELECT segment, count(*) AS leaves, max(root) AS root FROM leaves JOIN roots USING (segment) GROUP BY segment"


def event_roots(events, size: int):
    return merkle.roots(events, F.expr(f"event_id div {size}"), "event_id", F.sha2("event_type", 256))


@query("merkle_root", ["events"], "WITH RECURSIVE " + levels(64) + ROOTS)
def merkle_root(events):
    return event_roots(events, 64)


@query("merkle_root_large", ["events"], "WITH RECURSIVE " + levels(5000) + ROOTS)
def merkle_root_large(events):
    """Segments of several subtrees, the last of which is short."""
    return event_roots(events, 5000)
