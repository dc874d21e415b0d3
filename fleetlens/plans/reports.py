"""Queries of benchmark reports, control frames, event pages and worker eligibility, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import reports, workers
from fleetlens.plans.catalog import query, rounded
from fleetlens.sources import control

CASES = """, m AS (SELECT workers, workload, median(e2e) AS median FROM samples GROUP BY 1, 2)
, cases AS (SELECT s.workers, s.workload, count(*) AS n, min(e2e) AS least, max(e2e) AS most, max(m.median) AS median, median(abs(e2e - m.median)) AS mad, quantile_disc(e2e, 0.95) AS p95, quantile_disc(e2e, 0.99) AS p99, median(submit) AS submit, CAST(sum(payload) AS BIGINT) AS ipc_bytes
  FROM samples s JOIN m USING (workers, workload) GROUP BY 1, 2)"""


def cases(samples):
    return reports.merge(samples, ["workers", "workload"], "e2e", {"submit": "submit"}, [F.sum("payload").alias("ipc_bytes")])


@query("report_merge", ["samples"], f"""{CASES}, u AS (SELECT workers, max(controller_rss) + max(worker_rss) + max(service_rss) AS peak FROM samples GROUP BY 1)
SELECT c.* EXCLUDE (median, mad), round(median, 6) AS median, round(mad, 6) AS mad, u.peak AS peak_rss, round(1e9 / greatest(1.0, median), 6) AS per_second FROM cases c JOIN u USING (workers)""")
def report_merge(samples):
    """Cases merged over runs: latency distribution, submission, bytes, and the peak of all roles."""
    used = reports.most_used(samples, ["workers"], ["controller_rss", "worker_rss", "service_rss"]).withColumnRenamed("peak", "peak_rss")
    out = cases(samples).join(used, "workers").withColumn("per_second", 1e9 / F.greatest(F.lit(1.0), F.col("median")))
    return rounded(out, "median", "mad", "per_second")


@query("content_scaling", ["samples"], """, t AS (SELECT workers, aggregate_bytes, concurrency, aggregate_bytes * 1e9 / greatest(1.0, e2e * 1000000) AS speed FROM samples)
, w AS (SELECT workers, aggregate_bytes, median(speed) FILTER (concurrency = 4) AS low, median(speed) FILTER (concurrency = 16) AS high FROM t GROUP BY 1, 2)
SELECT workers, aggregate_bytes, round(low, 3) AS low, round(high, 3) AS high, round(high / greatest(1.0, low), 6) AS ratio, low IS NOT NULL AND high IS NOT NULL AND (aggregate_bytes < 4294967296 OR high / greatest(1.0, low) >= 0.9) AS passed FROM w""")
def content_scaling(samples):
    """Throughput at sixteen against four transfers at once; judged on the large total only."""
    out = reports.scaling(samples.withColumn("spent", F.col("e2e") * 1_000_000), ["workers", "aggregate_bytes"], "aggregate_bytes", "spent", 4, 16, 0.90, 4 << 30)
    return rounded(rounded(out, "low", "high", digits=3), "ratio")


DISTRIBUTION = lambda v: f"count(*) AS n, min({v}) AS least, max({v}) AS most, round(median({v}), 6) AS median, round(mad({v}), 6) AS mad, quantile_disc({v}, 0.95) AS p95, quantile_disc({v}, 0.99) AS p99"


@query("report_classification", ["bench_samples"], """, c AS (SELECT lane, workload, median(elapsed) AS median, mad(elapsed) AS mad, sum(faults) AS faults FROM bench_samples GROUP BY 1, 2)
, w AS (SELECT lane, median(bytes * 1e9 / greatest(1.0, elapsed)) FILTER (concurrency = 4) AS low, median(bytes * 1e9 / greatest(1.0, elapsed)) FILTER (concurrency = 16) AS high FROM bench_samples GROUP BY 1)
SELECT c.lane, CASE WHEN sum(faults) > 0 THEN 'framework_suspect' WHEN NOT coalesce(max(w.high / greatest(1.0, w.low)) >= 0.9, false) THEN 'regression' WHEN avg(CASE WHEN mad / median > 0.1 THEN 1.0 ELSE 0.0 END) > 0.2 THEN 'environmental'
 WHEN max(CASE WHEN mad / median > 0.1 THEN 1 ELSE 0 END) = 1 THEN 'case_specific' ELSE 'none' END AS classification FROM c JOIN w USING (lane) GROUP BY 1""")
def report_classification(samples):
    """What each lane of a benchmark shows: counted faults, a missed gate of scaling, noise of many or of some cases, or nothing."""
    cases_ = reports.merge(samples, ["lane", "workload"], "elapsed", None, [F.sum("faults").alias("faults")])
    gate = reports.scaling(samples, ["lane"], "bytes", "elapsed", 4, 16, 0.90, 4 << 30).select("lane", (~F.col("passed")).alias("regressed"))
    return reports.classify(cases_.join(gate, "lane").withColumn("noisy", F.col("mad") / F.col("median") > 0.10), ["lane"])


@query("placement_merge", ["decisions"], f", x AS (SELECT *, decision_ns AS v FROM decisions) SELECT case_id, workload, latency_class, nodes, variants, top_k, {DISTRIBUTION('v')}, median(evaluated) AS evaluated FROM x GROUP BY ALL")
def placement_merge(decisions):
    return rounded(reports.merge_placement(decisions), "median", "mad")


@query("registry_merge", ["registry_reports"], f"""SELECT acceptance, mutations, {DISTRIBUTION('mutation_ns')}, round(median(compact_ns), 6) AS compact_median_ns, median(reopen_ns) AS reopen_median_ns, max(snapshot_bytes) AS disk_bytes, count(*) FILTER (committed <> mutations) AS lost_mutations,
 count(*) FILTER (NOT log_present) AS missing_log, count(*) FILTER (NOT (first_present AND last_present)) AS missing_tasks, round(mutations * 1e9 / greatest(1.0, median(mutation_ns)), 6) AS per_second FROM registry_reports GROUP BY acceptance, mutations""")
def registry_merge(rows):
    """Registry reports by acceptance and size, with what they lost."""
    return rounded(reports.merge_registry(rows), "median", "mad", "compact_median_ns", "per_second")


@query("window_jitter", ["registry_reports"], f"""SELECT acceptance, mutations, {DISTRIBUTION('window_ns')}, min(window_mutations) AS window_mutations, min(window_mutations) = max(window_mutations) AS valid, round(mad(window_ns) / greatest(1.0, median(window_ns)), 6) AS jitter,
 count(*) < 3 OR mad(window_ns) / greatest(1.0, median(window_ns)) <= 0.1 AS steady FROM registry_reports WHERE mutations <= 10000 GROUP BY acceptance, mutations""")
def window_jitter(rows):
    """Windows of mutations: whether they are of one size, and how much they vary."""
    return rounded(reports.merge_windows(rows), "median", "mad", "jitter")


@query("content_merge", ["content_samples"], f"""SELECT lane, content_bytes, aggregate_bytes, concurrency, name, {DISTRIBUTION('elapsed')}, CASE WHEN lane = 'fixed-total-scaling' THEN replace(name, 'content.localization.', 'content.localization.fixed-total.') ELSE name END AS case_id,
 round(aggregate_bytes / 67108864.0, 6) AS pressure, round(aggregate_bytes * 1e9 / greatest(1.0, median(elapsed)), 3) AS per_second FROM content_samples GROUP BY lane, content_bytes, aggregate_bytes, concurrency, name""")
def content_merge(rows):
    """Transfers by lane, size and concurrency, on a machine of 64 MiB."""
    return rounded(rounded(reports.merge_content(rows, 64 << 20), "median", "mad", "pressure"), "per_second", digits=3)


@query("fault_merge", ["fault_transitions"], f"SELECT stage, {DISTRIBUTION('transition_ns')}, median(reopen_ns) AS reopen_median_ns, concat('distributed.durability.', replace(stage, '_', '-')) AS case_id FROM fault_transitions GROUP BY stage")
def fault_merge(rows):
    return rounded(reports.merge_faults(rows), "median", "mad")


@query("rotated_list", ["events"], "SELECT user_id, list_aggregate(CASE WHEN len(x) = 0 THEN x ELSE list_concat(x[(user_id % len(x)) + 1:], x[:(user_id % len(x))]) END, 'string_agg', ',') AS rotated FROM (SELECT user_id, list_sort(list(DISTINCT event_type)) AS x FROM events GROUP BY 1)")
def rotated_list(events):
    lists = events.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("x"))
    return lists.select("user_id", F.array_join(reports.rotated(F.col("x"), F.col("user_id")), ",").alias("rotated"))


@query("control_frames", ["events"], "SELECT event_id, strlen(props) <= 7 AND json_valid(props) AND CAST(props ->> 'k' AS BIGINT) IS NOT NULL AS accepted, CASE WHEN strlen(props) <= 7 THEN CAST(props ->> 'k' AS BIGINT) END AS k FROM events")
def control_frames(events):
    """Bounded JSON frames; one that is longer or isn't as its schema says is turned away."""
    out = control.decode(events.select("event_id", "props"), "props", "k long", most=7)
    return out.select("event_id", "accepted", F.col("value.k").alias("k"))


@query("event_pages", ["events"], "SELECT event_id, (rn - 1) // 100 AS page, rn % 100 = 0 OR rn = n AS last_of_page FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn, count(*) OVER () AS n FROM events)")
def event_pages(events):
    """Every event with the page on which a reader who asks for a hundred after the last one seen gets it."""
    return control.pages(events, "event_id", 100).select("event_id", "page", "last_of_page")


@query("task_snapshots", ["attempts"], "SELECT task_id, attempt, coalesce(CASE WHEN active THEN node END, l_quantity::BIGINT) AS holder FROM attempts")
def task_snapshots(attempts):
    """Tasks with who holds them: the node that claimed one, else its owner."""
    return control.snapshots(attempts, F.when(F.col("active"), F.col("node")), F.col("l_quantity").cast("long")).select("task_id", "attempt", "holder")


WORKERS = "workers AS (SELECT s_suppkey AS idx, CASE WHEN s_suppkey % 7 = 3 THEN 'busy' ELSE 'ready' END AS health, 1 + s_suppkey % 8 AS capabilities FROM supplier)"
TASKS = """tasks AS (SELECT t AS protocol, 1 + t % 2 AS schema_version, CASE WHEN t = 5 THEN 'local_only' ELSE 'portable' END AS mobility, t % 4 AS required, CASE WHEN t % 3 = 1 THEN 1 END AS hint, t % 2 AS kind, t <> 6 AS envelope FROM (SELECT unnest(range(0, 8)) AS t))"""


@query("remote_eligible", ["supplier"], f"""WITH {WORKERS}, {TASKS}
SELECT t.protocol, w.idx FROM tasks t JOIN workers w ON w.health = 'ready' AND t.envelope AND t.mobility <> 'local_only' AND (w.capabilities & t.required) = t.required
 AND CASE WHEN t.protocol = w.idx % 8 THEN 1 + w.idx % 2 = t.schema_version ELSE t.protocol = (w.idx + 1) % 8 AND t.schema_version = 2 AND w.idx % 5 <> 0 END
 AND (t.hint IS NULL OR (t.hint = w.idx % 2 AND w.idx % 11 <> 0)) AND (t.kind = w.idx % 2 OR t.kind = (w.idx + 1) % 3)
WHERE w.idx NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 19 = 6)""")
def remote_eligible(supplier):
    """Workers that may run each kind of task, without those that have tried it."""
    i = F.col("s_suppkey")
    portable = lambda p, schema, mobile: F.struct(p.cast("long").alias("protocol"), schema.cast("long").alias("schema_version"), mobile.alias("mobile"))
    fleet = supplier.select(
        i.alias("idx"), F.when(i % 7 == 3, "busy").otherwise("ready").alias("health"), (1 + i % 8).alias("capabilities"),
        F.array(portable(i % 8, 1 + i % 2, F.lit(True)), portable((i + 1) % 8, F.lit(2), i % 5 != 0), portable(i % 8, F.lit(1), F.lit(True))).alias("tasks"),
        F.array(F.struct((i % 2).alias("runner"), F.when(i % 11 == 0, 0).otherwise(3).alias("generation"))).alias("runners"), F.array(i % 2, (i + 1) % 3).alias("resources"),
    )
    t = F.col("id")
    tasks = supplier.sparkSession.range(8).select(
        t.alias("protocol"), (1 + t % 2).alias("schema_version"), F.when(t == 5, "local_only").otherwise("portable").alias("mobility"), (t % 4).alias("required"),
        F.when(t % 3 == 1, F.lit(1).cast("long")).alias("hint"), F.array(t % 2).alias("kinds"), (t != 6).alias("envelope"),
    )
    tried = supplier.where("s_suppkey % 19 = 6").select(i.alias("idx"))
    return workers.candidates(tasks, fleet, tried).select("protocol", "idx")
