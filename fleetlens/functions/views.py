"""Fleet tables as views of the driver's tables. SQL that Spark and DuckDB both run; VARCHAR(9) reads STRING in Spark."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from fleetlens.operators import places

K = "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"
#: A number that grows with the date, not one a day: both engines have its functions.
DAY = "year(l_shipdate) * 372 + month(l_shipdate) * 31 + day(l_shipdate)"
#: Tells the rows of an order apart.
LINE = "CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey"
VIEWS = {
    "observations": (["events"], f"""SELECT event_type AS task_type, concat('v', CAST(user_id % 4 AS VARCHAR(9))) AS variant_id, event_id % 3 AS input_bucket,
        value AS latency_ticks, {K} * 1048576 AS peak_memory_bytes, {K} % 10 = 0 AS failed, ts, event_id FROM events"""),
    "nodes": (["supplier"], """SELECT s_suppkey AS idx, concat('node-', lpad(CAST(s_suppkey AS VARCHAR(9)), 6, '0')) AS node_id,
        1 + CASE WHEN s_suppkey % 3 = 0 THEN 4 ELSE 0 END + CASE WHEN s_suppkey % 5 = 0 THEN 8 ELSE 0 END AS bits,
        s_suppkey % 40 AS pressure, s_suppkey % 17 <> 16 AS healthy FROM supplier"""),
    "requests": (["orders"], """SELECT o_orderkey AS task_id, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 8 END AS required_bits,
        o_totalprice / 1000 AS local_cost, o_orderkey % 3 AS input_bucket,
        CASE o_orderkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'view' END AS task_type,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'soft_realtime' WHEN '2' THEN 'interactive' WHEN '3' THEN 'batch' ELSE 'background' END AS latency_class,
        o_orderdate AS submitted FROM orders"""),
    "attempts": (["lineitem"], """SELECT l_orderkey AS task_id, l_suppkey AS node, l_linestatus = 'O' AS active, l_quantity, l_returnflag,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS attempt FROM lineitem"""),
    "mutations": (["events"], """SELECT user_id AS task_id, CASE event_type WHEN 'signup' THEN 'submit' WHEN 'view' THEN 'assign' WHEN 'click' THEN 'running'
        WHEN 'purchase' THEN 'stage' ELSE 'recover' END AS mutation, ts, event_id FROM events"""),
    "pulses": (["events"], f"SELECT user_id AS node, ts, event_id, CASE WHEN event_type = 'error' THEN 'overloaded' ELSE 'healthy' END AS health, {K} AS k FROM events"),
    "catalog": (["lineitem"], """SELECT l_orderkey AS digest, CAST(sum(l_quantity) AS BIGINT) AS size, count(*) AS targets,
        sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS healthy, count(*) % 3 AS refs, min(l_linenumber) AS retain_until,
        CASE l_orderkey % 3 WHEN 0 THEN 'ephemeral' WHEN 1 THEN 'reconstructible' ELSE 'replicated' END AS policy FROM lineitem GROUP BY l_orderkey"""),
    "votes": (["lineitem"], "SELECT l_orderkey AS task_id, l_returnflag AS digest, CASE WHEN l_orderkey % 10 <> 0 THEN 'N' END AS trusted FROM lineitem"),
    # Placement to the letter: nodes, their variants and requests with every column of the rules.
    "sched_nodes": (["supplier"], """SELECT s_suppkey AS idx, concat('node-', lpad(CAST(s_suppkey AS VARCHAR(9)), 6, '0')) AS node_id,
        1 + CASE WHEN s_suppkey % 3 = 0 THEN 4 ELSE 0 END + CASE WHEN s_suppkey % 5 = 0 THEN 8 ELSE 0 END + CASE WHEN s_suppkey IN (6, 9) THEN 64 ELSE 0 END AS bits,
        s_suppkey % 40 AS pressure, CASE WHEN s_suppkey % 17 = 16 THEN 'suspect' ELSE 'healthy' END AS health, CASE WHEN s_suppkey % 23 = 5 THEN 'revoked' ELSE 'active' END AS identity,
        s_suppkey % 29 <> 3 AS integrity, s_suppkey % 4 + 1 AS trust, CASE WHEN s_suppkey % 3 = 1 THEN 'macos' ELSE 'linux' END AS os, CASE WHEN s_suppkey % 7 = 2 THEN 'arm64' ELSE 'x86_64' END AS abi,
        1024 * (1 + s_suppkey % 8) AS memory, 512 * (s_suppkey % 4) AS vram, s_suppkey % 5 AS content_a, 5 + s_suppkey % 3 AS content_b FROM supplier"""),
    "sched_variants": (["supplier"], """SELECT s_suppkey AS idx, v, concat('v', CAST(v AS VARCHAR(9))) AS variant_id, CASE WHEN v = 3 THEN 4 ELSE 1 END AS need, 512 * (1 + v) AS peak_memory,
        CASE WHEN v = 3 THEN 512 ELSE 0 END AS peak_vram, CASE WHEN s_suppkey % 11 = 4 THEN 8 ELSE 7 END AS generation, CAST(CASE WHEN v = 2 THEN 0.95 ELSE 1.0 END AS DOUBLE) AS quality,
        CAST(0.01 AS DOUBLE) * (1 + v % 2) AS base_failure, CAST(1.0 AS DOUBLE) AS queue, CAST(1.0 AS DOUBLE) AS rtt, CAST(2 + s_suppkey % 3 AS DOUBLE) AS input_transfer,
        CAST(10 + v AS DOUBLE) AS execution, CAST(2 + s_suppkey % 3 AS DOUBLE) / 4 AS output_transfer, CAST(1.0 AS DOUBLE) AS prewarm, CAST(1.0 AS DOUBLE) AS commit_cost,
        CAST(10.0 AS DOUBLE) AS recovery, CAST(1 + s_suppkey % 13 AS DOUBLE) AS jitter, CAST(1 + v % 2 AS DOUBLE) AS energy, CASE WHEN v <> 1 THEN CAST(2 + s_suppkey % 4 AS DOUBLE) END AS ttft, CAST(1.0 AS DOUBLE) AS steady
        FROM supplier CROSS JOIN (VALUES (0), (1), (2), (3)) AS t(v)"""),
    "sched_requests": (["orders"], """SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 97 = 0 THEN -1.0 ELSE o_totalprice / 1000 END AS local_cost, CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 8 ELSE 0 END AS required_bits,
        CASE k % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'view' END AS task_type, k % 3 AS input_bucket,
        CASE k % 6 WHEN 0 THEN 'cluster_safety' WHEN 1 THEN 'hard_realtime' WHEN 2 THEN 'soft_realtime' WHEN 3 THEN 'interactive' WHEN 4 THEN 'batch' ELSE 'background' END AS latency_class,
        k % 3 AS minimum_trust, CASE WHEN k % 7 = 2 THEN 'linux' END AS required_os, CASE WHEN k % 11 = 3 THEN 'x86_64' END AS required_abi, 1024 * (1 + k % 3) AS required_memory,
        CASE WHEN k % 9 = 4 THEN 512 ELSE 0 END AS required_vram, k % 16 = 7 AS local_only, k % 16 = 11 AS local_bound, 1 + k % 10 AS local_idx, CASE WHEN k % 5 = 1 THEN 7 END AS required_generation,
        CASE WHEN o_orderkey % 113 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(5.0 AS DOUBLE) END AS small_task, CASE WHEN o_orderkey % 101 = 0 THEN CAST('NaN' AS DOUBLE) WHEN o_orderkey % 103 = 0 THEN CAST(-1.0 AS DOUBLE) ELSE CAST(3 + k % 4 AS DOUBLE) END AS safety_margin,
        CAST(2 + k % 3 AS DOUBLE) AS migration, CAST(3.0 AS DOUBLE) AS dag_benefit, CAST(CASE WHEN k % 12 = 5 THEN 30 ELSE 500 END AS DOUBLE) AS deadline, CAST(CASE WHEN k % 13 = 2 THEN 200 ELSE 600 END AS DOUBLE) AS max_p95, CAST(CASE WHEN k % 17 = 4 THEN 250 ELSE 1100 END AS DOUBLE) AS max_p99,
        CAST(6 + k % 5 AS DOUBLE) AS max_jitter, CAST(CASE WHEN k % 19 = 6 THEN 0.015 ELSE 0.2 END AS DOUBLE) AS max_failure, CASE WHEN k % 8 <> 7 THEN CAST(3 + k % 2 AS DOUBLE) END AS max_ttft, CASE WHEN k % 16 <> 3 THEN CAST(2.0 AS DOUBLE) END AS max_steady,
        CAST(0.9 AS DOUBLE) AS minimum_quality, k % 3 <> 0 AS exact, k % 4 = 3 AS streaming, CASE WHEN k % 8 = 5 THEN 1 + k % 10 END AS session_idx, CAST(k % 7 AS DOUBLE) AS dag_cross,
        k % 5 AS content_a, 5 + k % 3 AS content_b FROM (SELECT o_orderkey, o_totalprice, o_orderkey % 240 AS k FROM orders) AS q"""),
    # Requests of which each has its own node, session and contents, so that there are as many kinds as requests.
    "sched_each": (["orders"], """SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 97 = 0 THEN -1.0 ELSE o_totalprice / 1000 END AS local_cost, CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 8 ELSE 0 END AS required_bits,
        CASE k % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'view' END AS task_type, k % 3 AS input_bucket,
        CASE k % 6 WHEN 0 THEN 'cluster_safety' WHEN 1 THEN 'hard_realtime' WHEN 2 THEN 'soft_realtime' WHEN 3 THEN 'interactive' WHEN 4 THEN 'batch' ELSE 'background' END AS latency_class,
        k % 3 AS minimum_trust, CASE WHEN k % 7 = 2 THEN 'linux' END AS required_os, CASE WHEN k % 11 = 3 THEN 'x86_64' END AS required_abi, 1024 * (1 + k % 3) AS required_memory,
        CASE WHEN k % 9 = 4 THEN 512 ELSE 0 END AS required_vram, k % 16 = 7 AS local_only, k % 16 = 11 AS local_bound, 1 + o_orderkey % 97 AS local_idx, CASE WHEN k % 5 = 1 THEN 7 END AS required_generation,
        CASE WHEN o_orderkey % 113 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(5.0 AS DOUBLE) END AS small_task, CASE WHEN o_orderkey % 101 = 0 THEN CAST('NaN' AS DOUBLE) WHEN o_orderkey % 103 = 0 THEN CAST(-1.0 AS DOUBLE) ELSE CAST(3 + k % 4 AS DOUBLE) END AS safety_margin,
        CAST(2 + k % 3 AS DOUBLE) AS migration, CAST(3.0 AS DOUBLE) AS dag_benefit, CAST(CASE WHEN k % 12 = 5 THEN 30 ELSE 500 END AS DOUBLE) AS deadline, CAST(CASE WHEN k % 13 = 2 THEN 200 ELSE 600 END AS DOUBLE) AS max_p95, CAST(CASE WHEN k % 17 = 4 THEN 250 ELSE 1100 END AS DOUBLE) AS max_p99,
        CAST(6 + o_orderkey % 7 AS DOUBLE) AS max_jitter, CAST(CASE WHEN k % 19 = 6 THEN 0.015 ELSE 0.2 END AS DOUBLE) AS max_failure, CASE WHEN k % 8 <> 7 THEN CAST(3 + k % 2 AS DOUBLE) END AS max_ttft, CASE WHEN k % 16 <> 3 THEN CAST(2.0 AS DOUBLE) END AS max_steady,
        CAST(0.9 AS DOUBLE) AS minimum_quality, k % 3 <> 0 AS exact, k % 4 = 3 AS streaming, CASE WHEN k % 8 = 5 THEN 1 + o_orderkey % 89 END AS session_idx, CAST(k % 7 AS DOUBLE) AS dag_cross,
        CASE WHEN k % 23 <> 1 THEN o_orderkey % 37 END AS content_a, 5 + o_orderkey % 11 AS content_b FROM (SELECT o_orderkey, o_totalprice, o_orderkey % 240 AS k FROM orders) AS q"""),
    "priorities": (["orders"], """SELECT o_orderkey AS task_id, o_custkey % 20 AS queue, o_orderkey % 53 = 0 AS safety, o_orderkey % 31 = 0 AS recovery, CAST(substr(o_orderpriority, 1, 1) AS INT) AS class_rank, o_orderkey % 2 = 0 AS local_origin,
        o_orderkey % 11 AS deadline, o_orderkey % 7 AS dag, o_orderkey % 5 AS unlock, o_orderkey % 3 AS business, CAST(floor(o_totalprice / 10000) AS BIGINT) AS age, o_custkey % 4 AS fair_share FROM orders"""),
    "reservations": (["lineitem"], """SELECT l_suppkey AS node, concat(CAST(l_orderkey AS VARCHAR(9)), '/', CAST(l_linenumber AS VARCHAR(9))) AS reservation_id, 1 + l_linenumber % 4 AS cpu, CAST(l_quantity AS BIGINT) AS memory,
        CAST(CASE WHEN l_returnflag = 'A' THEN floor(l_quantity / 2) ELSE 0 END AS BIGINT) AS vram, 1 + l_linenumber % 3 AS threads, l_linestatus = 'O' AS remote, CASE WHEN l_partkey % 41 = 0 THEN 2 ELSE 1 END AS version,
        CAST(floor(l_extendedprice) AS BIGINT) % 100 AS pressure, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS tick,
        CASE WHEN l_partkey % 37 = 0 THEN 0 ELSE 2 + l_linenumber END AS lasts FROM lineitem"""),
    "traffic": (["events"], f"""SELECT user_id AS node, ts, event_id, {K} AS k, CASE event_type WHEN 'signup' THEN 'tick' WHEN 'view' THEN 'enqueue' WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'complete' ELSE 'control' END AS op,
        1 + {K} * 10 AS bytes, event_id % 13 = 0 AS forwarding FROM events"""),
    "commands": (["events"], """SELECT event_id, user_id * 100000 + CAST(floor(m / 12) AS BIGINT) AS task_id, m % 12 AS pos, CAST(floor(m / 12) AS BIGINT) % 3 = 0 AS fast,
        CASE m % 12 WHEN 0 THEN 'submit' WHEN 1 THEN 'assign' WHEN 2 THEN 'running' WHEN 3 THEN CASE WHEN event_type = 'error' THEN 'recover' ELSE 'stage' END WHEN 4 THEN 'assign' WHEN 5 THEN 'running' WHEN 6 THEN 'conflict'
          WHEN 7 THEN 'stage' WHEN 8 THEN CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'cancel' ELSE 'commit' END WHEN 9 THEN 'commit' WHEN 10 THEN 'assign' ELSE 'cancel' END AS mutation,
        CASE WHEN m % 12 < 4 THEN 1 WHEN m % 12 < 10 THEN 2 ELSE 3 END - CASE WHEN event_type = 'view' AND m % 12 IN (1, 4) THEN 1 WHEN event_type = 'click' AND m % 12 IN (2, 5, 7) THEN 1 ELSE 0 END AS attempt,
        user_id % 7 + CASE WHEN event_type = 'signup' AND m % 12 IN (3, 7) THEN 1 ELSE 0 END AS node, event_id % 2 AS content
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS m FROM events) AS q"""),
    "beats": (["events"], f"""SELECT event_id, user_id AS node, CAST(floor(value) AS BIGINT) AS k, CASE WHEN event_type = 'signup' THEN 'register' ELSE 'pulse' END AS op,
        CASE WHEN event_type = 'signup' THEN 1 + event_id % 2 WHEN {K} >= 80 THEN 2 ELSE 1 END AS capability_version,
        CASE WHEN event_type = 'signup' AND {K} = 50 THEN 0 WHEN {K} % 29 = 11 THEN 2 ELSE 1 END AS resource_version, CASE WHEN event_type = 'error' THEN 'overloaded' WHEN event_type = 'view' AND {K} % 9 = 0 THEN 'draining' ELSE 'healthy' END AS health,
        CASE WHEN {K} % 3 = 0 THEN 0 ELSE {K} END AS pressure, sum(1 + {K} % 7) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS tick FROM events"""),
    "snapshots": (["events"], f"SELECT event_id, user_id AS node, ts, event_id % 9 + {K} % 5 AS capability_version, {K} % 7 + CAST(floor(event_id / 40) AS BIGINT) AS resource_version, event_type = 'purchase' AS is_pulse, event_type <> 'error' AS valid FROM events"),
    "leader_obs": (["events"], f"""SELECT event_id, user_id AS cluster, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS tick, CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END AS candidate,
        CASE WHEN {K} % 23 <> 0 THEN CAST(50 - {K} % 13 AS DOUBLE) END AS current_score, CASE WHEN {K} % 17 <> 0 THEN CAST(floor(value / 4) - {K} % 10 AS DOUBLE) END AS candidate_score FROM events"""),
    "observers": (["events"], f"""SELECT event_id, user_id AS node, event_type AS operation, {K} % 6 AS reachable, {K} % 31 <> 0 AS alive, event_id % 4 = 0 AS is_leader, event_id % 3 = 0 AS has_grant, event_id % 11 <> 0 AS has_leader,
        event_id % 5 <> 0 AS connected, event_id % 7 <> 0 AS lease_valid, event_id % 9 <> 0 AS grant_current FROM events"""),
    "voters": (["supplier"], "SELECT s_suppkey AS node, CAST(floor(s_suppkey / 5) AS BIGINT) AS cluster, s_suppkey % 7 * 3 AS last_index, s_suppkey % 9 <> 4 AS alive, s_suppkey % 6 <> 1 AS is_full FROM supplier"),
    "recoveries": (["lineitem"], """SELECT l_orderkey * 10 + l_linenumber AS plan_id,
        CASE WHEN l_partkey % 6 = 0 THEN 'suspect' WHEN l_partkey % 6 = 1 THEN 'speculative' ELSE 'dead' END AS failure, l_partkey % 5 = 0 AS allow_speculative, CASE WHEN l_suppkey % 3 = 0 THEN 40 END AS deadline,
        CAST(l_quantity AS BIGINT) AS now_tick, l_linenumber - 1 AS attempts, 4 AS max_attempts, 0.85 + l_discount AS quality, l_partkey % 19 <> 0 AS eligible, l_partkey % 13 <> 0 AS inputs_recoverable,
        1 + l_suppkey % 2 AS wanted_runner, 7 + CASE WHEN l_partkey % 8 = 1 THEN 1 ELSE 0 END AS wanted_plugin, CASE WHEN l_linenumber > 1 THEN l_linenumber - 1 + l_partkey % 2 END AS last_attempt, CASE WHEN l_partkey % 4 = 0 THEN 'r2' END AS hint,
        CASE l_orderkey % 5 WHEN 0 THEN 'ephemeral' WHEN 1 THEN 'non_recoverable' WHEN 2 THEN 'restartable' WHEN 3 THEN 'checkpointed' ELSE 'mirrored' END AS tier, CASE l_orderkey % 4 WHEN 0 THEN 'local_only' WHEN 1 THEN 'portable' WHEN 2 THEN 'restartable' ELSE 'checkpointable' END AS mobility,
        CASE l_linenumber % 4 WHEN 0 THEN 'idempotent' WHEN 1 THEN 'verifiable' WHEN 2 THEN 'compensatable' ELSE 'unsafe' END AS retry, l_returnflag <> 'R' AS has_checkpoint, l_partkey % 7 <> 0 AS checkpoint_fits, l_linestatus = 'O' AS has_standby FROM lineitem"""),
    "sessions": (["lineitem"], """SELECT l_suppkey AS host, concat('s', CAST(l_partkey % 40 AS VARCHAR(9))) AS session_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS seq,
        CASE WHEN l_returnflag = 'R' THEN 'release' ELSE 'admit' END AS op, l_partkey % 8 <> 0 AS critical, l_linenumber AS compute, CAST(l_quantity AS BIGINT) AS memory, CAST(l_quantity * 2 AS BIGINT) AS network,
        l_linestatus = 'O' AS leader_only, l_partkey % 3 = 0 AS dead, CASE WHEN l_partkey % 4 = 0 THEN l_suppkey + 1 END AS standby, l_partkey % 5 <> 0 AS has_checkpoint, l_extendedprice / 1000 AS benefit, l_quantity + l_linenumber AS cost FROM lineitem"""),
    "checkpoints": (["events"], f"""SELECT event_id, user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, event_id - CASE WHEN {K} % 10 = 0 THEN 5000 ELSE 0 END AS sequence,
        CASE WHEN {K} % 16 = 3 THEN 2 ELSE 1 END AS schema_version, CASE WHEN {K} % 21 = 5 THEN 8 ELSE 7 END AS generation, CASE WHEN {K} % 18 = 7 THEN 'other' ELSE 'input' END AS input_id, event_type = 'signup' AS baseline FROM events"""),
    # Checkpoints of three chunks, of which two stay for a while, as a store of each user persists them.
    "persisted": (["events"], f"""SELECT event_id, user_id AS store, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, event_id - CASE WHEN {K} % 10 = 0 THEN 5000 ELSE 0 END AS sequence, CASE WHEN {K} % 31 = 4 THEN 0 ELSE 1 END AS attempt,
        CASE WHEN {K} % 21 = 5 THEN 8 ELSE 7 END AS generation, CASE WHEN {K} % 18 = 7 THEN 'other' ELSE 'input' END AS input_id, event_type = 'signup' AS baseline, concat('c', CAST(event_id AS VARCHAR(9))) AS content,
        concat('a', CAST({K} % 3 AS VARCHAR(9))) AS d0, concat('b', CAST(event_id % 4 AS VARCHAR(9))) AS d1, concat('e', CAST(event_id AS VARCHAR(9))) AS d2, {K} AS n2 FROM events"""),
    "reputation_events": (["lineitem"], """SELECT l_suppkey AS node, l_returnflag AS capability, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus) AS seq,
        l_discount < 0.08 AS succeeded, l_linenumber = 7 AS timed_out, l_tax > 0.06 AS mismatch, l_partkey % 9 = 0 AS corruption, l_quantity / 12 AS latency_ratio, l_partkey % 199 = 0 AS forged, l_partkey % 151 = 0 AS cancel_refused, l_partkey % 173 = 0 AS unauthorised FROM lineitem"""),
    "identities": (["supplier"], """SELECT s_suppkey AS node, CASE s_suppkey % 9 WHEN 4 THEN 'revoked' WHEN 7 THEN 'quarantined' ELSE 'active' END AS status, s_suppkey % 4 + 1 AS trust, s_suppkey % 20 AS valid_from, 60 + s_suppkey % 50 AS valid_until,
        1 + s_suppkey % 3 AS generation, s_suppkey % 13 <> 2 AS integrity, s_suppkey % 5 <> 1 AS attested, 40 + s_suppkey % 60 AS attested_until FROM supplier"""),
    "wide_nodes": (["supplier"], """SELECT s_suppkey AS idx, CAST(1 + CASE WHEN s_suppkey % 3 = 0 THEN 4 ELSE 0 END + CASE WHEN s_suppkey % 5 = 0 THEN 1099511627776 ELSE 0 END AS BIGINT) AS lo,
        CAST(CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN s_suppkey % 7 = 0 THEN 70368744177664 ELSE 0 END + CASE WHEN s_suppkey % 11 = 0 THEN CAST(-9223372036854775808 AS BIGINT) ELSE 0 END AS BIGINT) AS hi FROM supplier"""),
    "wide_needs": (["orders"], """SELECT o_orderkey AS task_id, CAST(CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 1099511627780 ELSE 2 END AS BIGINT) AS need_lo,
        CAST(CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 70368744177664 ELSE CAST(-9223372036854775808 AS BIGINT) END AS BIGINT) AS need_hi FROM orders"""),
    # Validity of identities in days, some very long, some empty; and moments at which work was done.
    "validities": (["lineitem"], f"""SELECT l_suppkey AS node, {DAY} AS valid_from, l_orderkey * 10 + l_linenumber AS identity,
        {DAY} + CASE WHEN l_partkey % 53 = 5 THEN 900 WHEN l_partkey % 7 = 3 THEN -1 ELSE l_linenumber * 3 END AS valid_until FROM lineitem WHERE l_returnflag <> 'N'"""),
    "moments": (["lineitem"], f"SELECT l_orderkey AS task_id, l_linenumber AS number, l_suppkey AS node, {DAY} + l_partkey % 60 - 30 AS tick FROM lineitem"),
    # A log of grants by the day they are given, and results by the day they come; both name attempt and node.
    "grant_log": (["lineitem"], f"SELECT l_orderkey AS task_id, {DAY} + l_partkey % 20 AS tick, {LINE} AS entry, l_linenumber % 3 AS attempt, l_suppkey % 2 AS node, {DAY} + l_partkey % 20 + 60 AS until FROM lineitem"),
    "late_results": (["lineitem"], f"SELECT l_orderkey AS task_id, {LINE} AS result, {DAY} + l_linenumber * 7 AS tick, l_linenumber % 3 AS attempt, l_partkey % 2 AS node FROM lineitem"),
    "trust_tasks": (["orders"], """SELECT o_orderkey AS task_id, 1 + o_custkey % 90 AS node, o_orderkey % 5 AS minimum_trust, o_orderkey % 3 <> 0 AS allow_external, o_orderkey % 4 = 0 AS require_attestation, 20 + o_orderkey % 60 AS now_tick,
        CASE o_orderkey % 6 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'confidential' WHEN 3 THEN 'restricted' WHEN 4 THEN 'credential' ELSE 'public' END AS sensitivity, 1 + o_orderkey % 2 AS term, 1 + o_custkey % 2 AS epoch,
        o_orderkey % 40 AS issued, 30 + o_orderkey % 50 AS authorised_until, 1 + o_orderkey % 3 AS generation, o_orderkey % 17 <> 0 AS known, o_orderkey % 100 AS task_value, o_orderkey % 23 = 0 AS irreversible,
        o_orderkey % 4 AS required, o_orderkey % 5 AS total, CASE WHEN o_orderkey % 7 <> 3 THEN concat('p', CAST(o_orderkey % 3 AS VARCHAR(9))) ELSE '' END AS protocol, CASE WHEN o_orderkey % 11 <> 2 THEN 'snark' ELSE '' END AS proof,
        CASE o_orderkey % 9 WHEN 0 THEN 'none' WHEN 1 THEN 'hash_only' WHEN 2 THEN 'deterministic_replay' WHEN 3 THEN 'spot_check' WHEN 4 THEN 'n_of_m' WHEN 5 THEN 'domain_verifier' WHEN 6 THEN 'replayable' WHEN 7 THEN 'proof_carrying' ELSE 'manual_review' END AS policy,
        o_orderkey % 12001 AS rate FROM orders"""),
    "identity_ops": (["events"], f"""SELECT event_id, user_id AS node, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS now_tick, {K} % 5 AS trust, {K} % 7 <> 0 AS key_fine, 4 + {K} % 9 AS lasts, {K} % 3 <> 0 AS attested,
        CASE event_type WHEN 'signup' THEN 'approve' WHEN 'view' THEN 'rotate' WHEN 'click' THEN 'readmit' WHEN 'purchase' THEN 'set_trust' ELSE CASE WHEN {K} % 2 = 0 THEN 'revoke' ELSE 'quarantine' END END AS op FROM events"""),
    "samples": (["events"], f"""SELECT event_id, event_id % 3 AS run, user_id % 4 AS workers, event_type AS workload, value AS e2e, {K} * 1.0 AS submit, {K} * 10 AS payload, 100 + {K} AS controller_rss, 50 + {K} * 2 AS worker_rss, 10 + {K} % 7 AS service_rss,
        CASE {K} % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 16 END AS concurrency, CASE WHEN user_id % 2 = 0 THEN CAST(4294967296 AS BIGINT) ELSE CAST(1048576 AS BIGINT) END AS aggregate_bytes, {K} % 97 = 0 AS stale FROM events"""),
    # Benchmark lanes of which each shows another kind of anomaly, and none; decisions, reports and faults of a benchmark.
    "bench_samples": (["events"], f"""SELECT event_id, lane, workload, concurrency, faults, CAST(4294967296 AS BIGINT) AS bytes, 1000000000 + 1000000 * (value * CASE WHEN lane = 3 OR (lane = 4 AND workload = 'click') THEN 10 ELSE 0.1 END + CASE WHEN lane = 2 AND concurrency = 16 THEN 300 ELSE 0 END) AS elapsed
        FROM (SELECT event_id, user_id % 5 AS lane, event_type AS workload, value, CASE WHEN event_id % 2 = 0 THEN 4 ELSE 16 END AS concurrency, CASE WHEN user_id % 5 = 1 AND {K} % 97 = 0 THEN 1 ELSE 0 END AS faults FROM events) AS q"""),
    "decisions": (["events"], f"SELECT event_id, concat('placement-', CAST(user_id % 6 AS VARCHAR(9))) AS case_id, event_type AS workload, CASE WHEN user_id % 2 = 0 THEN 'batch' ELSE 'interactive' END AS latency_class, user_id % 3 * 16 AS nodes, user_id % 2 + 1 AS variants, 4 AS top_k, value * 1000 AS decision_ns, {K} % 13 AS evaluated FROM events"),
    "registry_reports": (["events"], f"""SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'durable' ELSE 'critical' END AS acceptance, CASE WHEN user_id % 2 = 0 THEN 1000 ELSE 100000 END AS mutations, value * 1000000 AS mutation_ns, value * 10 AS compact_ns, CAST({K} AS DOUBLE) * 1.5e0 AS reopen_ns, {K} * 100 AS snapshot_bytes,
        CASE WHEN {K} = 13 THEN 999 WHEN user_id % 2 = 0 THEN 1000 ELSE 100000 END AS committed, {K} <> 17 AS log_present, {K} <> 19 AS first_present, {K} <> 23 AS last_present, value + 100 * (user_id % 3) AS window_ns, CASE WHEN user_id % 6 = 4 AND {K} = 29 THEN 99 ELSE 100 END AS window_mutations FROM events"""),
    "content_samples": (["events"], f"""SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'fixed-total-scaling' ELSE 'per-transfer' END AS lane, CAST(1048576 AS BIGINT) * (1 + user_id % 3) AS content_bytes, CAST(4194304 AS BIGINT) * (1 + user_id % 3) AS aggregate_bytes, CASE WHEN {K} % 2 = 0 THEN 4 ELSE 16 END AS concurrency, concat('content.localization.', CASE WHEN event_type = 'view' THEN 'hit' ELSE 'miss' END) AS name, value * 1000 AS elapsed FROM events"""),
    "fault_transitions": (["events"], f"SELECT event_id, concat('after_', event_type) AS stage, value * 100 AS transition_ns, CAST({K} AS DOUBLE) * 2.5e0 AS reopen_ns FROM events"),
    "chunks": (["documents"], """SELECT doc_id, i AS chunk_index, sha256(substr(text, i * 256 + 1, 256)) AS digest, length(substr(text, i * 256 + 1, 256)) AS size
        FROM (SELECT doc_id, text, UNNEST_RANGE AS i FROM documents) x"""),
}
#: Each text is cut once, from front to back: substr() at an offset would scan from the start for every chunk.
SPARK_CHUNKS = """SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, sha2(piece, 256) AS digest, length(piece) AS size FROM documents
  LATERAL VIEW posexplode(CASE WHEN length(text) > 0 THEN regexp_extract_all(text, '(?s).{{1,256}}', 0) ELSE array(text) END) e AS i, piece"""
DUCK_CHUNKS = """SELECT doc_id, i AS chunk_index, sha256(substr(text, i * 256 + 1, 256)) AS digest, length(substr(text, i * 256 + 1, 256)) AS size
  FROM (SELECT doc_id, text, unnest(range(0, (greatest(length(text), 1) - 1) // 256 + 1)) AS i FROM documents)"""
BASE = {"region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"}


def spark_body(name: str) -> str:
    return (SPARK_CHUNKS if name == "chunks" else VIEWS[name][1]).replace("VARCHAR(9)", "STRING")


def duck_body(name: str) -> str:
    return DUCK_CHUNKS if name == "chunks" else VIEWS[name][1]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fleet view (or a driver table) as a DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source = VIEWS[name][0][0]
    body = spark_body(name).replace(f"FROM {source}", "FROM {source}")
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    # A window of the view sorts wide rows, so its tasks are kept from growing with the table.
    keys = re.search(r"PARTITION BY ([\w, ]+?) ORDER BY", body)
    return spark.sql(body, source=places.dealt(rows, keys[1].split(", ")) if keys else rows)


def oracle(names: list[str], body: str) -> str:
    """DuckDB SQL over the named views."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({duck_body(n)})" for n in names) + ", " * bool(body.startswith(",")) + " " + body.lstrip(",")
