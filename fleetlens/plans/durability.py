"""Queries of the registry, high availability and recovery, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.functions.oracles import fold_sql
from fleetlens.operators import ha, recovery, registry
from fleetlens.plans.catalog import query

LIVE = "(r.st IS NOT NULL AND r.st NOT IN ('committed', 'failed', 'cancelled'))"
STALE = "(r.act IS NOT NULL AND (r.act <> l.attempt OR r.act_node <> l.node))"
DID = f"""CASE l.mutation WHEN 'submit' THEN CASE WHEN r.st IS NULL THEN 'accepted' ELSE 'rejected' END
 WHEN 'assign' THEN CASE WHEN {LIVE} AND r.st <> 'output_staged' AND l.attempt > r.last THEN 'accepted' ELSE 'rejected' END
 WHEN 'running' THEN CASE WHEN r.st = 'assigned' AND r.act = l.attempt THEN 'accepted' ELSE 'rejected' END
 WHEN 'stage' THEN CASE WHEN r.st IS NULL THEN 'rejected' WHEN {STALE} THEN 'conflict' WHEN r.st IN ('assigned', 'running') THEN 'accepted' ELSE 'rejected' END
 WHEN 'conflict' THEN CASE WHEN r.st IS NULL THEN 'rejected' ELSE 'accepted' END
 WHEN 'commit' THEN CASE WHEN r.st = 'output_staged' AND r.staged = l.content THEN 'accepted' ELSE 'rejected' END
 ELSE CASE WHEN {LIVE} THEN 'accepted' ELSE 'rejected' END END"""
TASK = {
    "outcome": ("CAST('' AS VARCHAR)", DID),
    "st": ("CAST(NULL AS VARCHAR)", f"""CASE WHEN {DID} <> 'accepted' THEN r.st ELSE CASE l.mutation WHEN 'submit' THEN CASE WHEN l.fast THEN 'submitted' ELSE 'persisted' END WHEN 'assign' THEN 'assigned' WHEN 'running' THEN 'running'
      WHEN 'stage' THEN 'output_staged' WHEN 'commit' THEN 'committed' WHEN 'fail' THEN 'failed' WHEN 'recover' THEN 'recovery_required' WHEN 'cancel' THEN 'cancelled' ELSE r.st END END"""),
    "last": ("CAST(0 AS BIGINT)", f"CASE WHEN l.mutation = 'assign' AND {DID} = 'accepted' THEN l.attempt ELSE r.last END"),
    "act": ("CAST(NULL AS BIGINT)", f"CASE WHEN {DID} <> 'accepted' THEN r.act WHEN l.mutation = 'assign' THEN l.attempt WHEN l.mutation IN ('commit', 'fail', 'recover', 'cancel') THEN NULL ELSE r.act END"),
    "act_node": ("CAST(NULL AS BIGINT)", f"CASE WHEN {DID} <> 'accepted' THEN r.act_node WHEN l.mutation = 'assign' THEN l.node WHEN l.mutation IN ('commit', 'fail', 'recover', 'cancel') THEN NULL ELSE r.act_node END"),
    "staged": ("CAST(NULL AS BIGINT)", f"CASE WHEN l.mutation = 'stage' AND {DID} = 'accepted' THEN l.content ELSE r.staged END"),
    "conflicts": ("CAST(0 AS BIGINT)", f"r.conflicts + CASE WHEN {DID} = 'conflict' OR (l.mutation = 'conflict' AND {DID} = 'accepted') THEN 1 ELSE 0 END"),
}


@query("task_registry", ["commands"], ", " + fold_sql("commands", "task_id", "pos", TASK, "l.event_id, r.outcome, coalesce(r.st, 'absent') AS state, r.act AS active, r.conflicts"))
def task_registry(commands):
    """Each command's outcome and its task after it: attempts, nodes, staged contents and conflicts included."""
    return registry.task_registry(commands)


VALID = "(l.valid AND l.capability_version <> 0 AND l.resource_version <> 0)"
OLD = "(coalesce(r.cv > l.capability_version, false) OR coalesce(r.rv > l.resource_version, false))"


@query("versioned_upsert", ["snapshots"], ", " + fold_sql("snapshots", "node", "ts, event_id", {
    "outcome": ("CAST('' AS VARCHAR)", f"CASE WHEN NOT {VALID} THEN 'invalid' WHEN {OLD} THEN 'stale' ELSE 'stored' END"),
    "cv": ("CAST(NULL AS BIGINT)", f"CASE WHEN {VALID} AND NOT {OLD} THEN l.capability_version ELSE r.cv END"), "rv": ("CAST(NULL AS BIGINT)", f"CASE WHEN {VALID} AND NOT {OLD} THEN l.resource_version ELSE r.rv END"),
}, "l.event_id, r.outcome, r.cv AS capability_version, r.rv AS resource_version"))
def versioned_upsert(snapshots):
    return registry.versioned_upserts(snapshots, ["node"], ["ts", "event_id"])


@query("current_snapshots", ["snapshots"], ", " + fold_sql("snapshots", "node", "ts, event_id", {
    "id": ("CAST(NULL AS BIGINT)", f"CASE WHEN {VALID} AND NOT {OLD} THEN l.event_id ELSE r.id END"),
    "cv": ("CAST(NULL AS BIGINT)", f"CASE WHEN {VALID} AND NOT {OLD} THEN l.capability_version ELSE r.cv END"), "rv": ("CAST(NULL AS BIGINT)", f"CASE WHEN {VALID} AND NOT {OLD} THEN l.resource_version ELSE r.rv END"),
}, "l.node, arg_max(r.id, r.n) AS event_id, arg_max(r.cv, r.n) AS capability_version, arg_max(r.rv, r.n) AS resource_version", "n > 0 GROUP BY l.node HAVING arg_max(r.id, r.n) IS NOT NULL"))
def current_snapshots(snapshots):
    """The snapshot that each node ends with; a stored table kept up by a stream holds the same rows."""
    return registry.current_snapshots(snapshots, ["node"], ["ts", "event_id"], snapshots.schema).select("node", "event_id", "capability_version", "resource_version")


V = "l.capability_version"
SAID = f"CASE WHEN l.is_pulse THEN CASE WHEN r.v IS NULL THEN 'unregistered' WHEN r.v <> {V} THEN 'incompatible' ELSE 'accepted' END WHEN {V} = 0 THEN 'unversioned' WHEN coalesce(r.v > {V}, false) THEN 'stale' ELSE 'registered' END"


@query("worker_registry", ["snapshots"], ", " + fold_sql("snapshots", "node", "ts, event_id", {
    "outcome": ("CAST('' AS VARCHAR)", SAID), "v": ("CAST(NULL AS BIGINT)", f"CASE WHEN {SAID} = 'registered' THEN {V} ELSE r.v END"),
    "health": ("CAST(NULL AS VARCHAR)", f"CASE {SAID} WHEN 'registered' THEN 'ready' WHEN 'incompatible' THEN 'incompatible' WHEN 'accepted' THEN CASE WHEN l.valid THEN 'ready' ELSE 'busy' END ELSE r.health END"),
}, "l.event_id, r.outcome, r.health"))
def worker_registry(snapshots):
    return registry.worker_registry(snapshots, ["node"], ["ts", "event_id"])


DUE_S, DUE_D = "greatest(r.tick + 8, r.since + 1)", "greatest(r.tick + 20, r.since + 1)"
NOW = f"CASE WHEN r.health IS NULL THEN NULL WHEN l.tick >= {DUE_D} THEN 'dead' WHEN l.tick >= {DUE_S} AND {DUE_S} < r.tick + 20 AND r.health <> 'dead' THEN 'suspect' ELSE r.health END"
VERSIONED = "(l.capability_version <> 0 AND l.resource_version <> 0)"
FITS = "(r.health IS NOT NULL AND l.capability_version = r.capability_version AND l.resource_version = r.resource_version)"
HEARD = f"CASE WHEN l.op = 'register' THEN {VERSIONED} ELSE {FITS} END"
REGISTERS = f"l.op = 'register' AND {VERSIONED}"
BEAT = {
    "before": ("CAST(NULL AS VARCHAR)", NOW), "disposition": ("CAST('' AS VARCHAR)", f"CASE WHEN l.op = 'register' THEN CASE WHEN {VERSIONED} THEN 'registered' ELSE 'invalid' END WHEN r.health IS NULL THEN 'unknown' WHEN {FITS} THEN 'accepted' ELSE 'full_snapshot_required' END"),
    "health": ("CAST(NULL AS VARCHAR)", f"CASE WHEN {HEARD} THEN l.health WHEN l.op = 'register' THEN {NOW} WHEN r.health IS NULL THEN NULL ELSE 'incompatible' END"),
    "capability_version": ("CAST(NULL AS BIGINT)", f"CASE WHEN {REGISTERS} THEN l.capability_version ELSE r.capability_version END"), "resource_version": ("CAST(NULL AS BIGINT)", f"CASE WHEN {REGISTERS} THEN l.resource_version ELSE r.resource_version END"),
    "tick": ("CAST(0 AS HUGEINT)", f"CASE WHEN {HEARD} THEN l.tick ELSE r.tick END"), "since": ("CAST(0 AS HUGEINT)", "l.tick"),
    "pressure": ("CAST(NULL AS BIGINT)", f"CASE WHEN {HEARD} THEN l.pressure ELSE r.pressure END"),
}


@query("failure_detector", ["beats"], ", " + fold_sql("beats", "node", "tick, event_id", BEAT, """l.event_id, r.before, r.disposition, r.health AS after,
  CASE WHEN (r.health = 'healthy' AND r.pressure = 0) OR r.health IN ('overloaded', 'draining') THEN 30 WHEN r.health IS NOT NULL THEN 2 END AS next_pulse"""))
def failure_detector(beats):
    """Health of members by versioned pulses: silences, mismatched versions, restored ones; and when to pulse next."""
    d = ha.Detector()
    out = ha.detect(beats, ["node"], ["tick", "event_id"], d)
    after = F.when(F.col("health").isNotNull(), ha.next_pulse(F.col("health"), F.col("pressure"), d))
    return out.select("event_id", "before", "disposition", F.col("health").alias("after"), after.alias("next_pulse"))


@query("member_timeline", ["beats"], ", " + fold_sql("beats", "node", "tick, event_id", BEAT, "l.node, l.tick AS since, r.before, r.disposition, r.health, r.tick AS last, lead(l.tick) OVER (PARTITION BY l.node ORDER BY l.n) AS following", into="heard") + """
, ends AS (SELECT *, coalesce(following, (SELECT max(tick) FROM beats)) AS until, greatest(last + 8, since + 1) AS suspect, greatest(last + 20, since + 1) AS dead FROM heard)
SELECT node, CAST(since AS BIGINT) AS tick, health, disposition AS cause FROM ends WHERE health IS DISTINCT FROM before
UNION ALL SELECT node, CAST(suspect AS BIGINT), 'suspect', 'silence' FROM ends WHERE health NOT IN ('suspect', 'dead') AND suspect < last + 20 AND suspect <= until
UNION ALL SELECT node, CAST(dead AS BIGINT), 'dead', 'silence' FROM ends WHERE health <> 'dead' AND dead <= until""")
def member_timeline(beats):
    """Every change of every member's health until the last tick of all, silences of members never heard again included."""
    until = beats.agg(F.max("tick")).first()[0]
    return ha.timeline(beats.withColumn("tick", F.col("tick").cast("long")), ["node"], ["tick", "event_id"], until or 0)


BETTER = "(r.candidate IS NOT NULL AND r.since IS NOT NULL AND r.candidate = l.candidate)"
UNDER = "(l.candidate_score IS NULL OR l.candidate_score < l.current_score + 10)"


@query("leader_transfer", ["leader_obs"], ", " + fold_sql("leader_obs", "cluster", "tick", {
    "transfer": ("false", f"CASE WHEN l.current_score IS NULL THEN l.candidate_score IS NOT NULL WHEN {UNDER} THEN false WHEN {BETTER} THEN l.tick - r.since >= 2 ELSE false END"),
    "candidate": ("CAST(NULL AS VARCHAR)", f"CASE WHEN l.current_score IS NULL OR {BETTER} THEN r.candidate ELSE l.candidate END"),
    "since": ("CAST(NULL AS BIGINT)", f"CASE WHEN l.current_score IS NULL THEN r.since WHEN {UNDER} THEN NULL WHEN {BETTER} THEN r.since ELSE l.tick END"),
}, "l.event_id, r.transfer"))
def leader_transfer(observations):
    return ha.leader_transfers(observations, ["cluster"], ["tick"], 10.0, 2)


@query("leader_score", ["pulses"], "SELECT event_id, CASE WHEN k % 17 <> 0 AND health = 'healthy' THEN 100.0 - k / 10.0 - (k % 10) / 100.0 * 100 END AS score FROM pulses")
def leader_score(pulses):
    score = ha.leader_score(F.lit(100.0), F.col("k") / 10.0, (F.col("k") % 10) / 100.0, F.col("k") % 17 != 0, F.col("health") == "healthy")
    return pulses.select("event_id", score.alias("score"))


@query("availability", ["observers"], """SELECT event_id, CASE WHEN NOT alive THEN 'safe_stop' WHEN reachable < 3 THEN CASE WHEN is_leader THEN 'quorum_lost' WHEN has_grant THEN 'isolated' ELSE 'safe_stop' END WHEN NOT has_leader THEN 'degraded' WHEN NOT connected THEN 'isolated'
 WHEN reachable = 5 THEN 'healthy' WHEN reachable = 3 THEN 'degraded' ELSE 'impaired' END AS availability FROM observers""")
def availability(observers):
    return observers.select("event_id", ha.availability(5).alias("availability"))


OPERATION = "CASE operation WHEN 'view' THEN 'query' WHEN 'click' THEN 'local_work' WHEN 'signup' THEN 'continue_granted' WHEN 'purchase' THEN 'durable_write' ELSE 'membership_change' END"


@query("operation_authorisation", ["observers"], f"""SELECT event_id, CASE WHEN op IN ('query', 'local_work') THEN 'ok' WHEN op = 'continue_granted' THEN CASE WHEN NOT has_grant THEN 'grant_expired' WHEN grant_current THEN 'ok' ELSE 'fenced' END
 WHEN NOT (is_leader AND has_leader AND alive AND reachable >= 3) THEN 'quorum_lost' WHEN lease_valid THEN 'ok' ELSE 'lease_expired' END AS verdict FROM (SELECT *, {OPERATION} AS op FROM observers)""")
def operation_authorisation(observers):
    return observers.select("event_id", ha.authorise(F.expr(OPERATION), 5).alias("verdict"))


@query("election", ["voters"], """SELECT v.node, count(o.node) AS votes, count(o.node) >= max(s.n) // 2 + 1 AS elected FROM voters v JOIN (SELECT cluster, count(*) AS n FROM voters GROUP BY 1) s USING (cluster)
 LEFT JOIN voters o ON o.cluster = v.cluster AND o.alive AND o.last_index <= v.last_index AND v.alive AND v.is_full GROUP BY v.node""")
def election(voters):
    return ha.elections(voters)


@query("uncommitted_results", ["attempts"], """, grants AS (SELECT task_id, attempt, node FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY attempt DESC) AS rn FROM attempts) WHERE rn = 1)
SELECT a.task_id, a.attempt, a.node FROM attempts a JOIN grants g USING (task_id, attempt, node) WHERE NOT a.active AND a.task_id NOT IN (SELECT task_id FROM attempts WHERE l_returnflag = 'R')""")
def uncommitted_results(attempts):
    """Results of inactive attempts that hold the latest grant, of tasks without a decision."""
    from fleetlens.operators.state import latest_grants

    grants = latest_grants(attempts.withColumn("until", F.lit(0))).drop("until")
    return ha.open_results(attempts.where("not active").select("task_id", "attempt", "node"), grants, attempts.where("l_returnflag = 'R'"))


MODES = "CASE digest % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'durable' ELSE 'critical' END"
COPY = "CASE policy WHEN 'ephemeral' THEN false WHEN 'reconstructible' THEN true ELSE healthy >= 2 END"


@query("acceptance_check", ["catalog"], f"""SELECT digest, CASE mode WHEN 'fast' THEN 1 <= replicas + 1 WHEN 'durable' THEN 2 <= replicas + 1 AND ok ELSE wanted <= replicas + 1 AND wanted >= 2 AND ok AND (refs = 0 OR healthy >= wanted) END AS accepted,
 CASE mode WHEN 'fast' THEN healthy >= 1 WHEN 'durable' THEN ok AND healthy >= 1 ELSE ok AND healthy >= wanted END AS commit_ready FROM (SELECT *, {MODES} AS mode, {COPY} AS ok, digest % 4 AS wanted, digest % 3 AS replicas FROM catalog)""")
def acceptance_check(catalog):
    """Whether the acceptance mode of a submission can be kept, and whether its output may be committed."""
    mode, ok, wanted = F.expr(MODES), F.expr(COPY), F.col("digest") % 4
    accepted = registry.accepts(mode, wanted, F.col("digest") % 3, ok, F.col("refs"), F.col("healthy"))
    return catalog.select("digest", accepted.alias("accepted"), registry.commit_ready(mode, wanted, ok, F.col("healthy")).alias("commit_ready"))


@query("replica_acks", ["attempts"], "SELECT task_id AS entry, attempt AS place, coalesce(sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 2 AS asked FROM attempts")
def replica_acks(attempts):
    """Replicas asked in order until two have committed; failures are passed over."""
    rows = attempts.select(F.col("task_id").alias("entry"), F.col("attempt").alias("place"), (F.col("l_returnflag") != "R").alias("ok"))
    return registry.replica_acks(rows, 2).select("entry", "place", "asked")


@query("compaction_trigger", ["traffic"], ", " + fold_sql("traffic", "node", "ts, event_id", {
    "compacts": ("false", "r.records + 1 >= 10 OR r.bytes + l.bytes >= 3000"), "records": ("CAST(0 AS BIGINT)", "CASE WHEN r.records + 1 >= 10 OR r.bytes + l.bytes >= 3000 THEN 0 ELSE r.records + 1 END"),
    "bytes": ("CAST(0 AS BIGINT)", "CASE WHEN r.records + 1 >= 10 OR r.bytes + l.bytes >= 3000 THEN 0 ELSE r.bytes + l.bytes END"),
}, "l.event_id, r.compacts, r.records, r.bytes"))
def compaction_trigger(traffic):
    return registry.compactions(traffic, ["node"], ["ts", "event_id"], 10, 3000)


LOG = """logged AS (SELECT user_id AS node, ts, event_id, event_type AS payload, user_id * 100 + event_id % 5 AS record, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY ts, event_id) - 1 AS version FROM events)"""
LE = lambda x: "unhex(" + " || ".join(f"substr(lpad(hex({x}), 16, '0'), {15 - 2 * i}, 2)" for i in range(8)) + ")"
NEXT_ID = f"sha256(encode(r.id) || {LE('l.n')} || {LE('l.version')} || encode(l.payload))"


def logged(events):
    """Events as mutations of records, each with its record's version before it."""
    place = F.row_number().over(Window.partitionBy("user_id", F.col("event_id") % 5).orderBy("ts", "event_id")) - 1
    rows = events.select(F.col("user_id").alias("node"), "ts", "event_id", F.col("event_type").alias("payload"), (F.col("user_id") * 100 + F.col("event_id") % 5).alias("record"), place.cast("long").alias("version"))
    return registry.chain_transactions(rows.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp"))), ["node"], ["ts", "event_id"])


@query("transaction_chain", ["events"], "WITH RECURSIVE " + LOG + ", " + fold_sql("logged", "node", "ts, event_id", {"id": ("CAST('' AS VARCHAR)", NEXT_ID), "previous": ("CAST('' AS VARCHAR)", "r.id")}, "l.event_id, r.n AS log_index, r.previous AS previous_id, r.id AS transaction_id"))
def transaction_chain(events):
    """Transaction ids of each node's log, each of which takes in the one before."""
    return logged(events).select("event_id", "log_index", "previous_id", "transaction_id")


@query("wal_replay_check", ["events"], "WITH RECURSIVE " + LOG + ", " + fold_sql("logged", "node", "ts, event_id", {"id": ("CAST('' AS VARCHAR)", NEXT_ID), "previous": ("CAST('' AS VARCHAR)", "r.id")}, "l.*, r.previous, r.id").replace("SELECT l.*", ", chain AS (SELECT l.*").replace("), , chain", "), chain") + """)
, broken AS (SELECT *, event_id % 101 = 7 AS lost, CASE WHEN event_id % 97 = 3 THEN payload || '!' ELSE payload END AS stored, CASE WHEN event_id % 89 = 5 THEN version + 1 ELSE version END AS stored_version FROM chain)
, kept AS (SELECT *, lag(n, 1, 0) OVER (PARTITION BY node ORDER BY n) AS before_n, lag(id, 1, '') OVER (PARTITION BY node ORDER BY n) AS before_id, coalesce(lag(stored_version) OVER (PARTITION BY node, record ORDER BY n) + 1, 0) AS before_version FROM broken WHERE NOT lost)
SELECT event_id, CASE WHEN n <> before_n + 1 THEN 'index' WHEN previous <> before_id THEN 'chain' WHEN stored_version <> before_version THEN 'version' WHEN id <> """ + f"sha256(encode(previous) || {LE('n')} || {LE('stored_version')} || encode(stored))" + " THEN 'id' END AS fault FROM kept")
def wal_replay_check(events):
    """A log with entries lost, changed and misnumbered: each entry's first fault, found by reading it and the one before."""
    log = logged(events).where("event_id % 101 <> 7")
    log = log.withColumn("payload", F.when(F.col("event_id") % 97 == 3, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    log = log.withColumn("version", F.when(F.col("event_id") % 89 == 5, F.col("version") + 1).otherwise(F.col("version")))
    return registry.check_transactions(log, "node").select("event_id", "fault")


RUNNERS = "CASE WHEN wanted_runner = 1 AND wanted_plugin = 7 THEN 'r1' WHEN wanted_runner = 2 AND wanted_plugin = 7 THEN 'r2' WHEN wanted_runner = 1 THEN 'r3' END"


@query("recovery_plan", ["recoveries"], f"""SELECT plan_id, action, CASE WHEN action IN ('restart', 'restore_checkpoint') THEN next END AS attempt, CASE WHEN action IN ('restart', 'restore_checkpoint') THEN now_tick + least(20, 5 * CAST(pow(2, next - 1) AS BIGINT)) END AS not_before FROM (
SELECT *, coalesce(last_attempt + 1, 1) AS next, CASE WHEN failure <> 'dead' AND NOT allow_speculative THEN 'wait' WHEN coalesce(now_tick >= deadline, false) OR attempts >= max_attempts OR quality < 0.88 OR NOT eligible OR NOT inputs_recoverable OR {RUNNERS} IS NULL OR coalesce(hint <> {RUNNERS}, false) THEN 'fail'
 ELSE CASE tier WHEN 'ephemeral' THEN 'fail' WHEN 'restartable' THEN CASE WHEN mobility IN ('restartable', 'checkpointable') AND retry <> 'unsafe' THEN 'restart' ELSE 'review' END
   WHEN 'checkpointed' THEN CASE WHEN has_checkpoint AND checkpoint_fits THEN 'restore_checkpoint' ELSE 'review' END WHEN 'mirrored' THEN CASE WHEN has_standby THEN 'promote_standby' ELSE 'review' END ELSE 'review' END END AS action FROM recoveries)""")
def recovery_plan(recoveries):
    """What becomes of each failed attempt; no runner has the second plugin generation with the second of its own."""
    runners = F.array(*[F.struct(F.lit(i).alias("runner_id"), F.lit(g).alias("generation"), F.lit(p).alias("plugin")) for i, g, p in (("r1", 1, 7), ("r2", 2, 7), ("r3", 1, 8), ("r4", 1, 7))])
    return recovery.plan(recoveries, runners, 0.88, 5, 20).select("plan_id", "action", "attempt", "not_before")


@query("restart_safety", ["recoveries"], "SELECT plan_id, mobility IN ('restartable', 'checkpointable') AND retry IN ('idempotent', 'verifiable', 'compensatable') AS safe FROM recoveries")
def restart_safety(recoveries):
    return recoveries.select("plan_id", recovery.restart_safe(F.col("mobility"), F.col("retry")).alias("safe"))


@query("session_migration", ["sessions"], "SELECT host, seq, CASE WHEN leader_only THEN 'stay' WHEN dead AND standby IS NOT NULL THEN 'promote_standby' WHEN dead THEN CASE WHEN has_checkpoint THEN 'migrate' ELSE 'degrade' END WHEN benefit > cost THEN 'migrate' ELSE 'stay' END AS decision FROM sessions")
def session_migration(sessions):
    c = F.col
    return sessions.select("host", "seq", recovery.migration(c("leader_only"), c("dead"), c("standby"), c("has_checkpoint"), c("benefit"), c("cost")).alias("decision"))


@query("checkpoint_lineage", ["checkpoints"], """SELECT event_id, baseline OR coalesce(lag(sequence) OVER w < sequence AND lag(schema_version) OVER w = schema_version AND lag(generation) OVER w = generation AND lag(input_id) OVER w = input_id AND (lag(baseline) OVER w OR place > 2), false) AS fits
FROM checkpoints WINDOW w AS (PARTITION BY task_id ORDER BY place)""")
def checkpoint_lineage(checkpoints):
    return recovery.lineage(checkpoints, "task_id", ["place"], ["schema_version", "generation", "input_id"]).select("event_id", "fits")


UPLOAD = "(CASE WHEN list_contains(r.held, l.d0) THEN 0 ELSE 40 END + CASE WHEN list_contains(r.held, l.d1) THEN 0 ELSE 30 END + l.n2)"
KEPT = f"""CASE WHEN l.attempt = 0 THEN 'incompatible' WHEN r.operations >= 40 OR 70 + l.n2 > 160 OR r.uploaded + {UPLOAD} > 1500 THEN 'budget_exceeded' WHEN l.baseline THEN 'baseline'
 WHEN r.content IS NULL OR l.sequence <= r.sequence OR l.generation <> r.generation OR l.input_id <> r.input_id THEN 'incompatible' ELSE 'incremental' END"""
STAYS = f"({KEPT} IN ('baseline', 'incremental'))"
HELD = {c: (f"CAST(NULL AS {kind})", f"CASE WHEN {STAYS} THEN l.{c} ELSE r.{c} END") for c, kind in (("content", "VARCHAR"), ("sequence", "BIGINT"), ("generation", "BIGINT"), ("input_id", "VARCHAR"), ("d0", "VARCHAR"), ("d1", "VARCHAR"))}


@query("checkpoint_artefacts", ["persisted"], ", " + fold_sql("persisted", "store", "place", {
    "outcome": ("CAST('' AS VARCHAR)", KEPT), "now_up": ("CAST(0 AS BIGINT)", f"CASE WHEN {STAYS} THEN {UPLOAD} ELSE 0 END"), "uploaded": ("CAST(0 AS BIGINT)", f"r.uploaded + CASE WHEN {STAYS} THEN {UPLOAD} ELSE 0 END"), "operations": ("CAST(0 AS BIGINT)", f"r.operations + CASE WHEN {STAYS} THEN 1 ELSE 0 END"),
    "held": ("CAST([] AS VARCHAR[])", f"CASE WHEN {STAYS} THEN list_distinct(list_concat(r.held, [l.d0, l.d1])) ELSE r.held END"), "root": ("CAST(NULL AS VARCHAR)", f"CASE WHEN {KEPT} = 'baseline' THEN l.content ELSE r.root END"),
    "shown_root": ("CAST(NULL AS VARCHAR)", f"CASE {KEPT} WHEN 'baseline' THEN l.content WHEN 'incremental' THEN r.root END"), "previous": ("CAST(NULL AS VARCHAR)", f"CASE WHEN {KEPT} = 'incremental' THEN r.content END"),
    "changed": ("CAST(NULL AS VARCHAR)", f"CASE {KEPT} WHEN 'baseline' THEN '0,1,2' WHEN 'incremental' THEN concat_ws(',', CASE WHEN l.d0 <> r.d0 THEN '0' END, CASE WHEN l.d1 <> r.d1 THEN '1' END, '2') END"), **HELD,
}, "l.event_id, r.outcome, r.now_up AS uploaded, r.shown_root AS baseline, r.previous, r.changed"))
def checkpoint_artefacts(rows):
    """Checkpoints that each store persists, whole or as what changed, within its budgets."""
    chunk = lambda d, n: F.struct(F.col(d).alias("digest"), n.cast("long").alias("size"))
    rows = rows.withColumn("chunks", F.array(chunk("d0", F.lit(40)), chunk("d1", F.lit(30)), chunk("d2", F.col("n2")))).drop("d0", "d1", "d2", "n2")
    out = recovery.persist_checkpoints(rows, ["store"], ["place"], ["generation", "input_id"], recovery.CheckpointBudget(160, 1500, 40))
    return out.withColumn("changed", F.array_join(F.col("changed").cast("array<string>"), ","))


HAS = "len(list_filter(r.live, lambda x: x.s = l.session_id)) > 0"
USED = lambda f: f"coalesce(list_sum(list_transform(r.live, lambda x: x.{f})), 0)"
MIRROR = f"""CASE WHEN l.op = 'release' THEN CASE WHEN {HAS} THEN 'released' ELSE 'unknown' END WHEN NOT l.critical OR {HAS} THEN 'refused'
 WHEN len(r.live) >= 6 OR {USED('c')} + l.compute > 20 OR {USED('m')} + l.memory > 120 OR {USED('w')} + l.network > 260 THEN 'exhausted' ELSE 'admitted' END"""


@query("mirror_admission", ["sessions"], ", " + fold_sql("sessions", "host", "seq", {
    "outcome": ("CAST('' AS VARCHAR)", MIRROR),
    "live": ("CAST([] AS STRUCT(s VARCHAR, c BIGINT, m BIGINT, w BIGINT)[])", f"CASE {MIRROR} WHEN 'released' THEN list_filter(r.live, lambda x: x.s <> l.session_id) WHEN 'admitted' THEN list_append(r.live, {{'s': l.session_id, 'c': CAST(l.compute AS BIGINT), 'm': l.memory, 'w': l.network}}) ELSE r.live END"),
}, "l.host, l.seq, r.outcome, CAST(len(r.live) AS BIGINT) AS sessions"))
def mirror_admission(sessions):
    return recovery.mirror_admission(sessions, ["host"], ["seq"], recovery.MirrorBudget(6, 20, 120, 260))


@query("attempt_restart", ["attempts", "nodes"], "SELECT a.task_id, max(a.attempt) + 1 AS attempt, (SELECT min(idx) FROM nodes n WHERE n.idx NOT IN (SELECT node FROM attempts b WHERE b.task_id = a.task_id)) AS node FROM attempts a GROUP BY a.task_id")
def attempt_restart(attempts, nodes):
    """The next attempt of each task, on the first node that hasn't tried it."""
    return recovery.restarts(attempts, nodes)
