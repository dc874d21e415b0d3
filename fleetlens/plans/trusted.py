"""Queries of audit logs and of trust, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions.oracles import fold_sql
from fleetlens.operators import audit, merkle, trust
from fleetlens.plans.catalog import levels, query, rounded

BODY = "concat_ws(';', CAST(event_id AS VARCHAR), event_type, CAST(user_id AS VARCHAR))"
AUDIT = f"audited AS (SELECT user_id AS node, ts, event_id, {BODY} AS body FROM events)"
CHAIN = fold_sql("audited", "node", "ts, event_id", {"h": (f"CAST('{audit.GENESIS}' AS VARCHAR)", "sha256(concat_ws('|', CAST(l.n AS VARCHAR), l.body, r.h))"), "previous": ("CAST('' AS VARCHAR)", "r.h")}, "l.event_id, l.node, l.body, r.n AS sequence, r.previous AS previous_hash, r.h AS event_hash")


def audit_log(events):
    body = F.concat_ws(";", F.col("event_id").cast("string"), "event_type", F.col("user_id").cast("string"))
    rows = events.select(F.col("user_id").alias("node"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "event_id", body.alias("body"))
    return audit.append_events(rows, ["node"], ["ts", "event_id"])


@query("audit_chain", ["events"], f"WITH RECURSIVE {AUDIT}, {CHAIN}")
def audit_chain(events):
    """The hash chain of each node's audit log."""
    return audit_log(events).select("event_id", "node", "body", "sequence", "previous_hash", "event_hash")


def as_cte(sql: str, name: str) -> str:
    """The last select of a fold's SQL as a named table."""
    head, _, last = sql.rpartition(") SELECT ")
    return f"{head}), {name} AS (SELECT {last})"


@query("audit_check", ["events"], f"""WITH RECURSIVE {AUDIT}, {as_cte(CHAIN, 'chain')}, broken AS (SELECT * EXCLUDE (body), CASE WHEN event_id % 107 = 4 THEN body || '!' ELSE body END AS body FROM chain WHERE event_id % 103 <> 9)
SELECT event_id, CASE WHEN sequence <> lag(sequence, 1, 0) OVER w + 1 THEN 'sequence' WHEN previous_hash <> lag(event_hash, 1, '{audit.GENESIS}') OVER w THEN 'chain' WHEN event_hash <> sha256(concat_ws('|', CAST(sequence AS VARCHAR), body, previous_hash)) THEN 'hash' END AS fault
FROM broken WINDOW w AS (PARTITION BY node ORDER BY sequence)""")
def audit_check(events):
    """Logs with events lost and changed: each event's first fault."""
    log = audit_log(events).where("event_id % 103 <> 9").withColumn("body", F.when(F.col("event_id") % 107 == 4, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return audit.check_events(log, "node").select("event_id", "fault")


PROOFS = """, steps AS (SELECT l.segment, l.i, u.lev, l.i >> u.lev AS spot, CASE WHEN (l.i >> u.lev) % 2 = 0 THEN least((l.i >> u.lev) + 1, len(u.hs) - 1) ELSE (l.i >> u.lev) - 1 END AS other, u.hs FROM leaves l JOIN up u ON u.segment = l.segment AND len(u.hs) > 1)
, paths AS (SELECT segment, i, string_agg(CASE WHEN other < spot THEN '<' ELSE '>' END || hs[other + 1], ',' ORDER BY lev) AS path, count(*) AS n FROM steps GROUP BY 1, 2)
SELECT l.segment, l.i AS leaf_index, coalesce(p.n, 0) AS steps, coalesce(p.path, '') AS path, r.root, l.i % 10 <> 3 AS proved FROM leaves l JOIN roots r USING (segment) LEFT JOIN paths p ON p.segment = l.segment AND p.i = l.i"""


def event_proofs(events, size: int):
    proofs = merkle.inclusion_proofs(events, F.expr(f"event_id div {size}"), "event_id", F.sha2("event_type", 256))
    path = F.array_join(F.transform("siblings", lambda s: F.concat(F.when(s["left"], "<").otherwise(">"), s["hash"])), ",")
    leaf = F.when(F.col("leaf_index") % 10 == 3, F.sha2(F.concat("leaf", F.lit("!")), 256)).otherwise(F.col("leaf"))
    return proofs.select("segment", "leaf_index", F.size("siblings").cast("long").alias("steps"), path.alias("path"), "root", merkle.proves(leaf, F.col("siblings"), F.col("root")).alias("proved"))


@query("inclusion_proof", ["events"], f"WITH RECURSIVE {levels(64)} {PROOFS}")
def inclusion_proof(events):
    """Each leaf's proof and whether it holds; every tenth leaf is changed, so that its proof must fail."""
    return event_proofs(events, 64)


@query("inclusion_proof_large", ["events"], f"WITH RECURSIVE {levels(700)} {PROOFS}")
def inclusion_proof_large(events):
    """Proofs over two rounds of subtrees."""
    return event_proofs(events, 700)


@query("segment_consistency", ["events"], f"""WITH RECURSIVE {levels(64)}, segments AS (SELECT e.segment, min(e.event_id) AS first, max(e.event_id) AS last, max(r.root) AS root FROM (SELECT event_id // 64 AS segment, event_id FROM events WHERE event_id % 640 <> 639) e JOIN roots r USING (segment) GROUP BY 1)
SELECT segment, CASE WHEN lag(segment) OVER w IS NOT NULL THEN segment = lag(segment) OVER w + 1 AND first = lag(last) OVER w + 1 AND segment % 7 <> 3 END AS consistent FROM segments WINDOW w AS (ORDER BY segment)""")
def segment_consistency(events):
    """Segments whose neighbours lost an event or noted another root."""
    roots = merkle.roots(events, F.expr("event_id div 64"), "event_id", F.sha2("event_type", 256)).select("segment", "root")
    segments = events.where("event_id % 640 <> 639").groupBy(F.expr("event_id div 64").alias("segment")).agg(F.min("event_id").alias("first"), F.max("event_id").alias("last")).join(roots, "segment").withColumn("log", F.lit(1))
    noted = roots.select((F.col("segment") + 1).alias("segment"), F.col("root").alias("noted"))  # what a segment would have noted of the one before
    segments = segments.join(noted, "segment", "left").withColumn("previous_root", F.when(F.col("segment") % 7 == 3, "other").otherwise(F.col("noted")))
    return audit.consistent_segments(segments, "log").select("segment", "consistent")


K = "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"
KEYS = f"CASE {K} % 6 WHEN 0 THEN 'phase' WHEN 1 THEN 'Api_Token' WHEN 2 THEN 'input_digest' WHEN 3 THEN 'PASSWORD' WHEN 4 THEN 'tokens' ELSE repeat('ä', CAST(28 + {K} % 10 AS INT)) END"


@query("metadata_rules", ["events"], f"""SELECT event_id, NOT (strlen(k) > 64 OR strlen(v) > 256 OR regexp_matches(lower(k), '^(.*_)?(secret|token|password|credential|input|output)$')) AND 1 + CASE WHEN user_id % 11 = 0 THEN 2 ELSE 0 END <= 2 AS allowed
FROM (SELECT event_id, user_id, {KEYS} AS k, repeat('é', CAST(100 + {K} AS INT)) AS v FROM events)""")
def metadata_rules(events):
    """Audit metadata that is short, scarce and names nothing sensitive."""
    extra = F.when(F.col("user_id") % 11 == 0, F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))).otherwise(F.create_map().cast("map<string,string>"))
    metadata = F.map_concat(F.create_map(F.expr(KEYS.replace("BIGINT", "BIGINT")), F.expr(f"repeat('é', CAST(100 + {K} AS INT))")), extra)
    return events.select("event_id", audit.metadata_allowed(metadata, 2).alias("allowed"))


@query("audit_trace", ["attempts"], """SELECT task_id, attempt, node, row_number() OVER (PARTITION BY task_id ORDER BY s) AS in_task, row_number() OVER (PARTITION BY task_id, least(attempt, 2) ORDER BY s) AS in_attempt, row_number() OVER (PARTITION BY node ORDER BY s) AS in_node
FROM (SELECT *, task_id * 1000 + attempt AS s FROM attempts)""")
def audit_trace(attempts):
    events = attempts.select("task_id", F.col("attempt").alias("number"), F.least("attempt", F.lit(2)).alias("attempt"), "node", (F.col("task_id") * 1000 + F.col("attempt")).alias("s"))
    return audit.traces(events, "s").select("task_id", F.col("number").alias("attempt"), "node", "in_task", "in_attempt", "in_node")


@query("audit_byte_budget", ["traffic"], ", " + fold_sql("(SELECT *, node * 100000 + date_diff('day', TIMESTAMP '2000-01-01', ts) AS slot FROM traffic)", "slot", "ts, event_id", {"written": ("false", "r.bytes + l.bytes <= 1200"), "bytes": ("CAST(0 AS BIGINT)", "r.bytes + CASE WHEN r.bytes + l.bytes <= 1200 THEN l.bytes ELSE 0 END")}, "l.event_id, r.written"))
def audit_byte_budget(traffic):
    rows = traffic.select("event_id", "ts", "bytes", (F.col("node") * 100000 + F.datediff("ts", F.lit("2000-01-01"))).alias("slot"))
    return audit.byte_budget(rows, ["slot"], ["ts", "event_id"], 1200)


@query("trust_authorisation", ["trust_tasks", "identities"], """SELECT t.task_id, CASE WHEN NOT (coalesce(i.status = 'active' AND t.now_tick BETWEEN i.valid_from AND i.valid_until, false) AND i.trust >= t.minimum_trust) THEN 'identity' WHEN NOT t.allow_external AND i.trust < 3 THEN 'external'
 WHEN t.sensitivity IN ('confidential', 'restricted', 'credential') AND i.trust < 3 THEN 'sensitivity' WHEN t.sensitivity = 'credential' AND i.trust <> 4 THEN 'credential' WHEN NOT i.integrity THEN 'integrity'
 WHEN t.require_attestation AND NOT (i.attested AND i.attested_until >= t.now_tick) THEN 'attestation' WHEN i.trust = 1 AND t.sensitivity <> 'public' THEN 'restricted' ELSE 'ok' END AS verdict FROM trust_tasks t JOIN identities i USING (node)""")
def trust_authorisation(tasks, identities):
    """The first rule by which each task's worker may not run it."""
    return tasks.drop("generation").join(identities, "node").select("task_id", trust.authorise(restricted_mode=True).alias("verdict"))


@query("authorisation_validity", ["trust_tasks", "identities"], """SELECT t.task_id, t.term = 1 AND t.epoch = 2 AND t.issued <= 35 AND 35 <= t.authorised_until AND t.known AND coalesce(i.status = 'active' AND 35 BETWEEN i.valid_from AND i.valid_until AND i.generation = t.generation, false) AS valid
FROM trust_tasks t LEFT JOIN identities i USING (node)""")
def authorisation_validity(tasks, identities):
    return trust.valid_authorisations(tasks, identities, 1, 2, F.lit(35)).select("task_id", "valid")


FRESH = lambda level: f"(l.key_fine AND l.lasts > 0 AND {level} <> 0)"
TAKEN = f"""CASE WHEN l.op = 'approve' THEN r.st IS NULL AND {FRESH('l.trust')} WHEN r.st IS NULL THEN false WHEN l.op = 'rotate' THEN r.st = 'active' AND l.now_tick <= r.until AND {FRESH('r.level')}
 WHEN l.op = 'readmit' THEN r.st IN ('revoked', 'quarantined') AND l.attested AND {FRESH('l.trust')} WHEN l.op = 'set_trust' THEN r.st = 'active' ELSE true END"""


@query("identity_life", ["identity_ops"], ", " + fold_sql("identity_ops", "node", "now_tick", {
    "ok": ("false", TAKEN), "st": ("CAST(NULL AS VARCHAR)", f"CASE WHEN NOT {TAKEN} THEN r.st WHEN l.op IN ('approve', 'rotate', 'readmit') THEN 'active' WHEN l.op = 'revoke' THEN 'revoked' WHEN l.op = 'quarantine' THEN 'quarantined' ELSE r.st END"),
    "generation": ("CAST(0 AS BIGINT)", f"r.generation + CASE WHEN {TAKEN} AND l.op IN ('approve', 'rotate', 'readmit') THEN 1 ELSE 0 END"),
    "level": ("CAST(NULL AS BIGINT)", f"CASE WHEN NOT {TAKEN} THEN r.level WHEN l.op IN ('approve', 'readmit', 'set_trust') THEN l.trust WHEN l.op = 'quarantine' THEN 0 ELSE r.level END"),
    "until": ("CAST(0 AS BIGINT)", f"CASE WHEN {TAKEN} AND l.op IN ('approve', 'rotate', 'readmit') THEN l.now_tick + l.lasts ELSE r.until END"),
}, "l.event_id, r.ok AS accepted, r.st AS status, r.generation, r.level AS trust"))
def identity_life(ops):
    return trust.identity_life(ops, ["node"], ["now_tick"])


MINIMUM = 20
AVERAGE = lambda c: f"0.95 * r.{c} + 0.05 * CASE WHEN l.{c} THEN 1.0 ELSE 0.0 END"
LATE = f"l.n >= {MINIMUM}"
KEYED = "keyed AS (SELECT *, concat(CAST(node AS VARCHAR), capability) AS key FROM reputation_events)"
REPUTATION = fold_sql("keyed", "key", "seq", {
    **{c: (f"CAST({seed} AS DOUBLE)", AVERAGE(c)) for c, seed in trust.AVERAGED.items()},
    **{f"a{i}": ("false", f"r.a{i} OR ({LATE} AND {when})") for i, when in enumerate(["l.latency_ratio >= 4", "l.cancel_refused", "l.forged", f"{AVERAGE('corruption')} >= 0.2", f"{AVERAGE('mismatch')} >= 0.2", "l.unauthorised"])},
}, """l.node, l.capability, r.n AS samples, r.succeeded, r.timed_out, r.mismatch, r.corruption, greatest(20 - r.n, 0) / 20.0 AS doubt, concat_ws(',', CASE WHEN a0 THEN 'abnormal_latency' END, CASE WHEN a1 THEN 'cancel_refused' END, CASE WHEN a2 THEN 'forged_capability' END,
 CASE WHEN a3 THEN 'resource_corruption' END, CASE WHEN a4 THEN 'result_mismatch' END, CASE WHEN a5 THEN 'unauthorised_access' END) AS anomalies""", "n = (SELECT max(n) FROM numbered x WHERE x.key = l.key)")
REP = f", {KEYED}, {as_cte(REPUTATION, 'rep')}"
NUMBERS = ["succeeded", "timed_out", "mismatch", "corruption"]
ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in NUMBERS)


def known_reputations(observations):
    return trust.reputations(observations, ["node", "capability"], ["seq"], MINIMUM)


@query("reputation", ["reputation_events"], f"{REP} SELECT node, capability, samples, {ROUND}, doubt, anomalies FROM rep")
def reputation(observations):
    return rounded(known_reputations(observations), *NUMBERS)


@query("scheduling_risk", ["reputation_events", "nodes"], f"{REP} SELECT n.node_id, c.capability, round(coalesce(1 - r.succeeded + r.timed_out + 2 * r.mismatch + 2 * r.corruption + r.doubt, 1.0), 6) AS risk FROM nodes n CROSS JOIN (SELECT unnest(['A', 'N', 'R', 'X']) AS capability) c LEFT JOIN rep r ON r.node = n.idx AND r.capability = c.capability")
def scheduling_risk(observations, nodes):
    return rounded(trust.risk(known_reputations(observations), nodes, ["A", "N", "R", "X"]), "risk")


@query("decayed_reputation", ["reputation_events"], f"{REP} SELECT node, capability, round(0.5 + (succeeded - 0.5) * pow(0.99, 10), 6) AS succeeded, round(timed_out * pow(0.99, 10), 6) AS timed_out, round(mismatch * pow(0.99, 10), 6) AS mismatch, round(corruption * pow(0.99, 10), 6) AS corruption FROM rep")
def decayed_reputation(observations):
    """Reputation after ten idle ticks."""
    return rounded(trust.decay(known_reputations(observations), 10), *NUMBERS).select("node", "capability", *NUMBERS)


@query("compromise_impact", ["attempts", "trust_tasks"], """, w AS (SELECT node, count(DISTINCT task_id) AS tasks, count(*) AS outputs, min(task_id) AS first_task FROM attempts GROUP BY 1), g AS (SELECT node, count(*) AS revoked FROM trust_tasks WHERE known GROUP BY 1)
SELECT coalesce(w.node, g.node) AS node, coalesce(tasks, 0) AS tasks, coalesce(outputs, 0) AS outputs, first_task, coalesce(revoked, 0) AS revoked, CASE WHEN tasks > 0 THEN 5 ELSE 4 END AS actions FROM w FULL JOIN g ON w.node = g.node""")
def compromise_impact(attempts, grants):
    return trust.impact(attempts, grants)


@query("compromise_provenance", ["attempts", "trust_tasks", "identities"], """, bad AS (SELECT node, 5 + row_number() OVER (ORDER BY node) AS epoch FROM identities WHERE status = 'quarantined')
SELECT DISTINCT node, epoch, 'task' AS kind, a.task_id AS item FROM bad JOIN attempts a USING (node) UNION ALL SELECT DISTINCT node, epoch, 'content', a.task_id * 10 + a.attempt FROM bad JOIN attempts a USING (node) WHERE NOT a.active UNION ALL SELECT DISTINCT bad.node, bad.epoch, 'authorisation', t.task_id FROM bad JOIN trust_tasks t USING (node) WHERE t.known""")
def compromise_provenance(attempts, grants, identities):
    """What each quarantined node has touched, a row for each task, content and authorisation, and the epoch that fences it."""
    work = attempts.select("node", F.lit("task").alias("kind"), F.col("task_id").alias("item"))
    made = attempts.where("not active").select("node", F.lit("content").alias("kind"), (F.col("task_id") * 10 + F.col("attempt")).alias("item"))
    held = grants.where("known").select("node", F.lit("authorisation").alias("kind"), F.col("task_id").alias("item"))
    return trust.provenance(identities.where("status = 'quarantined'").select("node"), work.unionByName(made).unionByName(held), 5)


@query("result_digests", ["votes"], "SELECT task_id, count(*) AS votes, CAST(sum(CASE WHEN digest = coalesce(trusted, 'A') THEN 1 ELSE 0 END) AS BIGINT) AS accepted FROM votes GROUP BY 1")
def result_digests(votes):
    verdict = trust.same_result(F.coalesce("trusted", F.lit("A")), F.col("digest"))
    return votes.groupBy("task_id").agg(F.count("*").alias("votes"), F.count_if(verdict == "accepted").alias("accepted"))


OBSERVED = "CASE WHEN vec_id % 11 = 4 THEN list_append(e, 0.0) WHEN vec_id % 13 = 5 THEN list_append(e[:len(e) - 1], CAST('nan' AS DOUBLE)) ELSE list_transform(e, lambda x: x + 0.0004 * (vec_id % 4)) END"


@query("approximate_results", ["embeddings"], f"""SELECT vec_id, CASE WHEN len(e) = len(o) AND len(list_filter(range(1, len(e) + 1), lambda i: isnan(o[i]) OR abs(e[i] - o[i]) > 0.001)) = 0 THEN 'accepted' ELSE 'quarantined' END AS status
FROM (SELECT vec_id, e, {OBSERVED} AS o FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))""")
def approximate_results(embeddings):
    """Vectors of results that are as long as the expected ones and within the tolerance."""
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    moved = F.transform("e", lambda x: x + F.lit(0.0004) * (F.col("vec_id") % 4))
    spoilt = F.concat(F.slice("e", F.lit(1), F.size("e") - 1), F.array(F.lit(float("nan"))))
    observed = F.when(F.col("vec_id") % 11 == 4, F.concat("e", F.array(F.lit(0.0)))).when(F.col("vec_id") % 13 == 5, spoilt).otherwise(moved)
    rows = rows.withColumn("o", observed)
    return rows.select("vec_id", trust.close_result(F.col("e"), F.col("o"), 0.001).alias("status"))


POLICY = "CASE WHEN irreversible OR task_value >= 90 THEN CASE WHEN policy IN ('none', 'hash_only') THEN 'manual_review' ELSE policy END WHEN task_id % 4 + 1 <= 2 AND task_value >= 50 AND policy = 'none' THEN 'spot_check' ELSE policy END"


@query("verification_plan", ["trust_tasks"], f"""SELECT task_id, p AS policy, CASE WHEN p IN ('none', 'hash_only') THEN 'accept_digest' WHEN p = 'deterministic_replay' THEN 'replay_on_independent_node' WHEN p = 'spot_check' THEN CASE WHEN rt BETWEEN 1 AND 10000 THEN 'sample' END
 WHEN p = 'n_of_m' THEN CASE WHEN required > 0 AND total >= required THEN 'collect_independent_results' END WHEN p = 'domain_verifier' THEN CASE WHEN protocol <> '' THEN 'invoke_domain_verifier' END WHEN p = 'replayable' THEN 'validate_replay_artifact' WHEN p = 'proof_carrying' THEN CASE WHEN proof <> '' THEN 'validate_proof' END ELSE 'require_manual_review' END AS action
FROM (SELECT task_id, required, total, protocol, proof, {POLICY} AS p, CASE WHEN {POLICY} = 'spot_check' AND policy = 'none' THEN 1000 ELSE rate END AS rt FROM trust_tasks)""")
def verification_plan(tasks):
    """The verification that a task's value, its worker's trust and its effects call for, and what it has done."""
    c = F.col
    policy, rate = trust.verification_policy(c("policy"), c("rate"), c("task_value"), c("task_id") % 4 + 1, c("irreversible"))
    rows = tasks.select("task_id", "required", "total", "protocol", "proof", policy.alias("p"), rate.alias("r"))
    return rows.select("task_id", c("p").alias("policy"), trust.verification_action(c("p"), c("r"), c("required"), c("total"), c("protocol"), c("proof")).alias("action"))


SECRET = b"0123456789abcdef0123456789abcdef"
PADS = ["".join(f"{b ^ pad:02x}" for b in SECRET.ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query("signed_events", ["events"], f"SELECT event_id, sha256(unhex('{PADS[1]}') || unhex(sha256(unhex('{PADS[0]}') || encode({BODY})))) AS tag FROM events")
def signed_events(events):
    """A tag of each event's canonical text by a key that is a literal of this example."""
    body = F.concat_ws(";", F.col("event_id").cast("string"), "event_type", F.col("user_id").cast("string"))
    return events.select("event_id", trust.hmac_sha256(SECRET, body).alias("tag"))


@query("canonical_json", ["events"], """SELECT event_id, sha256('{"user_id":' || user_id || ',"event_type":"' || event_type || '","event_id":' || event_id || '}') AS declared, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS sorted,
 lower(hex(encode(event_type))) AS hex, event_type AS decoded FROM events""")
def canonical_json(events):
    """Digests of an event as compact JSON, with its fields as declared (the user first) and sorted by name, and its type in hex and back."""
    declared = F.to_json(F.struct("user_id", "event_type", "event_id"), {"ignoreNullFields": "false"})
    ordered = F.to_json(F.struct(*sorted(["user_id", "event_type", "event_id"])), {"ignoreNullFields": "false"})
    hexed = F.lower(F.hex("event_type"))
    return events.select("event_id", F.sha2(declared, 256).alias("declared"), F.sha2(ordered, 256).alias("sorted"), hexed.alias("hex"), trust.decode_hex(hexed).cast("string").alias("decoded"))
