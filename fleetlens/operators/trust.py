"""Trust: identities, authorisation, verification, reputation, votes and the reach of a compromised node."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetlens.operators.folds import fold
from fleetlens.operators.places import places

#: Trust levels, and the share of mismatches or corruption and the latency ratio that are anomalies.
QUARANTINED, UNTRUSTED, RESTRICTED, MANAGED, TRUSTED = range(5)
ANOMALY_SHARE, ANOMALY_LATENCY = 0.2, 4.0


def active_at(tick: Column) -> Column:
    """An identity's status and validity, both ends included."""
    return (F.col("status") == "active") & tick.between(F.col("valid_from"), F.col("valid_until"))


def authorise(restricted_mode: bool) -> Column:
    """ok, or the first rule by which a node (identity columns) may not run a task (policy columns)."""
    sensitive = F.col("sensitivity").isin("confidential", "restricted", "credential")
    verdict = (
        F.when(~(F.coalesce(active_at(F.col("now_tick")), F.lit(False)) & (F.col("trust") >= F.col("minimum_trust"))), "identity")
        .when(~F.col("allow_external") & (F.col("trust") < MANAGED), "external").when(sensitive & (F.col("trust") < MANAGED), "sensitivity")
        .when((F.col("sensitivity") == "credential") & (F.col("trust") != TRUSTED), "credential").when(~F.col("integrity"), "integrity")
        .when(F.col("require_attestation") & ~(F.col("attested") & (F.col("attested_until") >= F.col("now_tick"))), "attestation")
    )
    if restricted_mode:
        verdict = verdict.when((F.col("trust") == UNTRUSTED) & (F.col("sensitivity") != "public"), "restricted")
    return verdict.otherwise("ok")


def valid_authorisations(grants: DataFrame, identities: DataFrame, term: int, epoch: int, now: Column) -> DataFrame:
    """grants (node, term, epoch, issued, authorised_until, generation, known) with valid: current, not revoked, and given to
    the identity that the node has now."""
    joined = grants.join(identities.select("node", "status", "valid_from", "valid_until", F.col("generation").alias("own_generation")), "node", "left")
    valid = (
        (F.col("term") == term) & (F.col("epoch") == epoch) & now.between(F.col("issued"), F.col("authorised_until")) & F.col("known")
        & F.coalesce(active_at(now) & (F.col("own_generation") == F.col("generation")), F.lit(False))
    )
    return joined.withColumn("valid", valid)


def identity_life(ops: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """event_id, outcome and the identity's status, generation and trust after each operation (op, now_tick, trust, key_fine:
    key material that may be used, lasts: ticks that it would be valid, attested)."""

    def fresh(r: dict, trust: int) -> bool:
        return r["key_fine"] and r["lasts"] > 0 and trust != QUARANTINED

    def step(s: dict, r: dict) -> tuple:
        op, ok, now = r["op"], False, r["now_tick"]
        known = s["status"] is not None
        if op == "approve":
            ok = not known and fresh(r, r["trust"])
            if ok:
                s.update(status="active", generation=1, trust=r["trust"], until=now + r["lasts"])
        elif known and op == "rotate":
            ok = s["status"] == "active" and now <= s["until"] and fresh(r, s["trust"])
            if ok:
                s.update(generation=s["generation"] + 1, until=now + r["lasts"])
        elif known and op == "readmit":
            ok = s["status"] in ("revoked", "quarantined") and r["attested"] and fresh(r, r["trust"])
            if ok:
                s.update(status="active", generation=s["generation"] + 1, trust=r["trust"], until=now + r["lasts"])
        elif known and op == "set_trust":
            ok = s["status"] == "active"
            if ok:
                s["trust"] = r["trust"]
        elif known and op in ("revoke", "quarantine"):
            ok, s["status"] = True, "revoked" if op == "revoke" else "quarantined"
            if op == "quarantine":
                s["trust"] = QUARANTINED
        return r["event_id"], ok, s["status"], s["generation"], s["trust"]

    return fold(ops, keys, order, lambda: dict(status=None, generation=0, trust=None, until=0), step, "event_id long, accepted boolean, status string, generation long, trust long")


#: The flags of an observation that are averaged, with their seeds, and those that are anomalies at once.
AVERAGED = {"succeeded": 0.5, "timed_out": 0.0, "mismatch": 0.0, "corruption": 0.0}
AT_ONCE = {"forged": "forged_capability", "cancel_refused": "cancel_refused", "unauthorised": "unauthorised_access"}


#: Rows of a running average that are taken at once: its powers stay well within a double.
AVERAGE_ROWS = 512


def running_average(x: np.ndarray, start: np.ndarray, alpha: float) -> np.ndarray:
    """The moving averages after each row of x (rows, columns), begun at start."""
    out = np.empty_like(x)
    for a in range(0, len(x), AVERAGE_ROWS):
        part = x[a : a + AVERAGE_ROWS]
        keep = (1 - alpha) ** np.arange(1, len(part) + 1)[:, None]
        out[a : a + len(part)] = keep * (start + alpha * np.cumsum(part / keep, axis=0))
        start = out[a + len(part) - 1]
    return out


def reputations(observations: DataFrame, keys: list[str], order: list[str], minimum: int, alpha: float = 0.05) -> DataFrame:
    """Per key: samples, slow averages of four flags, doubt (what is missing of `minimum` samples) and anomalies (sorted names),
    which stay once they are seen from the minimum on. Observations of no finite latency, or a negative one, don't count.

    A key's rows stream in order by Arrow batches; each run of a key within one is taken by a few vector operations."""
    flags, once = list(AVERAGED), list(AT_ONCE)
    types = {f.name: f.dataType.simpleString() for f in observations.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", samples long, " + ", ".join(f"{f} double" for f in flags) + ", doubt double, anomalies string"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, averages, seen = None, 0, None, set()
        found: list[tuple] = []

        def close() -> None:
            if key is not None and n:
                found.append((*key, n, *averages.tolist(), max(minimum - n, 0) / minimum, ",".join(sorted(seen))))

        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            ratio = column("latency_ratio").cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            counts = (ratio >= 0) & (ratio < np.inf)
            x = np.column_stack([column(c).cast(pa.uint8()).fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64) for c in flags])
            sharp = np.column_stack([column(c).cast(pa.uint8()).fill_null(0).to_numpy(zero_copy_only=False) > 0 for c in once])
            codes = np.column_stack([column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in keys])
            cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1)) + 1).tolist(), len(codes)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                own = tuple(column(k)[a].as_py() for k in keys)
                if own != key:
                    close()
                    key, n, averages, seen = own, 0, np.array(list(AVERAGED.values())), set()
                at = a + np.flatnonzero(counts[a:b])
                if not len(at):
                    continue
                after = running_average(x[at], averages, alpha)
                late = slice(max(0, minimum - n - 1), None)
                seen |= {name for i, name in enumerate(AT_ONCE.values()) if sharp[at][late, i].any()}
                seen |= {name for flag, name in (("mismatch", "result_mismatch"), ("corruption", "resource_corruption")) if (after[late, flags.index(flag)] >= ANOMALY_SHARE).any()}
                if (ratio[at][late] >= ANOMALY_LATENCY).any():
                    seen.add("abnormal_latency")
                n, averages = n + len(at), after[-1]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], type=f.type) for i, f in enumerate(arrow)], schema=arrow)
            found.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], type=f.type) for i, f in enumerate(arrow)], schema=arrow)

    rows = observations.select(*keys, *[c for c in order if c not in keys], "latency_ratio", *flags, *once)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def decay(known: DataFrame, ticks: int) -> DataFrame:
    """Reputations after idle ticks: reliability drifts to one half, the others to zero."""
    kept = 0.99**ticks
    return known.withColumns({"succeeded": 0.5 + (F.col("succeeded") - 0.5) * kept, **{c: F.col(c) * kept for c in ("timed_out", "mismatch", "corruption")}})


def risk(known: DataFrame, nodes: DataFrame, capabilities: list[str]) -> DataFrame:
    """Scheduling risk of every node and capability; unknown ones are 1."""
    wanted = nodes.select("idx", "node_id", F.explode(F.array(*[F.lit(c) for c in capabilities])).alias("capability"))
    cost = (1 - F.col("succeeded")) + F.col("timed_out") + F.col("mismatch") * 2 + F.col("corruption") * 2 + F.col("doubt")
    joined = wanted.join(known.select(F.col("node").alias("idx"), "capability", cost.alias("r")), ["idx", "capability"], "left")
    return joined.select("node_id", "capability", F.coalesce("r", F.lit(1.0)).alias("risk"))


def n_of_m(votes: DataFrame, required: int, total: int) -> DataFrame:
    """accepted, quarantined or, without a trusted digest, manual_review."""
    counted = votes.groupBy("task_id").agg(F.count("*").alias("votes"), F.max("trusted").alias("trusted"), F.count_if(F.col("digest") == F.col("trusted")).alias("matching"))
    status = F.when(F.col("trusted").isNull(), "manual_review").when(F.col("votes").between(required, total) & (F.col("matching") >= required), "accepted").otherwise("quarantined")
    return counted.select("task_id", "votes", status.alias("status"))


def same_result(expected: Column, observed: Column) -> Column:
    """accepted where the digests of two results agree, else quarantined."""
    return F.when(F.sha2(expected, 256) == F.sha2(observed, 256), "accepted").otherwise("quarantined")


def close_result(expected: Column, observed: Column, tolerance: float) -> Column:
    """accepted where two vectors of one length are finite and differ by the tolerance at most anywhere, else quarantined."""
    finite = lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))
    near = F.forall(F.arrays_zip(expected.alias("e"), observed.alias("o")), lambda p: F.coalesce(finite(p["e"]) & finite(p["o"]) & (F.abs(p["e"] - p["o"]) <= tolerance), F.lit(False)))
    return F.when((F.size(expected) == F.size(observed)) & near, "accepted").otherwise("quarantined")


def domain_verifier(verify):
    """A function of two columns (expected and observed bytes) that asks verify(expected, observed) of a domain: Arrow batches, as
    only its owner knows the rule. A row with a null on either side isn't verified."""

    def run(expected: pd.Series, observed: pd.Series) -> pd.Series:
        return pd.Series([None if e is None or o is None else bool(verify(bytes(e), bytes(o))) for e, o in zip(expected, observed)], dtype="object")

    return F.pandas_udf(run, "boolean")


def verification_policy(requested: Column, rate: Column, value: Column, trust: Column, irreversible: Column) -> tuple[Column, Column]:
    """The policy that a task's value, its worker's trust and its effects call for, and its spot-check rate."""
    grave = irreversible | (value >= 90)
    checked = ~grave & (trust <= RESTRICTED) & (value >= 50) & (requested == "none")
    policy = F.when(grave & requested.isin("none", "hash_only"), "manual_review").when(checked, "spot_check").otherwise(requested)
    return policy, F.when(checked, F.lit(1000).cast("long")).otherwise(rate.cast("long"))


def verification_action(policy: Column, rate: Column, required: Column, total: Column, protocol: Column, proof: Column) -> Column:
    """What a policy has done; null for one that can't be carried out: a spot check whose rate isn't 1 to 10,000 basis points, a
    vote of none or of fewer than it requires, a verifier or proof without a name."""
    named = lambda c: F.coalesce(c != "", F.lit(False))
    return (
        F.when(policy.isin("none", "hash_only"), "accept_digest").when(policy == "deterministic_replay", "replay_on_independent_node").when((policy == "spot_check") & rate.between(1, 10_000), "sample")
        .when((policy == "n_of_m") & (required > 0) & (total >= required), "collect_independent_results").when((policy == "domain_verifier") & named(protocol), "invoke_domain_verifier").when(policy == "replayable", "validate_replay_artifact")
        .when((policy == "proof_carrying") & named(proof), "validate_proof").when(policy == "manual_review", "require_manual_review")
    )


def hmac_sha256(key: bytes, payload: Column) -> Column:
    """HMAC-SHA256 in hex by two nested digests; the key is a literal of the plan, never a column."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, payload.cast("binary")), 256))), 256)


def decode_hex(value: Column) -> Column:
    """The bytes of a hex string of even length in either case, else null."""
    return F.when(value.rlike("^([0-9a-fA-F]{2})*$"), F.unhex(value))


def impact(attempts: DataFrame, grants: DataFrame) -> DataFrame:
    """What isolating each node touches: tasks, outputs, revoked authorisations, and how many actions follow."""
    work = attempts.groupBy("node").agg(F.countDistinct("task_id").alias("tasks"), F.count("*").alias("outputs"), F.min("task_id").alias("first_task"))
    held = grants.where("known").groupBy("node").agg(F.count("*").alias("revoked"))
    out = work.join(held, "node", "full")
    n = lambda c: F.coalesce(c, F.lit(0))
    return out.select("node", n("tasks").alias("tasks"), n("outputs").alias("outputs"), "first_task", n("revoked").alias("revoked"), (F.lit(4) + (n("tasks") > 0).cast("int")).alias("actions"))


def provenance(isolated: DataFrame, touched: DataFrame, epoch: int) -> DataFrame:
    """node, epoch, kind and item of all that isolated nodes (node, isolated in this order) touched (node, kind, item), each once: a
    list as rows, as one node may have touched a third of everything. Each isolation raises the epoch before it by one."""
    order = places(isolated.select("node").distinct(), [], ["node"], 100_000).select("node", (F.lit(epoch + 1) + F.col("place")).alias("epoch"))
    return touched.join(order, "node").select("node", "epoch", "kind", "item").distinct()


def quorum(votes: DataFrame, valid, required: int) -> DataFrame:
    """Per task: enough signers, every one of them valid."""
    return votes.groupBy("task_id").agg(F.count("*").alias("signers"), ((F.count("*") >= required) & F.bool_and(valid)).alias("passed"))
