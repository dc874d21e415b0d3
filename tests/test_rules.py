"""Rules by literal cases, folds over many batches, exact places in sorted values, and stored records round and back."""

import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import aggregates, audit, flow, ha, recovery, registry, scheduling, trust
from fleetlens.operators.folds import fold
from fleetlens.sources import control, files, wal


def task(*log):
    """Outcomes and the last state of (mutation, attempt, node, content) commands."""
    s = dict(state=None, last=0, active=None, staged=None, conflicts=0)
    said = [registry.apply_mutation(s, dict(zip(("mutation", "attempt", "node", "content"), (*c, 0, 0, 0)[:4])) | {"fast": False}) for c in log]
    return [x[0] for x in said], s["state"], s["conflicts"]


@pytest.mark.parametrize("log,said,state,conflicts", [
    ([("submit",), ("assign", 1, 7), ("running", 1), ("stage", 1, 7, 5), ("commit", 0, 0, 5)], "aaaaa", "committed", 0),
    ([("assign", 1, 7)], "r", None, 0),
    ([("submit",), ("submit",), ("assign", 0, 7)], "arr", "persisted", 0),
    ([("submit",), ("assign", 2, 7), ("assign", 2, 8), ("assign", 3, 8), ("running", 2), ("running", 3)], "aarara", "running", 0),
    ([("submit",), ("assign", 1, 7), ("stage", 1, 8, 5), ("stage", 1, 7, 5), ("assign", 2, 9), ("commit", 0, 0, 6)], "aacarr", "output_staged", 1),
    ([("submit",), ("assign", 1, 7), ("running", 1), ("recover",), ("stage", 1, 7, 5), ("assign", 2, 7)], "aaaara", "assigned", 0),
    ([("submit",), ("cancel",), ("fail",), ("conflict", 1, 7, 5)], "aara", "cancelled", 1),
])
def test_task_mutations(log, said, state, conflicts):
    assert task(*log) == (list(said), state, conflicts)


def test_folds_go_on_over_batches_and_keep_keys_apart(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = spark.range(5000).select((F.col("id") % 7).alias("key"), "id").union(spark.range(0).select("id", "id"))
        out = fold(rows, ["key"], ["id"], lambda: {"n": 0, "last": -1}, lambda s, r: s.update(n=s["n"] + 1, last=r["id"]), "key long, n long, last long", lambda k, s: [(*k, s["n"], s["last"])])
        assert {r.key: (r.n, r.last) for r in out.collect()} == {k: (len(range(k, 5000, 7)), max(range(k, 5000, 7))) for k in range(7)}
        assert fold(rows.where("false"), ["key"], ["id"], dict, lambda s, r: (1,), "n long").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1001])
def test_places_in_sorted_values(spark, n):
    rng = random.Random(n)
    values = [rng.choice([0.0, rng.uniform(-5, 5), rng.uniform(0, 1e6), 3.0, -1e-9]) for _ in range(n)]
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", None)], "k string, v double")
    row = aggregates.distribution(rows, ["k"], "v").first()
    s = sorted(values)
    median = (s[(n - 1) // 2] + s[n // 2]) / 2
    far = sorted(abs(v - median) for v in values)
    assert (row.n, row.least, row.most, row["median"]) == (n, s[0], s[-1], median) and row.mad == (far[(n - 1) // 2] + far[n // 2]) / 2
    assert (row.p95, row.p99) == (s[-(-n * 95 // 100) - 1], s[-(-n * 99 // 100) - 1])
    assert aggregates.indexed_percentile(rows, ["k"], "v", 95).first().i95 == s[(n - 1) * 95 // 100]


def test_admission_keeps_what_is_reserved_for_local_work(spark):
    rows = [(1, "a", 4, 100, 0, 1, True, 1, 10, 1, 5), (1, "b", 1, 10, 0, 1, True, 1, 10, 2, 5), (1, "c", 1, 10, 0, 1, False, 1, 99, 3, 9), (1, "d", 1, 100, 0, 1, True, 1, 10, 4, 5), (1, "e", 1, 1, 0, 1, True, 1, 70, 5, 5), (1, "f", 1, 1, 0, 1, True, 2, 0, 5, 5), (1, "b", 1, 10, 0, 1, True, 1, 10, 6, 5), (1, "g", 1, 1, 0, 1, False, 1, 0, 7, 0)]
    table = spark.createDataFrame(rows, "node long, reservation_id string, cpu long, memory long, vram long, threads long, remote boolean, version long, pressure long, tick long, lasts long")
    out = [r.outcome for r in scheduling.admit_reservations(table).orderBy("tick", "outcome").collect()]
    assert out == ["accept", "overloaded", "accept", "insufficient_memory", "capability_changed", "overloaded", "accept", "retry_after"]


def test_detector_restores_and_outdates(spark):
    rows = [(1, "pulse", 1, "healthy", 0, 1), (2, "register", 1, "healthy", 0, 2), (3, "pulse", 1, "healthy", 5, 11), (4, "pulse", 2, "healthy", 0, 12), (5, "pulse", 1, "overloaded", 9, 40)]
    table = spark.createDataFrame([(1, *r) for r in rows], "node long, event_id long, op string, capability_version long, health string, pressure long, tick long").withColumn("resource_version", F.lit(3))
    out = {r.event_id: (r.before, r.disposition, r.health) for r in ha.detect(table, ["node"], ["tick"]).collect()}
    assert out == {1: (None, "unknown", None), 2: (None, "registered", "healthy"), 3: ("suspect", "accepted", "healthy"), 4: ("healthy", "full_snapshot_required", "incompatible"), 5: ("dead", "accepted", "overloaded")}


def test_restarts_take_the_first_node_not_tried(spark):
    rng = random.Random(3)
    tried = {t: [rng.randrange(1, 9) for _ in range(rng.randrange(1, 7))] for t in range(60)} | {60: list(range(1, 9))}
    attempts = spark.createDataFrame([(t, i + 1, n) for t, ns in tried.items() for i, n in enumerate(ns)], "task_id long, attempt long, node long")
    out = {r.task_id: (r.attempt, r.node) for r in recovery.restarts(attempts, spark.range(1, 9).withColumnRenamed("id", "idx")).collect()}
    assert out == {t: (len(ns) + 1, min(set(range(1, 9)) - set(ns), default=None)) for t, ns in tried.items()}


def test_keyed_tags_and_transaction_ids(spark):
    rows = spark.createDataFrame([("",), ("pay",), ("é" * 100,)], "p string")
    for key in (b"k" * 32, b"k" * 100):
        assert [r[0] for r in rows.select(trust.hmac_sha256(key, F.col("p"))).collect()] == [hmac.new(key, r.p.encode(), hashlib.sha256).hexdigest() for r in rows.collect()]
    own = rows.select(registry.transaction_id(F.lit("ab"), F.lit(258), F.lit(3), F.col("p")))
    assert [r[0] for r in own.collect()] == [hashlib.sha256(b"ab" + (258).to_bytes(8, "little") + (3).to_bytes(8, "little") + r.p.encode()).hexdigest() for r in rows.collect()]
    odd = spark.createDataFrame([("0aFF",), ("0",), ("xy",), ("",), (None,)], "h string").select(trust.decode_hex(F.col("h")))
    assert [None if r[0] is None else bytes(r[0]) for r in odd.collect()] == [b"\x0a\xff", None, None, b"", None]


def test_a_domain_decides_on_its_results(spark):
    rows = spark.createDataFrame([(b"1", b"01"), (b"1", b"2"), (None, b"1")], "e binary, o binary")
    verifier = trust.domain_verifier(lambda e, o: int(e) == int(o))
    assert [r[0] for r in rows.select(verifier("e", "o")).collect()] == [True, False, None]


def test_budget_of_telemetry_by_class_and_pressure(spark):
    rows = [(1, "correctness", 99), (2, "summary", 89), (3, "summary", 90), (4, "discardable", 59), (5, "discardable", 60), (6, "summary", 0), (7, "correctness", 0)]
    table = spark.createDataFrame([(1, i, c, k) for i, c, k in rows], "slot long, event_id long, class string, k long")
    out = [r.event_id for r in flow.telemetry_admission(table, ["slot"], ["event_id"], 3).where("accepted").collect()]
    assert sorted(out) == [1, 2, 4, 7]


def events(spark, n=40):
    rows = spark.range(1, n + 1).select((F.col("id") % 3).alias("node"), "id", F.concat(F.lit("body-"), F.col("id")).alias("body"))
    return audit.append_events(rows, ["node"], ["id"]).withColumn("tick", F.floor(F.col("sequence") / 4)).drop("id")


def test_audit_log_as_lines(spark, tmp_path):
    path = f"file://{tmp_path}/audit"
    log = events(spark)
    assert files.write_audit(log, path).count() == 0
    (tmp_path / "audit" / "blank.json").write_text("\n\n")
    assert files.read_audit(spark, path).count() == 40
    files.write_audit(log.limit(1).withColumn("body", F.lit("forged")).withColumn("sequence", F.lit(99).cast("long")), path)
    with pytest.raises(files.BrokenChain):
        files.read_audit(spark, path)
    left = files.write_audit(log, f"file://{tmp_path}/small", budget=900)
    assert 0 < left.count() < 40 and spark.read.text(f"file://{tmp_path}/small").count() == 40 - left.count()


def test_snapshots_and_catalogues(spark, tmp_path):
    path = f"file://{tmp_path}/snapshot"
    assert files.read_snapshot(spark, path, "a long").count() == 0
    for n in (3, 5):
        files.write_snapshot(spark.range(n).withColumnRenamed("id", "a"), path)
    assert files.read_snapshot(spark, path, "a long").count() == 5
    catalog = spark.createDataFrame([("d", 3, ["x", None])], "digest string, size long, copies array<string>")
    files.write_catalog(catalog, f"file://{tmp_path}/catalog")
    assert files.read_catalog(spark, f"file://{tmp_path}/catalog", "digest string, size long, copies array<string>").collect() == catalog.collect()


def test_chunk_store_finds_what_is_missing_and_corrupt(spark, tmp_path):
    parts = [b"abcd", b"efgh", b"\x00\xff", b"lost", b"bad!"]
    names = [hashlib.sha256(p).hexdigest() for p in parts]
    for name, part in zip(names[:3] + names[4:], parts[:3] + [b"BAD!"]):
        (tmp_path / name).write_bytes(part)
    wanted = {"whole": [0, 1, 2], "missing": [0, 3], "corrupt": [0, 4]}
    manifests = [(hashlib.sha256(b"".join(parts[i] for i in at)).hexdigest(), [names[i] for i in at]) for at in wanted.values()]
    wrong = (hashlib.sha256(b"other").hexdigest(), [names[0]])
    out = {r.digest: r.verdict for r in files.read_contents(spark, f"file://{tmp_path}", spark.createDataFrame([*manifests, wrong], "digest string, chunks array<string>")).collect()}
    assert [out[m[0]] for m in manifests] == list(wanted) and out[wrong[0]] == "corrupt"


def test_reports_are_read_sample_by_sample(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"run": 1, "content_bytes": 8, "concurrency": 4,\n "correctness": {"stale": 0}, "cases": [{"name": "miss", "elapsed_ns": [1.5, 2.5]}, {"name": "hit", "elapsed_ns": []}]}')
    (tmp_path / "b.json").write_text('{"run": 2, "lane": "fixed"')
    out = files.read_reports(spark, f"file://{tmp_path}").collect()
    assert [(r.run, r.aggregate_bytes, r.lane, r.name, r.elapsed) for r in out] == [(1, 32, "per-transfer", "miss", 1.5), (1, 32, "per-transfer", "miss", 2.5)]


def test_log_pairs_round_trip(spark, tmp_path):
    files.write_pairs([(1, "t1", b"one"), (2, "t2", b"two")], str(tmp_path / "segment"))
    frames = wal.read_frames(spark, f"file://{tmp_path}")
    assert [(r.kind, r.log_index, bytes(r.payload)) for r in frames.orderBy("offset").collect()] == [(1, 1, b"one"), (2, 1, b"t1"), (1, 2, b"two"), (2, 2, b"t2")]
    assert {bytes(r.payload) for r in wal.committed(frames).collect()} == {b"one", b"two"}


def test_frames_and_pages(spark):
    rows = spark.createDataFrame([(1, '{"k": 5}'), (2, '{"k": "x"}'), (3, "{"), (4, None), (5, '{"k": 5, "pad": "%s"}' % ("z" * 100))], "id long, f string")
    assert [r.id for r in control.decode(rows, "f", "k long", most=50).where("accepted").collect()] == [1]
    framed = control.encode(rows, ["id", "f"], most=40)
    assert [r.id for r in framed.where("frame is null").collect()] == [5]
    log = spark.createDataFrame([(i,) for i in [3, 9, 70_000, 70_001, 140_000]], "s long")
    assert [r.s for r in control.events_after(log, "s", 9, 2).collect()] == [70_000, 70_001]
    assert [(r.s, r.page, r.last_of_page) for r in control.pages(log, "s", 2).orderBy("s").collect()] == [(3, 0, False), (9, 0, True), (70_000, 1, False), (70_001, 1, True), (140_000, 2, True)]
