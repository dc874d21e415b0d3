"""Report merges, classifications, checkpoint budgets, provenance and the report sink by literal cases."""

import statistics

from pyspark.sql import functions as F

from fleetlens.operators import recovery, registry, reports, trust
from fleetlens.plans import catalog
from fleetlens.sources import files

SF = "/root/testdata/sf0.01"


def test_every_class_of_a_report_occurs(spark):
    found = {r.lane: r.classification for r in catalog.QUERIES["report_classification"](spark, SF).collect()}
    assert found == {0: "none", 1: "framework_suspect", 2: "regression", 3: "environmental", 4: "case_specific"}


def test_gates_of_single_cases_pass_and_fail(spark):
    assert {"gate_failed", "environmental"} <= {r.noise for r in catalog.QUERIES["noise_classification"](spark, SF).collect()}


def test_merges_take_whole_reports_of_any_run(spark):
    rows = [(r, "p", "w", "batch", 1, 2, 4, float(v), v % 3) for r, v in enumerate([5, 1, 4, 2, 9, 7])] + [(9, "q", None, "batch", 1, 2, 4, 3.0, 1)]
    df = spark.createDataFrame(rows, "run int, case_id string, workload string, latency_class string, nodes int, variants int, top_k int, decision_ns double, evaluated int")
    out = {r.case_id: r for r in reports.merge_placement(df).collect()}
    values = [r[7] for r in rows[:6]]
    assert (out["p"].n, out["p"].median, out["p"].evaluated) == (6, statistics.median(values), statistics.median([r[8] for r in rows[:6]])) and out["q"].n == 1
    windows = spark.createDataFrame([("durable", 10, 100.0, 5), ("durable", 10, 104.0, 5), ("durable", 10, 180.0, 5), ("fast", 10, 1.0, 5), ("fast", 10, 9.0, 6), ("fast", 20_000, 9.0, 6)], "acceptance string, mutations long, window_ns double, window_mutations int")
    found = {r.acceptance: (r.valid, r.steady, round(r.jitter, 4)) for r in reports.merge_windows(windows).collect()}
    assert found == {"durable": (True, True, round(4 / 104, 4)), "fast": (False, True, 0.8)}


def test_scaling_needs_both_sides_and_judges_large_totals_only(spark):
    rows = [("a", 4, 100, 1.0), ("a", 16, 100, 1.0), ("b", 4, 100, 1.0), ("c", 4, 100, 1.0), ("c", 16, 100, 4.0), ("d", 4, 5, 1.0), ("d", 16, 5, 4.0)]
    df = spark.createDataFrame(rows, "k string, concurrency int, work long, spent double")
    assert {r.k: r.passed for r in reports.scaling(df, ["k"], "work", "spent", 4, 16, 0.9, 50).collect()} == {"a": True, "b": False, "c": False, "d": True}


def test_reports_go_out_and_come_back(spark, tmp_path):
    cases = spark.createDataFrame([("c1", 4, "x", 1.5, 7), ("c2", 16, None, None, 8)], "case_id string, concurrency int, lane string, median double, n long")
    for _ in range(2):
        files.write_report(cases, ["concurrency", "lane"], str(tmp_path / "report"))
    back = files.read_report(spark, str(tmp_path / "report"), "concurrency: int, lane: string", "median: double, n: long")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cases.collect()))


def test_checkpoints_upload_what_is_new_within_their_budget(spark):
    chunk = lambda d, n=10: (d, n)
    rows = [
        (1, 0, 1, 7, True, "c1", [chunk("a"), chunk("b"), chunk("b")]), (2, 5, 1, 7, False, "c2", [chunk("a"), chunk("x"), chunk("b"), chunk("n")]), (3, 5, 1, 7, False, "c3", [chunk("a")]),
        (4, 6, 1, 8, False, "c4", [chunk("a")]), (5, 6, 0, 7, False, "c5", [chunk("a")]), (6, 6, 1, 7, False, "c6", [chunk("big", 90)]), (7, 6, 1, 7, False, "c7", [chunk("b"), chunk("x")]),
        (8, 0, 1, 7, True, "c8", None), (9, 1, 1, 7, False, "c9", [chunk("a")]), (10, 2, 1, 7, False, "c10", [chunk("a")]),
    ]
    df = spark.createDataFrame([(1, r[0], *r) for r in rows], "store int, place int, event_id long, sequence long, attempt int, generation int, baseline boolean, content string, chunks array<struct<digest string, size long>>")
    out = recovery.persist_checkpoints(df, ["store"], ["place"], ["generation"], recovery.CheckpointBudget(80, 60, 5)).orderBy("event_id").collect()
    assert [tuple(r)[1:] for r in out] == [
        ("baseline", 20, "c1", None, [0, 1, 2]), ("incremental", 20, "c1", "c1", [1, 3]), ("incompatible", 0, None, None, None), ("incompatible", 0, None, None, None), ("incompatible", 0, None, None, None),
        ("budget_exceeded", 0, None, None, None), ("incremental", 0, "c1", "c2", [0]), ("baseline", 0, "c8", None, []), ("incremental", 0, "c8", "c8", [0]), ("budget_exceeded", 0, None, None, None),
    ]


def test_provenance_is_rows_under_epochs_in_order(spark):
    touched = spark.createDataFrame([(2, "task", 1), (2, "task", 1), (2, "content", 5), (1, "task", 3), (9, "task", 4)], "node long, kind string, item long")
    out = trust.provenance(spark.createDataFrame([(2,), (1,), (7,)], "node long"), touched, 10)
    assert sorted(map(tuple, out.collect())) == [(1, 11, "task", 3), (2, 12, "content", 5), (2, 12, "task", 1)]


def test_plans_follow_the_last_attempt_and_both_generations(spark):
    row = dict(failure="dead", allow_speculative=False, deadline=None, now_tick=100, attempts=1, last_attempt=4, max_attempts=9, quality=1.0, eligible=True, inputs_recoverable=True, wanted_runner=1, wanted_plugin=7, hint=None, tier="restartable", mobility="restartable", retry="idempotent", has_checkpoint=False, checkpoint_fits=False, has_standby=False)
    rows = [row, row | dict(last_attempt=None), row | dict(wanted_plugin=8), row | dict(hint="r9")]
    kinds = "failure string, allow_speculative boolean, deadline long, now_tick long, attempts long, last_attempt long, max_attempts long, quality double, eligible boolean, inputs_recoverable boolean, wanted_runner int, wanted_plugin int, hint string, tier string, mobility string, retry string, has_checkpoint boolean, checkpoint_fits boolean, has_standby boolean"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], kinds)
    runners = F.array(F.struct(F.lit("r1").alias("runner_id"), F.lit(1).alias("generation"), F.lit(7).alias("plugin")))
    assert [(r.action, r.attempt, r.not_before) for r in recovery.plan(df, runners, 0.5, 5, 60).collect()] == [("restart", 5, 160), ("restart", 1, 105), ("fail", None, None), ("fail", None, None)]


def test_shapes_of_verification_that_cannot_be_carried_out(spark):
    rows = [("n_of_m", 0, 2, 3, "p", "x"), ("n_of_m", 0, 0, 3, "p", "x"), ("n_of_m", 0, 4, 3, "p", "x"), ("domain_verifier", 0, 1, 1, "", "x"), ("domain_verifier", 0, 1, 1, "p", ""), ("proof_carrying", 0, 1, 1, "p", None), ("proof_carrying", 0, 1, 1, "", "x"), ("spot_check", 10_001, 1, 1, "p", "x")]
    df = spark.createDataFrame(rows, "policy string, rate long, required int, total int, protocol string, proof string")
    out = df.select(trust.verification_action(*[F.col(c) for c in df.columns])).collect()
    assert [r[0] for r in out] == ["collect_independent_results", None, None, None, "invoke_domain_verifier", None, "validate_proof", None]


def test_chains_of_empty_payloads_and_odd_versions(spark):
    rows = spark.createDataFrame([("n", 1, None, "r", None), ("n", 2, "x", "r", -3), ("n", 3, "", "r", 0)], "node string, at int, payload string, record string, version long")
    log = registry.chain_transactions(rows, ["node"], ["at"])
    own = registry.transaction_id(F.col("previous_id"), F.col("log_index"), F.col("version"), F.col("payload"))
    assert log.where(own == F.col("transaction_id")).count() == 3
