"""Placement: short lists against all pairs, service levels of requests, and what makes a request invalid."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import scheduling

NODE = "idx long, node_id string, bits long, pressure int, health string, identity string, integrity boolean, trust int, os string, abi string, memory long, vram long, has_a int, has_b int, generations array<int>"


def nodes_of(rng, n):
    bits = [1, 4, 8, 1 << 40, -(1 << 63)]
    return [
        (i, f"n{(i * 7) % n:03d}", sum(b for b in bits if rng.random() < 0.6), rng.randrange(6), rng.choice(["healthy"] * 5 + ["suspect"]), rng.choice(["active"] * 6 + ["revoked"]), rng.random() < 0.9, rng.randrange(1, 5),
         rng.choice(["linux", "macos"]), "x86", rng.choice([512, 1024, 4096]), 0, rng.choice([0, 1, 2, None]), rng.choice([5, 6, 7, None]), rng.sample([7, 8], rng.randrange(1, 3)))
        for i in range(n)
    ]


def test_short_lists_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    nodes = nodes_of(rng, 120)
    kinds = []
    for k in range(150):
        kinds.append((f"k{k}", rng.choice([0, 1, 5, 8, 1 << 40, -(1 << 63), 2]), rng.randrange(3), rng.choice([None, "linux"]), None, rng.choice([512, 1024]), 0, rng.choice([None, None, 7]), k % 9 == 4, rng.randrange(120), rng.choice([0, 1, 2, 9, None]), rng.choice([5, 6, 7, 99, None])))
    names = ["kind", *scheduling.CLASS, "local_only", "local_idx", "content_a", "content_b"]
    df = spark.createDataFrame(kinds, "kind string, required_bits long, minimum_trust int, required_os string, required_abi string, required_memory long, required_vram long, required_generation int, local_only boolean, local_idx long, content_a int, content_b int")
    df = df.withColumns({c: F.lit(None).cast("double") for c in scheduling.KIND if c not in names})
    out = scheduling.short_lists(df, spark.createDataFrame(nodes, NODE), 4)
    found = {}
    for r in sorted(out.collect(), key=lambda r: (r.kind, r.place)):
        found.setdefault(r.kind, []).append(r.idx)
    want = {}
    for kind, bits, trust, os_, _, memory, _, generation, local, home, a, b in kinds:
        ranked = []
        for i, name, own, pressure, health, identity, integrity, t, o, _, m, _, has_a, has_b, gens in nodes:
            if own & bits == bits and health == "healthy" and identity == "active" and integrity and t >= trust and os_ in (None, o) and m >= memory and (generation is None or generation in gens) and (not local or i == home):
                here = (a is not None and a == has_a) + (b is not None and b == has_b)
                ranked.append((pressure - 5 * here * (not local), name, i))
        if ranked:
            want[kind] = [i for _, _, i in sorted(ranked)[:4]]
    assert found == want and sum(len(v) for v in want.values()) > 250


def test_sessions_and_levels_add_nothing_to_what_is_looked_at(spark, monkeypatch):
    from fleetlens.functions.views import view
    from fleetlens.plans.scheduling import predictions

    seen, real = [], scheduling.candidates
    monkeypatch.setattr(scheduling, "candidates", lambda asked, *rest: seen.append(asked.count()) or real(asked, *rest))
    requests, nodes, variants, observations = (view(spark, "/root/testdata/sf0.001", v) for v in ("sched_each", "sched_nodes", "sched_variants", "observations"))
    others = requests.withColumns({"task_id": F.col("task_id") + 10**9, "session_idx": F.col("task_id") % 7, "deadline": F.col("deadline") - F.col("task_id") % 5, "migration": F.lit(0.5)})
    few = scheduling.place(requests, nodes, variants, predictions(observations))
    many = scheduling.place(requests.unionByName(others), nodes, variants, predictions(observations))
    assert seen[0] == seen[1] and many.count() == 2 * few.count()
    assert sorted(map(str, few.collect())) == sorted(map(str, many.where("task_id < 1000000000").collect()))


def test_rare_bits_on_both_ends_of_a_word(spark):
    nodes = spark.createDataFrame([(i, (1 if i < 5 else 0) | (-(1 << 63) if i == 0 else 0) | (1 << 40 if i in (1, 2) else 0)) for i in range(6)], "idx long, bits long")
    rare = scheduling.rare_bits(nodes)
    assert rare & ((1 << 64) - 1) == (1 << 63) | (1 << 40)
    needs = spark.createDataFrame([(0,), (1 << 40,), (-(1 << 63),)], "required_bits long")
    found = {(r.required_bits, r.idx): r.scarcity for r in scheduling.scarcity(needs, nodes).collect()}
    assert found == {(0, 0): 25.0, (0, 1): 25.0, (0, 2): 25.0, (0, 3): 0.0, (0, 4): 0.0, (0, 5): 0.0, (1 << 40, 1): 0.0, (1 << 40, 2): 0.0, (-(1 << 63), 0): 0.0}


@pytest.mark.parametrize("field", scheduling.FINITE)
def test_every_number_of_a_request_must_be_finite(spark, field):
    good = {c: 1.0 for c in scheduling.FINITE}
    rows = [{**good, field: v} for v in (1.0, float("nan"), float("inf"), float("-inf"), None, -1.0)]
    df = spark.createDataFrame([tuple(r[c] for c in scheduling.FINITE) for r in rows], ", ".join(f"{c} double" for c in scheduling.FINITE))
    assert [r[0] for r in df.select(scheduling.finite_request()).collect()] == [True, False, False, False, False, field not in scheduling.NOT_NEGATIVE]


@pytest.mark.parametrize("change,meets", [
    ({}, True), ({"total": 11.0}, False), ({"p95": 11.0}, False), ({"p99": 11.0}, False), ({"jitter": 11.0}, False), ({"failure": 0.6}, False), ({"total": 10.0, "failure": 0.5}, True),
    ({"streaming": True}, True), ({"streaming": True, "ttft": 6.0}, False), ({"streaming": True, "ttft": None}, False), ({"streaming": True, "ttft": None, "max_ttft": None}, True),
    ({"streaming": True, "steady": 6.0, "max_steady": None}, True), ({"streaming": True, "steady": 6.0}, False), ({"streaming": False, "steady": 6.0, "ttft": None}, True),
])
def test_service_levels_of_a_request(spark, change, meets):
    row = dict(total=1.0, deadline=10.0, p95=1.0, max_p95=10.0, p99=1.0, max_p99=10.0, jitter=1.0, max_jitter=10.0, failure=0.1, max_failure=0.5, streaming=False, ttft=1.0, max_ttft=5.0, steady=1.0, max_steady=5.0) | change
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'boolean' if k == 'streaming' else 'double'}" for k in row))
    assert df.select(scheduling.meets_levels()).first()[0] is meets
