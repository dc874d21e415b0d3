"""Numbering, folds and trees that deal one key over tasks, against plain Python; percentiles with odd values."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import aggregates, merkle, places, state
from fleetlens.operators.folds import fold


@pytest.mark.parametrize("block", [1_000_000, 7])
def test_places_of_hot_small_and_null_keys(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([rng.randrange(-40, 40), 10**6]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, at long, id long").withColumn("block", F.lit("own"))
    found = {r.id: (r.place, r.total, r.block) for r in places.places(df, ["key"], ["at", "id"], block).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        own = sorted((at, i) for k, at, i in rows if k == key)
        want |= {i: (n, len(own), "own") for n, (_, i) in enumerate(own)}
    assert found == want
    assert [r.place for r in places.places(df, [], ["at", "id"], block).orderBy("at", "id").collect()] == list(range(300))
    assert places.places(df.limit(0), ["key"], ["at"], block).count() == 0


def plain_run(machine, rows):
    at, out = machine.start, []
    for r in rows:
        before, at = at, int(machine.step(np.array([at]), r)[0])
        out.append(machine.emit(before, at, r))
    return [x for x in out if x is not None]


@pytest.mark.parametrize("block", [1_000_000, 11])
def test_block_folds_of_a_machine_that_never_forgets(spark, block):
    machine = places.Machine(13, 4, lambda s, r: (s * 5 + r["x"]) % 13, lambda before, after, r: (r["key"], r["at"], before, after) if r["x"] % 3 else None)
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.randrange(50)) for i in range(400)]
    df = spark.createDataFrame(rows, "key long, at long, x long").repartition(3)
    out = places.block_fold(df, ["key"], ["at"], machine, "key long, at long, before int, after int", block)
    want = [x for k in (1, 2, None) for x in plain_run(machine, [dict(key=a, at=b, x=c) for a, b, c in rows if a == k])]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    everything = places.block_fold(df, [], ["at"], machine, "key long, at long, before int, after int", block)
    assert sorted(map(repr, map(tuple, everything.collect()))) == sorted(map(repr, plain_run(machine, [dict(key=a, at=b, x=c) for a, b, c in rows])))


def test_one_hot_key_over_eight_tasks_as_in_one(spark):
    """The moving average of one busy node."""
    pulses = spark.range(120_000).select(F.lit(7).cast("long").alias("node"), F.col("id").alias("tick"), (F.col("id") * 7919 % 101).cast("long").alias("p"))
    machine = state.pressure_machine(lambda before, after, r: (r["tick"], after))
    alone = fold(pulses, ["node"], ["tick"], lambda: {"at": 0}, lambda s, r: places._advance(machine, s, r), "tick long, after long")
    dealt = places.block_fold(pulses, ["node"], ["tick"], machine, "tick long, after long", 15_000)
    assert dealt.exceptAll(alone).count() == 0 == alone.exceptAll(dealt).count()
    blocks = pulses.groupBy(places.block_of(pulses, ["node"], "tick", 15_000).alias("b")).count().collect()
    assert len(blocks) == 8 and max(r["count"] for r in blocks) == 15_000
    last = state.integer_pressure(pulses, "node", ["tick"], "p", 15_000).collect()
    assert last == state.integer_pressure(pulses, "node", ["tick"], "p").collect() and len(last) == 1


def plain_tree(leaves):
    """All levels, from the leaves up."""
    out = [leaves]
    while len(out[-1]) > 1:
        below = out[-1]
        out.append([hashlib.sha256(f"{below[i]}:{below[min(i + 1, len(below) - 1)]}".encode()).hexdigest() for i in range(0, len(below), 2)])
    return out


def test_trees_of_all_small_sizes(spark):
    sizes = [*range(1, 40), 255, 256, 257, 511, 513, 600]
    rows = spark.createDataFrame([(n, i) for n in sizes for i in range(n)], "n long, i long")
    leaf = F.sha2(F.concat_ws("/", "n", "i"), 256)
    trees = {n: plain_tree([hashlib.sha256(f"{n}/{i}".encode()).hexdigest() for i in range(n)]) for n in sizes}
    assert {r.segment: (r.leaves, r.root) for r in merkle.roots(rows, F.col("n"), "i", leaf).collect()} == {n: (n, t[-1][0]) for n, t in trees.items()}
    proofs = merkle.inclusion_proofs(rows, F.col("n"), "i", leaf).collect()
    assert len(proofs) == sum(sizes)
    for r in proofs:
        levels, want, i = trees[r.segment], [], r.leaf_index
        for level in levels[:-1]:
            other = min(i + 1, len(level) - 1) if i % 2 == 0 else i - 1
            want.append((level[other], other < i))
            i //= 2
        assert [tuple(s) for s in r.siblings] == want and (r.leaf, r.root) == (levels[0][r.leaf_index], levels[-1][0])


def test_a_segment_of_a_hundred_thousand_and_one_leaves(spark):
    rows = spark.range(100_001).select(F.lit("s").alias("s"), (F.col("id") * 3).alias("o"))
    leaf = F.sha2(F.col("o").cast("string"), 256)
    root = plain_tree([hashlib.sha256(str(3 * i).encode()).hexdigest() for i in range(100_001)])[-1][0]
    assert merkle.roots(rows, F.col("s"), "o", leaf, rows_a_block=10_000).collect() == [("s", 100_001, root)]
    proofs = merkle.inclusion_proofs(rows, F.col("s"), "o", leaf, rows_a_block=10_000)
    seen = proofs.agg(F.count("*"), F.bool_and(merkle.proves(F.col("leaf"), F.col("siblings"), F.col("root"))), F.min(F.size("siblings")), F.max(F.size("siblings")), F.min("root"), F.max("root")).first()
    assert tuple(seen) == (100_001, True, 17, 17, root, root)
    assert merkle.roots(rows.limit(0), F.col("s"), "o", leaf).count() == 0


@pytest.mark.parametrize("leaves", [200, 3_000])
def test_proofs_are_spelt_out_after_the_last_shuffle(spark, leaves):
    rows = spark.range(leaves).select((F.col("id") % 2).alias("s"), "id")
    proofs = merkle.inclusion_proofs(rows, F.col("s"), "id", F.sha2(F.col("id").cast("string"), 256))
    plan = proofs._jdf.queryExecution().executedPlan().toString()
    made = plan.index("Generate")
    assert "Exchange" in plan and "Exchange" not in plan[:made] and "Join" not in plan[:made]


def test_percentiles_with_infinities_and_not_a_number(spark):
    nan, inf = float("nan"), float("inf")
    sets = {"a": [1.0, 2.0, 5.0, nan], "b": [inf, -inf, 3.0, 0.0, -0.5], "c": [inf] * 3 + [1.0], "d": [nan], "e": [-inf, -1e308, -1e-320, 0.0, 5e-324, 1e308], "f": [nan, nan, inf]}
    rows = spark.createDataFrame([(k, v) for k, vs in sets.items() for v in vs] + [("a", None)], "k string, v double")
    order = lambda v: (v != v, v if v == v else 0)  # noqa: E731  NaN last
    same = lambda a, b: a == b or (a != a and b != b)
    for percent in (0, 25, 50, 95, 100):
        for r in aggregates.indexed_percentile(rows, ["k"], "v", percent).collect():
            ranked = sorted(sets[r.k], key=order)
            assert r.n == len(ranked) and same(r[f"i{percent}"], ranked[(len(ranked) - 1) * percent // 100]), (r, percent)
    for r in aggregates.distribution(rows.where("k in ('b', 'e')"), ["k"], "v").collect():
        ranked = sorted(sets[r.k])
        assert (r.least, r.most, r.p95) == (ranked[0], ranked[-1], ranked[math.ceil(len(ranked) * 0.95) - 1])


def test_reputations_by_vectors_are_those_row_by_row(spark, monkeypatch):
    from fleetlens.operators import trust

    monkeypatch.setattr(trust, "AVERAGE_ROWS", 7)
    rng = random.Random(11)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice("ab"), i, rng.choice([0.5, 1.0, 5.0, None, float("nan"), -1.0, math.inf]), *(rng.random() < 0.3 for _ in range(3)), rng.random() < 0.15, *(rng.choice([False] * 30 + [True]) for _ in range(3))) for i in range(500)] + [(3, "a", 0, None, *[True] * 7)]
    df = spark.createDataFrame(rows, "node long, capability string, seq long, latency_ratio double, succeeded boolean, timed_out boolean, mismatch boolean, corruption boolean, forged boolean, cancel_refused boolean, unauthorised boolean").repartition(3)
    want = {}
    for key in {r[:2] for r in rows}:
        n, seen, average = 0, set(), dict(zip(trust.AVERAGED, trust.AVERAGED.values()))
        for r in sorted((r for r in rows if r[:2] == key), key=lambda r: r[2]):
            if r[3] is None or not 0 <= r[3] < math.inf:
                continue
            n += 1
            average = {f: 0.95 * average[f] + 0.05 * v for f, v in zip(average, r[4:8])}
            if n >= 20:
                seen |= {name for name, v in zip(trust.AT_ONCE.values(), r[8:]) if v} | ({"abnormal_latency"} if r[3] >= 4 else set())
                seen |= {name for f, name in (("mismatch", "result_mismatch"), ("corruption", "resource_corruption")) if average[f] >= 0.2}
        if n:
            want[key] = (n, *average.values(), max(20 - n, 0) / 20, ",".join(sorted(seen)))
    found = {(r.node, r.capability): tuple(r)[2:] for r in trust.reputations(df, ["node", "capability"], ["seq"], 20).collect()}
    assert found.keys() == want.keys()
    for key, r in found.items():
        assert r[0] == want[key][0] and r[5:] == want[key][5:] and r[1:5] == pytest.approx(want[key][1:5], rel=1e-12)


def test_tasks_of_windows_do_not_grow_with_their_rows(spark, monkeypatch):
    from fleetlens.functions.views import VIEWS, view
    from fleetlens.plans.trusted import audit_trace

    most = lambda df: df.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]
    plain = sorted(map(tuple, audit_trace(view(spark, "/root/testdata/sf0.01", "attempts")).collect()))
    monkeypatch.setattr(places, "ROWS_A_TASK", 3_000, raising=False)
    traced = audit_trace(view(spark, "/root/testdata/sf0.01", "attempts"))
    assert len(plain) == 60_000 and most(traced) < 6_000 and sorted(map(tuple, traced.collect())) == plain
    assert sum("PARTITION BY" in body for _, body in VIEWS.values()) == 10
    for name in ("attempts", "reputation_events"):
        assert most(view(spark, "/root/testdata/sf0.01", name)) < 9_000


@pytest.mark.parametrize("name", ["inclusion_proof", "merkle_root", "audit_trace"])
def test_a_session_of_many_partitions_keeps_tasks_small_too(spark, monkeypatch, name):
    """Its partitions compress well, so that they are merged into a few tasks."""
    import __spark_entry__ as entry

    run = lambda: entry.queries()[name](spark, "/root/testdata/sf0.01")
    rows = lambda df: sorted(map(tuple, df.select(*[F.col(c).cast("string") for c in df.columns]).collect()))
    plain = rows(run())
    monkeypatch.setattr(places, "ROWS_A_TASK", 1_000)
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        dealt = run()
        if name != "merkle_root":
            assert dealt.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0] < 5_000
        assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString() and rows(dealt) == plain
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
