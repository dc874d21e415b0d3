"""Joins in time, the event page source and stored upserts against plain Python and over restarts."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.views import view
from fleetlens.operators import registry, temporal
from fleetlens.sources import event_pages
from fleetlens.streaming.upserts import StoredSnapshots

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("rows_a_task", [1_000_000, 20])
def test_intervals_hold_moments_with_both_ends(spark, rows_a_task):
    rng = random.Random(rows_a_task)
    most = (1 << 63) - 1
    node = lambda: rng.choice(["hot"] * 5 + ["a", "b", None])
    moments = [(i, node(), rng.choice([rng.randrange(-50, 300), None, 0, most])) for i in range(400)] + [(7, "hot", 5)] * 3
    spans = [(i, node(), s, s + rng.choice([-1, 0, 1, 3, 17, 200, 5000])) for i, s in enumerate(rng.randrange(-80, 280) for _ in range(120))]
    spans += [(200, "a", -most, most), (201, "hot", 0, most), (202, "hot", None, 4), (203, "hot", 4, None), (204, "a", most, most)]
    left = spark.createDataFrame(moments, "id long, node string, tick long").withColumns({"level": F.lit("x"), "salt": F.lit("y")})
    right = spark.createDataFrame(spans, "span long, node string, since long, until long").withColumn("bin", F.lit(3))
    out = temporal.interval_join(left, right, ["node"], "tick", "since", "until", rows_a_task)
    want = sorted((i, s) for i, n, t in moments for s, m, a, b in spans if None not in (n, t, a, b) and n == m and a <= t <= b)
    assert sorted((r.id, r.span) for r in out.collect()) == want
    assert {r.level for r in out.collect()} == {"x"} and not any(j in plan_of(out) for j in ("NestedLoop", "CartesianProduct"))
    assert temporal.interval_join(left, right.limit(0), ["node"], "tick", "since", "until").count() == temporal.interval_join(left.limit(0), right, ["node"], "tick", "since", "until").count() == 0


def test_a_heavy_key_is_dealt_over_tasks_and_long_spans_are_not_copied(spark):
    moments = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("node"), (F.col("id") % 1000).alias("tick"))
    heavy = {r.node: r.parts for r in temporal.heavy_keys(moments, ["node"], 1000, "parts").collect()}
    assert heavy == {-1: 20}
    assert temporal.heavy_keys(spark.range(50_000).select((F.col("id") / 2).cast("long").alias("node")), ["node"], 1, "parts").count() == 0  # the limit grows with the rows
    spans = spark.createDataFrame([(-1, 0, 1 << 40)], "node long, since long, until long")
    assert temporal.interval_join(moments, spans, ["node"], "tick", "since", "until", 1000).count() == 20_000


@pytest.mark.parametrize("block", [1_000_000, 15])
@pytest.mark.parametrize("inclusive", [True, False])
def test_the_last_entry_before_each_row(spark, block, inclusive):
    rng = random.Random(block + inclusive)
    key = lambda: rng.choice([1, 1, 1, 1, 2, 3, None])
    rows = [(i, key(), rng.choice([*range(100), None])) for i in range(300)] + [(9, 1, 50)] * 2
    log = [(key(), rng.choice([*range(100), None]), e, rng.choice(["p", None])) for e in range(60)] + [(1, 200, 99, "later")]
    left = spark.createDataFrame(rows, "id long, task long, tick long").withColumn("held", F.lit("own"))
    right = spark.createDataFrame(log, "task long, tick long, entry long, said string")
    out = temporal.last_before(left, right, ["task"], "tick", ["entry", "said"], ["entry"], inclusive, block)
    want = []
    for i, k, t in rows:
        fits = [(at, e, s) for n, at, e, s in log if n == k and None not in (at, t) and (at <= t if inclusive else at < t)]
        want.append((i, k, t, "own", *(max(fits, key=lambda x: x[:2])[1:] if fits else (None, None))))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert temporal.last_before(left, right.limit(0), ["task"], "tick", ["entry"], ["entry"]).where("entry is null").count() == len(rows)
    assert temporal.last_before(left.limit(0), right, ["task"], "tick", ["entry"], ["entry"]).count() == 0


def events(spark, tmp_path, *ranges):
    for a, b in ranges:
        spark.range(a, b).select(F.col("id").alias("event_id"), F.concat(F.lit("e"), "id").alias("kind")).orderBy(F.desc("event_id")).coalesce(2).write.mode("append").parquet(f"{tmp_path}/log")
    return f"{tmp_path}/log"


def test_event_pages_read_ranges_and_take_filters(spark, tmp_path):
    event_pages.register(spark)
    path = events(spark, tmp_path, (0, 500), (500, 1200))
    read = spark.read.format("event_pages").option("sequence", "event_id").option("rowsAPartition", 100).load(path)
    assert sorted(r.event_id for r in read.collect()) == list(range(1200)) and read.rdd.getNumPartitions() >= 12
    some = read.where("event_id > 100 and event_id <= 130 and kind <> 'e120'")
    assert sorted(r.event_id for r in some.collect()) == [i for i in range(101, 131) if i != 120]
    assert some.rdd.getNumPartitions() <= 8 and read.where("event_id = 7").count() == 1 and read.where("event_id >= 1200").count() == 0
    ordered = read.select("event_id", F.spark_partition_id().alias("p")).collect()
    by_part = {}
    for r in ordered:
        by_part.setdefault(r.p, []).append(r.event_id)
    assert all(v == sorted(v) for v in by_part.values())
    log = event_pages.Log({"path": path, "sequence": "event_id", "rowsAPartition": "1000"})
    assert [(p.after, p.upto) for p in log.ranges(100, 130)] == [(100, 130)] and log.ranges(5000, 6000) == [] and log.last() == 1199
    with pytest.raises(ValueError):
        event_pages.Log({"sequence": "event_id"})


def test_event_stream_gives_each_event_once_over_restarts(spark, tmp_path):
    event_pages.register(spark)

    def run():
        stream = spark.readStream.format("event_pages").option("sequence", "event_id").option("rowsAPartition", 50).load(f"{tmp_path}/log")
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        return sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect())

    events(spark, tmp_path, (0, 200))
    assert run() == list(range(200))
    assert run() == list(range(200))
    events(spark, tmp_path, (200, 333), (333, 340))
    assert run() == list(range(340))


def test_upserts_of_a_stream_and_of_repeated_batches(spark, tmp_path):
    rows = view(spark, SF, "snapshots").select("event_id", "node", "ts", "capability_version", "resource_version", "valid").cache()
    for part in ("day(ts) <= 10", "day(ts) between 11 and 20", "day(ts) > 20"):
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = StoredSnapshots(spark, f"{tmp_path}/table", rows.schema, ["node"], ["ts", "event_id"], buckets=4)
    seen = []

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

        def take(batch, batch_id):
            seen.append(batch_id)
            table.merge(batch, batch_id)

        query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        return sorted(map(repr, table.read().collect()))

    want = sorted(map(repr, registry.current_snapshots(rows, ["node"], ["ts", "event_id"], rows.schema).collect()))
    assert run() == want == run() and seen == [0, 1, 2]
    table.merge(rows.where("day(ts) <= 10"), 1)  # a batch that Spark gives again
    assert sorted(map(repr, table.read().collect())) == want
    files = table.clean()
    assert sorted(map(repr, table.read().collect())) == want and set(files) <= {"batch=0", "batch=1"}
    # A batch that failed before its commit left files behind: they are not read, and the next attempt writes over them.
    newer = rows.limit(1).withColumns({"capability_version": F.lit(10**6), "resource_version": F.lit(10**6), "valid": F.lit(True)})
    newer.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{tmp_path}/table/data/batch=3")
    assert sorted(map(repr, table.read().collect())) == want
    table.merge(newer, 3)
    assert table.read().where("capability_version = 1000000").count() == 1 and table.read().count() == len(want)
    empty = StoredSnapshots(spark, f"{tmp_path}/none", rows.schema, ["node"], ["ts"])
    assert empty.read().count() == 0 and empty.clean() == []
