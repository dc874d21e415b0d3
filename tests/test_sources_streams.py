"""Round trips of log segments, and streams whose final state is the batch result."""

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.views import view
from fleetlens.operators import ha, registry, state
from fleetlens.sources import wal
from fleetlens.streaming import folds, pulses

SF = "/root/testdata/sf0.001"


def entries(first, count):
    return b"".join(wal.frame(wal.PREPARE, i, b"p%d" % i) + (wal.frame(wal.COMMIT, i, b"t") if i % 3 else b"") for i in range(first, first + count))


def test_frames_round_trip_and_short_tail(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"segment-{k}.log").write_bytes(entries(10 * k, 10) + wal.frame(wal.PREPARE, 99, b"cut")[: 7 * k])
    (tmp_path / "empty.log").write_bytes(b"")
    read = wal.read_frames(spark, str(tmp_path), rows_a_batch=4)
    assert read.where("kind = 1").count() == 30
    got = {r.log_index: bytes(r.payload) for r in wal.committed(read).collect()}
    assert got == {i: b"p%d" % i for i in range(30) if i % 3}


def test_corrupt_frame_names_its_offset():
    good = wal.frame(wal.PREPARE, 1, b"abc")
    for at in range(4, len(good)):
        bad = bytearray(good + good)
        bad[len(good) + at] ^= 1
        found = wal.frames(bytes(bad))
        assert next(found)[2:] == (1, b"abc")
        with pytest.raises(wal.CorruptFrame) as e:
            next(found)
        assert e.value.offset == len(good)


@pytest.mark.parametrize("form", [pulses.tick_counters, pulses.silences])
def test_stream_ends_as_batch(spark, tmp_path, form):
    rows = view(spark, SF, "pulses")
    # Files arrive in the order of time, as rows behind the watermark are dropped.
    for third in ("day(ts) <= 10", "day(ts) between 11 and 20", "day(ts) > 20"):
        rows.where(third).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = form(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    name = f"final_{form.__name__}"
    running = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    running.awaitTermination(120)
    assert running.exception() is None
    assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, form(rows).collect()))


def arrive(tmp_path, *parts):
    """Parts as files, one for each micro-batch."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return f"{tmp_path}/in"


def run_stream(spark, make, schema, tmp_path, name):
    """All that is there, from where the checkpoint stands; rows land in files, each once."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = make(stream).writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start()
    assert query.awaitTermination(240) and query.exception() is None
    return sorted(map(repr, spark.read.parquet(f"{tmp_path}/{name}").collect()))


def test_members_over_a_stream_that_restarts(spark, tmp_path):
    """The detector and the timeline of a stream that stops and starts again; who is never heard again turns suspect, then dead."""
    beats = view(spark, SF, "beats").where("node % 3 = 0").select("node", "event_id", "op", "capability_version", "resource_version", "health", "pressure", F.col("tick").cast("long").alias("tick")).cache()
    end = beats.agg(F.max("tick")).first()[0] + 100
    clock = spark.createDataFrame([(-1, -1, "register", 1, 1, "healthy", 0, end)], beats.schema)
    cuts = beats.approxQuantile("tick", [0.3, 0.6], 0.0)
    everything = beats.union(clock)
    arrive(tmp_path, beats.where(F.col("tick") <= cuts[0]), beats.where((F.col("tick") > cuts[0]) & (F.col("tick") <= cuts[1])))
    for make, name in ((folds.detect, "detected"), (folds.timeline, "timeline")):
        run_stream(spark, make, beats.schema, tmp_path, name)
    arrive(tmp_path, beats.where(F.col("tick") > cuts[1]), clock)
    found = {name: run_stream(spark, make, beats.schema, tmp_path, name) for make, name in ((folds.detect, "detected"), (folds.timeline, "timeline"))}
    assert found["detected"] == sorted(map(repr, ha.detect(everything, ["node"], ["tick", "event_id"]).collect()))
    lines = ha.timeline(everything, ["node"], ["tick", "event_id"], end).collect()
    assert found["timeline"] == sorted(map(repr, lines))
    last = {r.node: r.health for r in sorted(lines, key=lambda r: r.tick)}
    assert last.pop(-1) == "healthy" and set(last.values()) == {"dead"}


def test_tasks_over_a_stream_keep_typed_states(spark, tmp_path):
    commands = view(spark, SF, "commands").where("task_id % 7 = 0").select("event_id", "task_id", F.col("pos").cast("long").alias("pos"), "fast", "mutation", F.col("attempt").cast("long").alias("attempt"), "node", "content").cache()
    arrive(tmp_path, commands.where("pos < 3"), commands.where("pos between 3 and 6"), commands.where("pos > 6"))
    assert run_stream(spark, folds.task_registry, commands.schema, tmp_path, "tasks") == sorted(map(repr, registry.task_registry(commands).collect()))


def test_a_silence_is_ended_by_matching_versions_only():
    detector, s = ha.Detector(), ha.unseen()
    step = ha.changes(["node"], detector)
    row = lambda tick, op="pulse", c=1, r=1, health="healthy": dict(node="n", tick=tick, op=op, capability_version=c, resource_version=r, health=health, pressure=0)
    assert step(s, row(0)) == [] and step(s, row(1, "register", 0)) == []
    assert step(s, row(2, "register")) == [("n", 2, "healthy", "registered")]
    assert step(s, row(5, r=2)) == [("n", 5, "incompatible", "full_snapshot_required")]
    assert step(s, row(12, c=2)) == [("n", 10, "suspect", "silence"), ("n", 12, "incompatible", "full_snapshot_required")]
    assert ha.lapses(s, 40, detector) == [(13, "suspect"), (22, "dead")]
    assert step(s, row(41)) == [("n", 41, "healthy", "accepted")] and s["tick"] == 41


def test_budgets_of_ticks_start_anew(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") / 25).cast("long").alias("tick"), (F.col("id") % 9 * 1.0).alias("cost"), "id").cache()
    arrive(tmp_path, rows.where("tick < 5"), rows.where("tick between 5 and 8"), rows.where("tick > 8"), spark.createDataFrame([(50, 1.0, 999)], rows.schema))
    found = run_stream(spark, lambda s: folds.tick_budgets(s, "tick", "cost", ["id"], 40.0), rows.schema, tmp_path, "budgets")
    want = state.tick_budget(rows.withColumn("at", F.timestamp_seconds("tick")), F.col("at"), "cost", ["id"], 40.0).select(F.unix_timestamp(F.col("tick").cast("timestamp")).alias("tick"), "offered", "used")
    assert found == sorted(map(repr, want.collect()))
