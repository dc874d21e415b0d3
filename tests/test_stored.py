"""Bitmap indexes, Bloom filters, contents in order and stored profiles against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.views import view
from fleetlens.operators import bitmaps, placement, profiles
from fleetlens.sources import files

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_candidates_by_bitmaps_of_128_bits(spark):
    rng = random.Random(7)
    pool = [0, 5, 62, 63, 64, 65, 90, 127]
    nodes = [(i * 3 - 50, sum(1 << b for b in rng.sample(pool, rng.randrange(0, 8)))) for i in range(300)]
    needs = [sum(1 << b for b in rng.sample(pool, k)) for k in (0, 0, 1, 1, 1, 2, 2, 3, 4, 8)] + [1 << 33]
    low = (1 << 64) - 1
    df = spark.createDataFrame([(i, signed(b & low), signed(b >> 64)) for i, b in nodes] + [(9999, None, None)], "idx long, lo long, hi long")
    asked = spark.createDataFrame([(signed(n & low), signed(n >> 64)) for n in needs] + [(None, None)], "need_lo long, need_hi long")
    found = sorted((r.need_lo, r.need_hi, r.idx) for r in bitmaps.candidates(asked, df, "idx").collect())
    everyone = [*nodes, (9999, 0)]
    assert found == sorted((signed(n & low), signed(n >> 64), i) for n in set(needs) for i, b in everyone if b & n == n)
    assert {r.bit: r.nodes for r in bitmaps.supply(df).collect()} == {b: sum(x >> b & 1 for _, x in nodes) for b in pool}
    both = df.select(bitmaps.set_bits(F.col("lo"), F.col("hi")).alias("b"), "idx").collect()
    assert {r.idx: list(r.b) for r in both} == {i: [k for k in range(128) if b >> k & 1] for i, b in everyone}
    owned = df.where(bitmaps.owns(F.col("lo"), F.col("hi"), F.lit(signed((1 << 63) | 1)), F.lit(1))).count()
    assert owned == sum(b & ((1 << 64) | (1 << 63) | 1) == (1 << 64) | (1 << 63) | 1 for _, b in nodes)
    assert bitmaps.candidates(asked, df.limit(0), "idx").count() == 0 == bitmaps.candidates(asked.limit(0), df, "idx").count()


def test_bloom_filters_lose_nothing_merge_and_keep_most_away(spark):
    stored = spark.range(4000).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    asked = spark.range(2000, 22_000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("digest")).unionByName(spark.createDataFrame([(-1, None)], "id long, digest string"))
    judged = bitmaps.with_maybe(asked, "digest", stored)
    assert judged.count() == 20_001 and judged.where("id between 2000 and 3999 and not maybe").count() == 0
    assert judged.where("maybe").count() < 2000 + 0.15 * 18_000 and judged.where("id = -1 and maybe").count() == 0
    assert "BroadcastHashJoin" in judged._jdf.queryExecution().toString()
    whole = {r.place: r.word for r in bitmaps.bloom_words(stored, "digest", 512).collect()}
    halves = [bitmaps.bloom_words(stored.where(F.crc32("digest") % 2 == k), "digest", 512) for k in (0, 1)]
    assert {r.place: r.w for r in halves[0].unionByName(halves[1]).groupBy("place").agg(F.bit_or("word").alias("w")).collect()} == whole
    assert bitmaps.with_maybe(asked, "digest", stored.limit(0)).where("maybe").count() == 0


@pytest.mark.parametrize("words", [1 << 20, 0])
def test_missing_bytes_count_repeats_nulls_and_documents_that_miss_nothing(spark, monkeypatch, words):
    monkeypatch.setattr(bitmaps, "MOST_WORDS", words)  # without room for a filter everything is checked exactly
    rng = random.Random(4)
    chunks = [(rng.choice([1, 2, 3, None]), rng.choice(["a", "b", "c", "d", None]), rng.randrange(9)) for _ in range(60)] + [(7, "a", 5)]
    held = spark.createDataFrame([("a",), ("c",), ("c",), ("z",)], "digest string")
    df = spark.createDataFrame(chunks, "doc_id long, digest string, size long")
    want = {d: sum(s for e, g, s in chunks if e == d and g not in ("a", "c")) for d, _, _ in chunks}
    assert {r.doc_id: r.missing for r in bitmaps.missing(df, held).collect()} == want


def test_contents_of_files_whole_missing_and_corrupt(spark, tmp_path):
    (tmp_path / "chunks").mkdir()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    parts = [bytes([i]) * (1000 * i + 1) for i in range(12)]
    for p in parts:
        (tmp_path / "chunks" / sha(p)).write_bytes(p)
    bad = b"changed"
    (tmp_path / "chunks" / sha(b"as it was")).write_bytes(bad)
    ids = [sha(p) for p in parts]
    rows = [
        (sha(b"".join(parts)), ids, "whole"), (sha(b"".join(reversed(parts))), ids[::-1], "whole"), (sha(parts[3] * 3), [ids[3]] * 3, "whole"),
        (sha(b"other order"), ids[:2], "corrupt"), (sha(b"gone"), [ids[0], "0" * 64], "missing"), (sha(b"x"), [ids[1], sha(b"as it was")], "corrupt"),
        (sha(b""), [], "whole"), (sha(b"not nothing"), [], "corrupt"), (sha(b"null"), None, "corrupt"),
    ]
    manifests = spark.createDataFrame([r[:2] for r in rows], "digest string, chunks array<string>")
    found = {r.digest: r.verdict for r in files.read_contents(spark, str(tmp_path / "chunks"), manifests).collect()}
    assert found == {d: v for d, _, v in rows}


def test_a_content_of_many_chunks_is_hashed_in_order_over_batches(spark):
    """Forty thousand chunks of one content, in any order: four Arrow batches at least, no row with them all."""
    parts = spark.range(40_000).select(F.lit("c").alias("key"), F.col("id").alias("place"), F.concat(F.lit("chunk "), F.col("id"), F.lit("\n")).alias("content")).orderBy(F.rand(3))
    want = hashlib.sha256(b"".join(b"chunk %d\n" % i for i in range(40_000))).hexdigest()
    assert files.content_verdicts(parts, ["key"], "place", "content").collect() == [("c", want)]
    lost = parts.withColumn("content", F.when(F.col("place") != 77, F.col("content")))
    assert files.content_verdicts(lost, ["key"], "place", "content").collect() == [("c", None)]


def test_profiles_of_days_merge_to_those_of_all_rows(spark, tmp_path):
    rows = view(spark, SF, "observations").cache()
    store = profiles.StoredProfiles(spark, str(tmp_path / "profiles"))
    store.write(rows.where("day(ts) % 3 = 0"))
    store.write(rows.where("day(ts) % 3 = 1 and latency_ticks < 100"))  # a part of these days, written anew below
    store.write(rows.where("day(ts) % 3 <> 0"))
    store.write(rows.where("day(ts) = 6"))
    want = {tuple(r[k] for k in placement.KEYS): r for r in placement.predictions(rows, 20).collect()}
    found = {tuple(r[k] for k in placement.KEYS): r for r in profiles.predictions(store.read(), 20).collect()}
    assert found.keys() == want.keys() and len(found) > 10
    for key, r in found.items():
        for c in ("samples", "p50", "p95", "p99", "failure", "ewma", "peak_memory_bytes", "throughput", "doubt"):
            assert r[c] == pytest.approx(want[key][c], rel=1e-9), (key, c)
    one = profiles.day_states(rows.limit(0))
    assert one.count() == 0 and profiles.predictions(one, 20).count() == 0
