"""corpus_pipeline over a small corpus: each stage against plain Python, and whole runs beside each other."""

import collections
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from fleetlens.llm import quality, toxicity
from tests.llm.test_brute_force import plain_targets
from tests.llm.test_operators import closure, prose


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(21)
    folder = tmp_path_factory.mktemp("corpus")
    rows = [(i, " ".join([prose(rng, rng.randrange(60, 200)), *(["nitwit dunce"] if i % 8 == 0 else []), prose(rng, 30)]), "en", f"s{i % 4}") for i in range(240)]
    near = rows[5][1].split()
    near[20] = "changed"
    rows += [(300 + k, rows[5][1], "en", "s1") for k in range(30)] + [(400, " ".join(near), "en", None), (401, None, "en", "s1"), (402, "", None, None), (403, "too short", "en", "s1"), (404, "again " * 200, "en", "s2"), (None, rows[9][1], "en", "s2"), (6, rows[6][1], "en", "s2")]
    spark.createDataFrame([(*r, len(r[1] or ""), f"c{r[0]}") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(3).write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def as_rows(df):
    return collections.Counter(map(tuple, df.collect()))


def test_stages_by_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    of = dict(corpus_pipeline.STAGES)
    assert list(of) == ["quality", "toxicity", "near_duplicates", "mixing", "packing"]
    kept = of["quality"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    # All passing texts are alike here, so the base rule alone decides.
    passes = lambda t: len(words(t)) >= 50 and t != "again " * 200
    assert as_rows(kept) == collections.Counter({r: n for r, n in as_rows(docs).items() if passes(r[1])})

    clean = of["toxicity"](spark, kept, sf_dir)
    assert as_rows(clean) == collections.Counter({r: n for r, n in as_rows(kept).items() if "nitwit" not in r[1]})

    single = of["near_duplicates"](spark, clean, sf_dir)
    texts = [r for r in clean.collect()]
    groups = collections.defaultdict(list)
    for i, root in closure([r.text for r in texts], 5).items():
        groups[root].append(texts[i])
    left = as_rows(single)
    assert sum(left.values()) == len(groups) and single.columns == docs.columns
    for members in groups.values():
        ids = [r.doc_id for r in members if r.doc_id is not None]
        assert sum(left[tuple(r)] > 0 for r in members if r.doc_id == (min(ids) if ids else None)) >= 1

    mixed = of["mixing"](spark, single, sf_dir)
    sizes = collections.Counter()
    for r in single.collect():
        sizes[r.source] += len(words(r.text))
    taken = collections.Counter()
    for r in mixed.collect():
        taken[r.source] += len(words(r.text))
    longest = max(len(words(r.text)) for r in single.collect())
    for source, target in plain_targets(sizes).items():
        assert abs(taken[source] - target) <= longest / 2
    assert set(as_rows(mixed)) <= set(as_rows(single)) and max(as_rows(mixed).values()) <= 2 and mixed.columns == docs.columns

    pieces = of["packing"](spark, mixed, sf_dir).collect()
    assert sorted(r.doc_id for r in pieces if r.piece == 0) == sorted(r.doc_id for r in mixed.collect())
    ends = collections.Counter()
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 1024 and len(ends) <= np.ceil(1.01 * sum(ends.values()) / 1024) + 1


def test_two_runs_are_read_in_either_order_and_agree(spark, sf_dir, monkeypatch):
    """What a run writes and removes is its own: shown by the stages that take least time."""
    monkeypatch.setattr(corpus_pipeline, "STAGES", [x for x in corpus_pipeline.STAGES if x[0] in ("quality", "mixing", "packing")])
    one, two = corpus_pipeline.run(spark, sf_dir), corpus_pipeline.run(spark, sf_dir)
    pick = lambda df: as_rows(df.select("doc_id", "piece", "start", "length", "ids_crc32"))
    second, first = pick(two), pick(one)
    assert first == second and sum(first.values()) > 200


@pytest.mark.parametrize("rows", [0, 3])
def test_stages_bear_empty_and_null_tables(spark, sf_dir, rows):
    """No rows, and rows of nulls alone: quality rejects those, and the later stages take what is left of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bare = spark.createDataFrame([(None,) * len(docs.columns)] * rows, docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, bare, sf_dir)
        assert out.count() == {"quality": 0, "mixing": 0}.get(name, rows), name


def test_folders_are_recorded_by_block_and_thread(spark):
    import threading

    from fleetlens.llm.common import recorded, written

    with recorded() as outer:
        with recorded() as inner:
            assert outer == inner == []
        other: list = []

        def elsewhere():
            with recorded() as own:
                written(spark.range(1), "other")
                other.extend(own)

        thread = threading.Thread(target=elsewhere)
        thread.start()
        thread.join()
        with recorded() as second:
            written(spark.range(1), "both")
        written(spark.range(1), "outer")
    assert len(outer) == 2 and outer[:1] == second and inner == [] and len(other) == 1 and other[0] not in outer
