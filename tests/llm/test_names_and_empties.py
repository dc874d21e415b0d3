"""All operators with other columns named as their inner ones, with no rows, and with nulls and repeats everywhere."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import license, mixing, multiindex, neardup, ngram, packing, quality, toxicity, urlfilter, warc
from tests.llm.test_operators import prose

ODD_NAMES = [
    "took", "u_part", "u_unit", "unit", "part", "_unit", "_part", "own", "list", "of", "whole", "p", "sid", "s_source", "h", "rep", "key", "_key", "sig", "root", "marks", "ns", "bucket", "salt", "_salt",
    "best", "token", "tokens", "regex", "rank", "rule_id", "rules", "tail", "known", "known_digest", "known_license", "lines", "raw", "fits", "found", "digest", "_raw", "_url", "_best",
    "symbols_most", "dup_most", "repeat_most", "length_most", "length_least", "f_lang", "f_source", "measure", "level", "total", "m", "c", "d", "v", "n", "block", "bin", "fill", "items", "elite", "island", "placed", "place", "at", "ids", "start_", "value", "values", "id", "vec", "cell", "payload", "first", "long", "y",
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(55, 140)), ["en", None][i % 2], f"s{i % 3}", f"http://a{i % 5}.org/es/{i % 3}") for i in range(40)]
    rows += [(i, t, "en", "s0", u) for i, t, u in [(50, rows[0][1], None), (51, None, "x"), (52, "", "http://example.org/es/?#"), (3, rows[3][1], rows[3][4]), (None, rows[4][1], None), (53, "Licensed under the MIT License.\n" * 3, "://")]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, url string").repartition(3).cache()


def score(df):
    return ngram.score_documents(df, ngram.train(df))


@functools.cache
def toxic_model():
    rng = random.Random(1)
    return toxicity.train([(i, (prose(rng, 20) + " nitwit" * (i % 2)).encode(), i % 2) for i in range(80)], toxicity.ToxicityTraining(windows=200, rounds=1))


def toxic(df):
    return toxicity.score_toxicity(df, toxic_model())


def packed(df):
    spare = [c for c in df.columns if c not in ("piece", "start", "length", "ids_crc32")]
    return packing.pack(packing.pieces(df, packing.public_paths(), keep=tuple(spare)))


PASS_THROUGH = {
    "pack": packed, "toxicity": toxic, "mix": mixing.mix, "near": neardup.near_duplicates, "quality": quality.judge, "lm": score,
    "url": lambda df: urlfilter.filter_urls(df, df.sparkSession.createDataFrame(urlfilter.production_rules(), urlfilter.RULE_SCHEMA)),
    "license": lambda df: license.scan(df, license.known_licenses(df.sparkSession)),
}


@pytest.mark.parametrize("name", list(PASS_THROUGH))
def test_clashing_names_change_nothing_and_no_rows_give_none(spark, docs, name):
    """Other columns, whatever their names, come back with their rows; the added ones are as without them."""
    operator = PASS_THROUGH[name]
    odd = docs.select(*docs.columns, *[F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(n) for n in ODD_NAMES])
    plain, out = operator(docs), operator(odd)
    added = [c for c in plain.columns if c not in docs.columns and c != "sequence_id" and c != "offset"]
    rows = lambda df: sorted(map(repr, df.select("doc_id", *added).collect()))
    assert rows(out) == rows(plain) and len(set(out.columns)) == len(out.columns)
    assert out.columns[: len(odd.columns)] == odd.columns
    assert out.where(" or ".join(f"`{n}` <> concat('{n}', coalesce(cast(doc_id as string), ''))" for n in ODD_NAMES)).count() == 0
    assert operator(odd.where("false")).count() == 0


def test_columns_named_as_added_ones_give_way(spark, docs):
    for name in ("pack", "toxicity", "quality", "url", "license"):
        operator = PASS_THROUGH[name]
        plain = operator(docs)
        added = [c for c in plain.columns if c not in docs.columns]
        odd = docs.select(*docs.columns, *[F.lit("old").alias(c) for c in added])
        out = operator(odd)
        assert sorted(out.columns) == sorted(plain.columns), name


def test_search_and_archives_take_tables_with_any_names(spark):
    odd = [F.lit(n).alias(n) for n in ODD_NAMES if n not in ("payload",)]
    vectors = spark.range(120).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos(F.col("id") * 7), F.lit(0.5)).alias("embedding"))
    plain, named = multiindex.search(vectors, lambda i: i % 50 == 0), multiindex.search(vectors.select("*", *odd), lambda i: i % 50 == 0)
    assert sorted(plain.collect()) == sorted(named.collect()) and plain.count() == 15 and multiindex.search(vectors.limit(0), lambda i: i % 50 == 0).count() == 0
    pages = spark.range(30).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.repeat(F.lit("z"), (F.col("id") % 3 * 90).cast("int")).alias("html"))
    pages = pages.unionByName(spark.createDataFrame([(99, None, None), (100, "u", "é" * 2_000_000)], "page_id long, url string, html string"))
    rows = lambda df: sorted(map(repr, warc.round_trip(df).drop("payload").collect()))
    assert rows(pages) == rows(pages.select("*", *odd)) and len(rows(pages)) == 32 and rows(pages.limit(0)) == []


def test_ties_and_very_long_texts(spark):
    rules = [(7, "late", "/a", [], 0, "block"), (2, "early", "/a", [], 0, "allow")]
    pages = spark.createDataFrame([(1, "http://h/a"), (2, "http://h/a" + "/x" * 100_000)], "page_id long, url string")
    out = urlfilter.filter_urls(pages, spark.createDataFrame(rules, urlfilter.RULE_SCHEMA), default="block").collect()
    assert {(r.pattern, r.verdict) for r in out} == {("early", "allow")}
    texts = [("B-1", "One notice here."), ("A-1", "one NOTICE, here")]
    docs = spark.createDataFrame([(1, "One notice here"), (2, "word " * 300_000 + "\none notice here\n"), (3, "x" * 500_000)], "doc_id long, text string")
    out = {r.doc_id: (r.license, r.line_licenses) for r in license.scan(docs, license.known_licenses(spark, texts)).collect()}
    assert out == {1: ("A-1", ["A-1"]), 2: (None, ["A-1"]), 3: (None, [])}
