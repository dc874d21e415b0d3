"""Every registered query of the engine against its DuckDB oracle at the smallest scale, and folds by literal cases."""

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import fleet
from fleetlens.operators import content
from fleetlens.plans import catalog
from tests.oracle_check import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_oracle(spark, name):
    assert "ok," in (said := compare(spark, name, catalog.QUERIES[name], catalog.ORACLES[name], SF)), said


@pytest.mark.parametrize("value,bucket", [(0.5, 0), (1.0, 0), (1.5, 1), (2.0, 1), (1024.0, 10), (1024.0000000000002, 11), (float(2**29), 29), (1e12, 31)])
def test_latency_bucket_edges(spark, value, bucket):
    assert spark.createDataFrame([(value,)], "v double").select(fleet.latency_bucket(F.col("v"))).first()[0] == bucket


def test_repair_skips_what_overflows_and_goes_on(spark):
    rows = spark.createDataFrame([(0, 8, 1, "replicated"), (1, 9, 1, "replicated"), (2, 2, 1, "replicated")], "digest long, size long, healthy long, policy string")
    assert content.repair_plan(rows, 1, 10).first().planned == 10


def test_backoff(spark):
    rows = spark.range(1, 5).select(fleet.backoff(F.col("id"), 5, 20))
    assert [r[0] for r in rows.collect()] == [5, 10, 20, 20]
