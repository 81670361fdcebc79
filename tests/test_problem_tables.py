"""The problem queries on tables that are empty, and on ones with nulls strewn over every column and rows repeated."""

import os

import pytest
from pyspark.sql import functions as F

from vitalframe.plans import problems

DATA = "/root/testdata/sf0.001"
TABLES = ["samples", "batches", "daily_values", "baselines", "metric_policy"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return str(d)


@pytest.fixture(scope="module")
def dirty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("dirty")
    for t in TABLES:
        df = spark.read.parquet(f"{DATA}/{t}.parquet").withColumns({"tile": F.lit("extra"), "bucket": F.lit(1), "key": F.lit(None).cast("string")})
        df = df.unionByName(df.sample(0.2, 1))
        keep = {"row_id", "delivery_no", "tile", "bucket", "key"}
        df.select(*[F.col(c) if c in keep else F.when(F.rand(i) > 0.2, F.col(c)).alias(c) for i, c in enumerate(df.columns)]).write.parquet(f"{d}/{t}.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(problems.QUERIES))
def test_empty_tables(spark, empty, name):
    assert problems.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(problems.QUERIES))
def test_dirty_tables(spark, dirty, name):
    assert problems.QUERIES[name](spark, dirty).count() >= 0
