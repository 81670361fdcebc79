"""The text queries on empty tables, and with nulls in every column and rows repeated."""

import os

import pytest
from pyspark.sql import functions as F

from vitalframe.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_and_dirty(spark, tmp_path, name):
    docs, targets = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "mix_targets"))
    for d, frac in (("empty", 0.0), ("dirty", 1.0)):
        more = docs.withColumns({"key": F.lit("x"), "pos": F.lit(1), "ids": F.lit("y")})
        more = more.unionByName(more.sample(0.2, 1)).sample(frac, 1) if frac else more.limit(0)
        more = more.select(*[F.when(F.rand(i) > 0.2, F.col(c)).alias(c) for i, c in enumerate(more.columns)])
        more.write.parquet(f"{tmp_path}/{d}/documents.parquet")
        targets.write.parquet(f"{tmp_path}/{d}/mix_targets.parquet")
        n = queries.QUERIES[name](spark, f"{tmp_path}/{d}").count()
        assert n > 0 if frac else n == (9 if name == "p9_shares" else 0)
