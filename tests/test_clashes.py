"""Keyword clashes: a post is copied to few cells, as two numbers."""

import pytest
from pyspark.sql import functions as F

from linkloom.operators import keywords as K


@pytest.mark.parametrize("most", [250_000, 1])
def test_a_clash_copies_few_and_small_rows(spark, monkeypatch, most):
    monkeypatch.setattr(K, "KEYS", most)
    posts = spark.range(6000).select("id", F.lit("publish").alias("status"), F.lit("post").alias("type"))
    kw = spark.range(6000).select(F.col("id").alias("post_id"), F.when(F.col("id") < 5000, "One long keyword").when(F.col("id") < 5003, "two").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("keyword"))
    made, within = [], K.within
    monkeypatch.setattr(K, "within", lambda df, id_, on, cell=2048: made.append((df, on, cell)) or within(df, id_, on, cell))
    got = K.clashes(kw, posts)
    assert got.columns == ["a", "b", "norm"]
    assert sorted(map(tuple, got.groupBy("norm").agg(F.count("*"), F.countDistinct("a", "b"), F.count_if(F.col("a") < F.col("b"))).collect())) == [("one long keyword", 5000 * 4999 // 2, 5000 * 4999 // 2, 5000 * 4999 // 2), ("two", 3, 3, 3)]
    (df, on, cell), = made
    assert cell >= 5000  # one cell, two copies
    if most > 1:
        assert dict(df.dtypes) == {"post_id": "bigint", "no": "bigint"} and df.count() == 5003
