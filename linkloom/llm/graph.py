"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for each node that has an edge; root is the least node of its component.

    Each round is joins and aggregates only; a star's centre that gathers many leaves is a hot key of
    a sort-merge join, which adaptive execution splits. Rounds end when the edge set no longer changes.
    Null ends and self-loops are ignored; no edges gives no rows.
    """
    e = materialize(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where("u is not null and v is not null and u <> v").distinct(), "cc")
    mark = _mark(e)
    while mark[0]:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        new = materialize(small, "cc")
        discard(e)
        e, old, mark = new, mark, _mark(new)
        if mark == old:
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return (r["n"], r["x"])
