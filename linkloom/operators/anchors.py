"""Reports on anchor texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text
from linkloom.functions.words import GENERIC_ANCHORS

REPEAT = 10


def keyed(links: DataFrame) -> DataFrame:
    """Internal links with norm, the normalised anchor, and goal, the post or else the URL's hash."""
    rows = links.where("type = 'internal'").withColumn("norm", text.normalize_anchor(F.col("anchor"))).where("norm <> ''")
    return rows.withColumn("goal", F.when(F.col("target") > 0, F.concat(F.lit("p"), F.col("target").cast("string"))).otherwise(F.concat(F.lit("u"), F.md5("url"))))


def is_generic(norm):
    return norm.isin(*GENERIC_ANCHORS)


def targets(links: DataFrame) -> DataFrame:
    """(norm, goal, uses, target, url): how often each anchor leads where."""
    return keyed(links).groupBy("norm", "goal").agg(F.count("*").alias("uses"), F.max("target").alias("target"), F.min("url").alias("url"))


def report(links: DataFrame, repeat: int = REPEAT) -> DataFrame:
    """One row per anchor: uses, targets, sources and flags; two grouped levels, no list is gathered."""
    per = keyed(links).groupBy("norm", "goal").agg(F.count("*").alias("n"))
    top = per.groupBy("norm").agg(F.sum("n").alias("uses"), F.count("*").alias("targets"), F.max("n").alias("most"))
    src = keyed(links).groupBy("norm").agg(F.countDistinct("src").alias("sources"))
    return top.join(src, "norm").select("norm", "uses", "targets", "sources", is_generic(F.col("norm")).alias("generic"), (F.col("targets") > 1).alias("ambiguous"), (F.col("most") >= repeat).alias("repetitive"))


def counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("anchors"), F.sum("uses").alias("links"), F.count_if("generic").alias("n_generic"), F.count_if("ambiguous").alias("n_ambiguous"), F.count_if("repetitive").alias("n_repetitive"))


def single_anchor_targets(links: DataFrame, min_links: int = 4) -> DataFrame:
    """Targets that many links reach by one and the same anchor."""
    rows = links.where("type = 'internal' and target > 0").withColumn("norm", text.normalize_anchor(F.col("anchor")))
    return rows.groupBy("target").agg(F.count("*").alias("inbound"), F.countDistinct(F.nullif(F.col("norm"), F.lit(""))).alias("forms"), F.max("norm").alias("anchor")).where((F.col("inbound") >= min_links) & (F.col("forms") <= 1))


def usages(links: DataFrame, posts: DataFrame, anchor: str) -> DataFrame:
    """Every link with that anchor, with the titles of both ends."""
    want = text.normalize_anchor(F.lit(anchor))
    rows = keyed(links).where(F.col("norm") == want)
    named = posts.select("id", "title")
    return (rows.join(named.select(F.col("id").alias("src"), F.col("title").alias("src_title")), "src", "left").join(named.select(F.col("id").alias("target"), F.col("title").alias("target_title")), "target", "left")
            .select("src", "src_title", "target", "target_title", "url", "anchor"))
