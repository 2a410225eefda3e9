"""Topic clusters: membership, pillars, health, relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.operators.reports import internal, published

LEFT_OVER = -1


def grouping(posts: DataFrame, membership: DataFrame) -> DataFrame:
    """(cluster, post_id): published members, and LEFT_OVER for posts in no cluster."""
    pub = published(posts).select(F.col("id").alias("post_id"))
    inside = membership.select("cluster", "post_id").distinct().join(pub.hint("merge"), "post_id", "left_semi").select("cluster", "post_id")  # sides of a site's size: never broadcast
    rest = pub.join(inside.hint("merge"), "post_id", "left_anti").select(F.lit(LEFT_OVER).cast("long").alias("cluster"), "post_id")
    return inside.unionByName(rest)


def first_cluster(assigned: DataFrame, posts: DataFrame) -> DataFrame:
    """Membership in which each post keeps its first cluster (columns cluster, place, post_id), leftovers apart."""
    one = assigned.groupBy("post_id").agg(F.min_by("cluster", "place").alias("cluster"))
    return grouping(posts, one)


def snapshot(posts: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    """One row per cluster: count, pillar, orphans, internal, connected, health, stage."""
    into = internal(links).where("target > 0")
    inbound = into.groupBy(F.col("target").alias("post_id")).agg(F.count("*").alias("inbound"))
    m = members.join(inbound, "post_id", "left").fillna(0, ["inbound"])
    edges = into.where("src <> target").select("src", "target")
    a, b = members.select(F.col("cluster").alias("ca"), F.col("post_id").alias("src")), members.select("cluster", F.col("post_id").alias("target"))
    sib = edges.join(a, "src").join(b, "target").where("ca = cluster").groupBy("cluster", F.col("target").alias("post_id")).agg(F.count("*").alias("sib"))
    rows = m.join(sib, ["cluster", "post_id"], "left").fillna(0, ["sib"])
    best = F.max_by(F.struct("post_id", "inbound"), F.struct("inbound", -F.col("post_id")))
    out = rows.groupBy("cluster").agg(F.count("*").alias("count"), best.alias("p"), F.count_if(F.col("inbound") == 0).alias("orphans"), F.sum("sib").alias("internal"), F.count_if(F.col("sib") > 0).alias("connected"))
    pillar = F.when(F.col("p.inbound") > 0, F.col("p.post_id")).otherwise(0)
    out = out.withColumn("health", F.round(F.col("connected") / F.col("count"), 4))
    stage = F.when(F.col("health") >= 0.70, "strong").when(F.col("health") >= 0.35, "growing").otherwise("weak")
    return out.select("cluster", "count", pillar.alias("pillar"), "orphans", "internal", "connected", "health", stage.alias("stage"))


def cluster_of_post(members: DataFrame) -> DataFrame:
    """Each post's last cluster in order of size, largest first: the smallest it is in."""
    size = members.groupBy("cluster").agg(F.count("*").alias("n"))
    w = W.partitionBy("post_id").orderBy("n", F.col("cluster").desc())
    return members.where(F.col("cluster") != LEFT_OVER).join(F.broadcast(size), "cluster").withColumn("r", F.row_number().over(w)).where("r = 1").select("post_id", "cluster")  # size has a row per cluster


def relations(parents: DataFrame) -> DataFrame:
    """(a, b, relation) for related clusters: 1 for the same, 0.5 for parent and child or a shared parent; others 0."""
    p = parents.select(F.col("cluster").alias("a"), F.col("parent").alias("pa"))
    q = parents.select(F.col("cluster").alias("b"), F.col("parent").alias("pb"))
    same = p.select("a", F.col("a").alias("b"), F.lit(1.0).alias("relation"))
    kin = p.join(q, F.col("pa") == F.col("pb")).where("a <> b").select("a", "b", F.lit(0.5).alias("relation"))
    child = p.join(q, F.col("pa") == F.col("b")).where("a <> b").select("a", "b", F.lit(0.5).alias("relation"))
    back = child.select(F.col("b").alias("a"), F.col("a").alias("b"), "relation")
    return same.unionByName(kin).unionByName(child).unionByName(back).groupBy("a", "b").agg(F.max("relation").alias("relation"))
