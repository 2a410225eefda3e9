"""Link equity: PageRank and click depth over distinct edges between published posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from linkloom.functions.scoring import need
from linkloom.operators.reports import published
from linkloom.sources.scratch import bucketed, discard, written

DAMPING, ROUNDS, EPSILON, DEEP = 0.85, 40, 1e-6, 3


def graph(posts: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, edges: src, dst)."""
    nodes = published(posts).select("id")
    e = links.where("type = 'internal' and target > 0 and src <> target").select("src", F.col("target").alias("dst")).distinct()
    return nodes, e.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("outbound"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("inbound"))
    return nodes.join(out, "id", "left").join(into, "id", "left").fillna(0, ["outbound", "inbound"])


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS, epsilon: float | None = EPSILON, damping: float = DAMPING) -> DataFrame:
    """(id, rank): ranks sum to one; dangling rank is spread evenly. It stops after the round in which no rank moved by epsilon (None: never).

    Edges are bucketed by their source and ranks by id, so a round shuffles only what flows along the edges (summed before the
    shuffle). Each round's ranks are a table; the dangling rank and the greatest move are observed while it is written, so a round is one job whose
    plan is the same in every round."""
    spark = nodes.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = bucketed(edges, "src", buckets)
    first = nodes.join(e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("outdeg")), "id", "left").fillna(0, ["outdeg"])
    state = bucketed(first, "id", buckets)
    n, lost = state.agg(F.count("*"), F.count_if(F.col("outdeg") == 0)).first()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    rank, loose = state.withColumn("rank", F.lit(1.0 / n)), lost / n
    for _ in range(rounds):
        flow = e.join(rank.where("outdeg > 0").select(F.col("id").alias("src"), (F.col("rank") / F.col("outdeg")).alias("part")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("part").alias("got"))
        new = F.lit((1 - damping) / n + damping * loose / n) + damping * F.coalesce("got", F.lit(0.0))
        seen = Observation()
        measured = rank.join(flow, "id", "left").select("id", "outdeg", new.alias("rank"), F.abs(F.col("rank") - new).alias("moved")).observe(
            seen, F.coalesce(F.sum(F.when(F.col("outdeg") == 0, F.col("rank"))), F.lit(0.0)).alias("loose"), F.max("moved").alias("moved"))
        after = bucketed(measured, "id", buckets)
        discard(state)
        state = rank = after
        loose = seen.get["loose"]
        if epsilon is not None and seen.get["moved"] < epsilon:
            break
    discard(e)
    return rank.select("id", "rank")


def seeds(posts: DataFrame, nodes: DataFrame, front: int | None = None, recent: int = 10) -> DataFrame:
    """The front page if it is a node, else the most recent posts."""
    if front is not None and not nodes.where(F.col("id") == front).isEmpty():
        return nodes.where(F.col("id") == front)
    return published(posts).where("type = 'post'").orderBy(F.col("taken").desc(), "id").limit(recent).select("id")


def depths(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(id, depth): fewest clicks from a seed; posts that can't be reached are missing. One join a level."""
    seen = written(start.select("id", F.lit(0).alias("depth")).distinct())
    front, level = seen, 0
    e = written(edges)
    while not front.isEmpty():
        level += 1
        front = written(e.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(level)))
        seen = seen.unionByName(front)
    discard(e)
    return seen


def equity(posts: DataFrame, links: DataFrame, front: int | None = None, rounds: int = ROUNDS, epsilon: float | None = EPSILON) -> DataFrame:
    """id, title, equity, relative, depth, inbound, outbound, is_seed, need for each published post."""
    nodes, edges = graph(posts, links)
    edges = written(edges)
    start = written(seeds(posts, nodes, front))
    rank, deg, dep = pagerank(nodes, edges, rounds, epsilon), degrees(nodes, edges), depths(edges, start)
    n = nodes.agg(F.count("*").alias("n_"))
    out = rank.join(deg, "id").join(dep, "id", "left").join(start.withColumn("is_seed", F.lit(True)), "id", "left").join(posts.select("id", "title"), "id").crossJoin(F.broadcast(n))  # n is one row
    rel = F.col("rank") * F.col("n_")
    return out.select("id", "title", F.col("rank").alias("equity"), rel.alias("relative"), "depth", "inbound", "outbound", F.coalesce("is_seed", F.lit(False)).alias("is_seed"), need(rel).alias("need"))


def equity_stats(rows: DataFrame) -> DataFrame:
    d = F.col("depth")
    return rows.agg(F.count("*").alias("posts"), F.count_if(d.isNull()).alias("unreachable"), F.count_if(d > DEEP).alias("deep"), F.avg("depth").alias("avg_depth"), F.max("depth").alias("max_depth"), F.count_if(F.col("relative") < 0.5).alias("starved"), F.count_if("is_seed").alias("seeds"))


def view(rows: DataFrame, name: str, limit: int = 25) -> DataFrame:
    """starved, buried, unreachable or hoarding posts."""
    if name == "starved":
        return rows.where("relative < 0.5").orderBy("relative", "id").limit(limit)
    if name == "buried":
        return rows.where(F.col("depth") > DEEP).orderBy(F.col("depth").desc(), "id").limit(limit)
    if name == "unreachable":
        return rows.where("depth is null")
    return rows.where("outbound = 0").orderBy(F.col("equity").desc(), "id").limit(limit)
