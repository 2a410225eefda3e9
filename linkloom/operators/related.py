"""Which of many pairs of posts and targets are related: vectors meet in blocks and are never multiplied row by row of a join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.sources.scratch import discard, written

#: Posts and targets of a block at most, about.
SOURCES, TARGETS = 16_384, 65_536


class Vectors:
    """Sparse vectors (id, t, w, nn), in order of their ids."""

    def __init__(self, d: pa.Table):
        d = d.combine_chunks().sort_by("id")
        t = d["t"].combine_chunks()
        self.ids, self.nn = np.asarray(d["id"]), np.asarray(d["nn"])
        self.start = np.concatenate([[0], np.cumsum(np.asarray(t.value_lengths()))]).astype(np.int64) if len(d) else np.zeros(1, np.int64)
        self.t, self.w = np.asarray(t.flatten()), np.asarray(d["w"].combine_chunks().flatten())

    def at(self, ids: np.ndarray) -> np.ndarray:
        """Their places, -1 for what has no vector."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        k = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[k] == ids, k, -1)


def cosines(a: Vectors, b: Vectors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of a[i] and b[j], 0 where one is missing. A vector of a is spread over all words once, for all of b that it meets."""
    words, local = np.unique(np.concatenate([a.t, b.t]), return_inverse=True)
    at, bt = local[: len(a.t)], local[len(a.t) :]
    dense, out = np.zeros(len(words)), np.zeros(len(i))
    order = np.argsort(i, kind="stable")
    order = order[(i[order] >= 0) & (j[order] >= 0)]
    edges = np.flatnonzero(np.diff(i[order], prepend=-1, append=-1)) if len(order) else []
    for lo, hi in zip(edges[:-1], edges[1:]):
        rows = order[lo:hi]
        span, x = slice(a.start[i[rows[0]]], a.start[i[rows[0]] + 1]), j[rows]
        dense[at[span]] = a.w[span]
        sizes = b.start[x + 1] - b.start[x]
        flat = np.repeat(b.start[x] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        dot = np.bincount(np.repeat(np.arange(len(rows)), sizes), dense[bt[flat]] * b.w[flat], len(rows))
        dense[at[span]] = 0.0
        norm = a.nn[i[rows[0]]] * b.nn[x]
        ok = (dot > 0) & (norm > 0)
        out[rows[ok]] = dot[ok] / np.sqrt(norm[ok])
    return out


def related(pairs: DataFrame, names: DataFrame, own: DataFrame, theirs: DataFrame, least: float) -> DataFrame:
    """pairs (src, no) with a similarity of at least `least` to what `no` names (no, target). own, theirs: weights (id, term, w, idf) of posts and
    targets. The similarity is that of corpus.relatedness(); pairs are moved once, as numbers, vectors once for each block that they meet."""
    theirs = written(theirs)
    terms = written(theirs.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))

    def vectors(x: DataFrame) -> DataFrame:  # words of no target take no part in a product, but in the norm
        entries = F.collect_list(F.when(F.col("t").isNotNull(), F.struct("t", "w")))
        v = x.join(terms, "term", "left").groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("nn"), entries.alias("x"))
        return written(v.select("id", "nn", F.transform("x", lambda y: y["t"]).alias("t"), F.transform("x", lambda y: y["w"]).alias("w")))

    posts, goals = vectors(own), vectors(theirs)
    numbers = written(names.select(F.col("target").alias("id")).distinct().withColumn("goal", F.monotonically_increasing_id()))
    goals = goals.join(numbers, "id").drop("id").withColumnRenamed("goal", "id")
    tn, sn = max(1, -(-numbers.count() // TARGETS)), max(pairs.sparkSession.sparkContext.defaultParallelism, -(-posts.count() // SOURCES))
    sb, tb = (lambda c: F.pmod(F.xxhash64(c), F.lit(sn)).cast("int").alias("sb")), (lambda c: F.pmod(F.xxhash64(c), F.lit(tn)).cast("int").alias("tb"))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    of = written(names.join(numbers.withColumnRenamed("id", "target"), "target").select("no", "goal"))
    met = pairs.join(F.broadcast(of) if of.count() <= 250_000 else of, "no").select(sb("src"), tb("goal"), "src", "no", "goal")
    cols = ["id", "nn", "t", "w"]
    each = posts.select(sb("id"), every(tn, "tb"), F.lit(False).alias("goals"), *cols).unionByName(goals.select(every(sn, "sb"), tb("id"), F.lit(True).alias("goals"), *cols))

    def run(p: pa.Table, d: pa.Table) -> pa.Table:
        goals = np.asarray(d["goals"])
        a, b = Vectors(d.filter(pa.array(~goals))), Vectors(d.filter(pa.array(goals)))
        keep = cosines(a, b, a.at(np.asarray(p["src"])), b.at(np.asarray(p["goal"]))) >= least
        return p.select(["src", "no"]).filter(pa.array(keep))

    out = written(met.groupBy("sb", "tb").cogroup(each.groupBy("sb", "tb")).applyInArrow(run, "src long, no long"))
    discard(theirs, terms, posts)
    return out
