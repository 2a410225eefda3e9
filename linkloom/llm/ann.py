"""Approximate nearest neighbours by cosine: a hierarchical k-means tree searched best bin first.

Fit: spherical k-means, applied again and again. Leaves are in proportion to rows (LEAF_ROWS members each, at least
MIN_LEAVES of them). The top of the tree is fitted on a sample of at most SAMPLE vectors; a table that needs more than
TOP_LEAVES leaves has each of these fitted further, in a task of its own, on at most about SAMPLE of its members. The whole tree is
shipped to tasks, so its centres are held to TREE_BYTES; beyond that leaves grow instead. Index: every row descends to its leaf.
Search: a priority queue over tree nodes, keyed by the cosine to their centres, yields a query's leaves best first;
the number of leaves visited is widened until the recall of calibration queries, measured against
brute force over all rows, reaches `target`. Queries then meet the members of their leaves in groups
(leaf, member block, query block) of bounded size, and the best per group are merged. Scores are cosines in double
precision; ties, however many, go to the smaller id.

Hot vectors: rows with equal vectors are one class, of which the k + 1 smallest ids are all that any
answer can hold; so the class of a very common vector is one member and one query.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose length is
not the most common one. Ids that are null take no part. Rows that repeat an id and a vector count once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BROADCAST_BYTES, discard, materialize

SAMPLE = 20_000
BRANCH = 16
LEAF_ROWS = 2048
MIN_LEAVES = TOP_LEAVES = 256
TREE_BYTES = BROADCAST_BYTES
BLOCK = 4096
CALIBRATION = 200


class Tree:
    """centers[i] is node i's centre; kids[i] its children; leaf[i] its leaf number or -1."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaves: int = MIN_LEAVES, seed: int = 7):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        rng = np.random.default_rng(seed)
        self.kids: list[list[int]] = [[]]
        centers = [unit.mean(axis=0)]
        queue = [(-len(unit), 0, np.arange(len(unit)))]
        n_leaves = 1
        while queue and n_leaves < leaves:
            _, node, rows = heapq.heappop(queue)
            if len(rows) < 2 * branch:
                continue
            part, mid = _kmeans(unit[rows], min(branch, leaves - n_leaves + 1), rng)
            if len(mid) < 2:
                continue
            n_leaves += len(mid) - 1
            for c in range(len(mid)):
                self.kids[node].append(len(centers))
                self.kids.append([])
                centers.append(mid[c])
                heapq.heappush(queue, (-int((part == c).sum()), len(centers) - 1, rows[part == c]))
        self.centers = np.array(centers, np.float32)
        self._number()

    def _number(self) -> None:
        self.leaf = np.full(len(self.kids), -1)
        ends = [i for i, k in enumerate(self.kids) if not k]
        self.leaf[ends] = np.arange(len(ends))
        self.n_leaves = len(ends)

    def graft(self, trees: dict[int, tuple[np.ndarray, list[list[int]]]]) -> None:
        """Puts the nodes below the root of each tree (centers, kids) in the place of a leaf, given by number."""
        parts, at = [self.centers], len(self.kids)
        for node in np.flatnonzero(self.leaf >= 0):
            centers, kids = trees.get(int(self.leaf[node]), (None, [[]]))
            if kids[0]:
                shift = at - 1  # the root of the tree is the leaf itself
                self.kids[node] = [k + shift for k in kids[0]]
                self.kids += [[k + shift for k in x] for x in kids[1:]]
                parts.append(centers[1:])
                at += len(kids) - 1
        self.centers = np.concatenate(parts)
        self._number()

    def assign(self, unit: np.ndarray) -> np.ndarray:
        at = np.zeros(len(unit), int)
        open_ = np.arange(len(unit)) if self.kids[0] else np.arange(0)
        while len(open_):
            for node in np.unique(at[open_]):
                rows = open_[at[open_] == node]
                kids = np.array(self.kids[node])
                at[rows] = kids[np.argmax(unit[rows] @ self.centers[kids].T, axis=1)]
            open_ = open_[[bool(self.kids[i]) for i in at[open_]]]
        return self.leaf[at]

    def best_bins(self, q: np.ndarray, visits: int) -> list[int]:
        """The first `visits` leaves of a best-bin-first traversal."""
        heap, out = [(-2.0, 0)], []
        while heap and len(out) < visits:
            _, node = heapq.heappop(heap)
            while self.kids[node]:  # descend to the best child, the others wait in the queue
                kids = self.kids[node]
                sims = self.centers[kids] @ q
                best = int(np.argmax(sims))
                for k, s in enumerate(sims.tolist()):
                    if k != best:
                        heapq.heappush(heap, (-s, kids[k]))
                node = kids[best]
            out.append(int(self.leaf[node]))
        return out


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    mid = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        part = np.argmax(x @ mid.T, axis=1)
        sums = np.zeros_like(mid)
        np.add.at(sums, part, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        mid = np.where(norm > 0, sums / np.maximum(norm, 1e-30), mid)
    part = np.argmax(x @ mid.T, axis=1)
    used, part = np.unique(part, return_inverse=True)
    return part, mid[used]


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype).reshape(len(column), -1).astype(np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def _top(q: np.ndarray, m: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q the k best rows of m: (positions, scores), cosine in double precision summed in
    one order for all rows, ties to the smaller id. All rows within the rounding bound of the k-th rough score are
    scored, so none of equal score is lost."""
    qn, mn = np.sqrt((q * q).sum(axis=1)), np.sqrt((m * m).sum(axis=1))
    take = min(len(m), k)
    rough = (q @ m.T) / mn[None, :]
    least = -np.partition(-rough, take - 1, axis=1)[:, take - 1] - qn * 8 * (m.shape[1] + 8) * np.finfo(float).eps
    pos, score = np.empty((len(q), take), int), np.empty((len(q), take))
    for i in range(len(q)):
        p = np.flatnonzero(rough[i] >= least[i])
        x = (m[p] * q[i]).sum(axis=1) / (qn[i] * mn[p])
        order = np.lexsort((ids[p], -x))[:take]
        pos[i], score[i] = p[order], x[order]
    return pos, score


def classes(rows: DataFrame, id_col: str, vec_col: str, k: int) -> tuple[DataFrame, str]:
    """(cid, v, ids): distinct vectors as bytes, their smallest id and k + 1 smallest ids; and v's dtype."""
    v = F.col(f"`{vec_col}`")
    double = rows.schema[vec_col].dataType.elementType.typeName() == "double"
    ok = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.cast("array<double>" if double else "array<float>").alias("v")).where(ok & F.col("id").isNotNull())
    length = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    kept = kept.where(F.size("v") == (length["n"] if length else 0)).withColumn("h", F.xxhash64("v"))
    dtype = "<f8" if double else "<f4"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(dtype) + 0.0  # -0.0 is 0.0
            each = flat.reshape(b.num_rows, -1) if b.num_rows else flat.reshape(0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in each], pa.binary())], names=["id", "v"])

    return kept.select("id", "v").mapInArrow(pack, "id long, v binary").distinct(), dtype


def fit(cls: DataFrame, n: int, dtype: str) -> Tree:
    """The tree over n classes (cid, v): its top fitted here on a sample, its branches in tasks of their own."""
    vector = lambda b: np.frombuffer(b, dtype).astype(np.float64)
    part = F.pmod(F.xxhash64("cid", F.lit("sample")), F.lit(1 << 40))
    sample = [vector(r["v"]) for r in cls.where(part < int((1 << 40) * min(1.0, SAMPLE / n))).select("v").limit(2 * SAMPLE).toLocalIterator()] or [vector(cls.first()["v"])]
    want = min(max(MIN_LEAVES, n // LEAF_ROWS), TREE_BYTES // (5 * len(sample[0])))
    tree = Tree(np.stack(sample), leaves=min(want, TOP_LEAVES))
    if want <= TOP_LEAVES:
        return tree

    def to_leaf(batches):
        for b in batches:
            if b.num_rows:
                leaf = tree.assign(_unit(_matrix(b.column(1), dtype)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf.astype(np.int32))], names=["cid", "v", "leaf"])

    index = materialize(cls.select("cid", "v").mapInArrow(to_leaf, "cid long, v binary, leaf int"), "branches")
    sizes = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row for each top leaf
    share = F.create_map(*[x for leaf, m in sizes.items() for x in (F.lit(leaf), F.lit(int((1 << 40) * min(1.0, SAMPLE / m))))])

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf = int(pdf["leaf"].iloc[0])
        sub = Tree(np.stack([vector(v) for v in pdf.sort_values("cid")["v"]]), leaves=max(1, want * sizes[leaf] // n))
        kids = np.concatenate([np.array([len(k), *k], np.int32) for k in sub.kids])
        return pd.DataFrame({"leaf": [leaf], "centers": [sub.centers.tobytes()], "kids": [kids.tobytes()]})

    trees = {}
    chosen = index.where(part < F.element_at(share, F.col("leaf")))
    for r in chosen.groupBy("leaf").applyInPandas(grow, "leaf int, centers binary, kids binary").toLocalIterator():  # TREE_BYTES in all
        flat, kids, i = np.frombuffer(r["kids"], np.int32).tolist(), [], 0
        while i < len(flat):
            kids.append(flat[i + 1 : i + 1 + flat[i]])
            i += 1 + flat[i]
        trees[r["leaf"]] = (np.frombuffer(r["centers"], np.float32).reshape(len(kids), -1), kids)
    tree.graft(trees)
    discard(index)
    return tree


def search(rows: DataFrame, k: int = 5, query: str = "pmod(id, 100) = 0", id_col: str = "vec_id", vec_col: str = "embedding", target: float = 0.95, report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k nearest other rows found. `query` is a SQL
    condition on id. `report` is filled with leaves, visits and the share of rows that a query is compared with. Defined
    cases: fewer than k candidates give fewer rows; an empty table gives none; ties go to the smaller vec_id; what takes no part
    is said above; other columns are not looked at."""
    spark = rows.sparkSession
    packed, dtype = classes(rows, id_col, vec_col, k)
    packed = materialize(packed.withColumn("h", F.xxhash64("v")), "vectors")
    first = F.row_number().over(W.partitionBy("h", "v").orderBy("id"))
    cls = packed.withColumn("rn", first).where(F.col("rn") <= k + 1).groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    cls = materialize(cls.select(F.col("ids")[0].alias("cid"), "h", "v", "ids"), "classes")
    n = cls.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    tree = fit(cls, n, dtype)

    def to_leaf(batches):
        for b in batches:
            if b.num_rows:
                leaf = tree.assign(_unit(_matrix(b.column(1), dtype)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf.astype(np.int32))], names=["cid", "v", "leaf"])

    index = materialize(cls.select("cid", "v").mapInArrow(to_leaf, "cid long, v binary, leaf int"), "index")
    of = materialize(packed.where(query).select(F.col("id").alias("query_id"), "h", "v").join(cls.select("cid", "h", "v"), ["h", "v"]).select("query_id", "cid"), "queries")
    asked = materialize(index.join(of.select("cid").distinct(), "cid", "left_semi"), "asked")
    visits = calibrate(index, asked, tree, dtype, k, target)

    def bins(batches):
        for b in batches:
            if not b.num_rows:
                continue
            unit = _unit(_matrix(b.column(1), dtype))
            for s in range(0, b.num_rows, 256):
                at, leaf = [], []
                for i in range(s, min(s + 256, b.num_rows)):
                    got = tree.best_bins(unit[i], visits)
                    at += [i] * len(got)
                    leaf += got
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), b.column(0).take(at), b.column(1).take(at)], names=["leaf", "cid", "v"])

    to = materialize(asked.select("cid", "v").mapInArrow(bins, "leaf int, cid long, v binary"), "visits")
    # both counts have a row per leaf, and the tree's leaves are bounded
    sizes = F.broadcast(index.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nm")).join(to.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nq")), "leaf"))
    if report is not None:
        met = index.groupBy("leaf").agg(F.count("*").alias("m")).join(to.groupBy("leaf").agg(F.count("*").alias("q")), "leaf").agg(F.sum(F.col("m") * F.col("q"))).first()[0]
        report.update(leaves=tree.n_leaves, visits=visits, share=(met or 0) / max(1, n * asked.count()))
    dealt = lambda df, own, other: df.join(sizes, "leaf").select(
        "leaf", F.pmod(F.xxhash64("cid"), own).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("other"), "cid", "v")
    left = dealt(index, F.col("nm"), "nq").select("leaf", F.col("own").alias("m"), F.col("other").alias("q"), "cid", "v")
    right = dealt(to, F.col("nq"), "nm").select("leaf", F.col("other").alias("m"), F.col("own").alias("q"), "cid", "v")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"qid": [], "cid": [], "score": []})
        m, q = (np.frombuffer(b"".join(x["v"]), dtype).reshape(len(x), -1).astype(np.float64) for x in (a, b))
        ids = a["cid"].to_numpy()
        out = []
        for s in range(0, len(q), 512):
            pos, score = _top(q[s : s + 512], m, ids, k + 1)
            out.append(pd.DataFrame({"qid": np.repeat(b["cid"].to_numpy()[s : s + 512], pos.shape[1]), "cid": ids[pos].ravel(), "score": score.ravel()}))
        return pd.concat(out)

    key = ["leaf", "m", "q"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, "qid long, cid long, score double")
    best = F.row_number().over(W.partitionBy("qid").orderBy(F.col("score").desc(), "cid"))
    top = materialize(found.withColumn("rn", best).where(F.col("rn") <= k + 1).select("qid", "cid", "score"), "top")
    lists = top.join(cls.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    # of the class's answer the k + 1 best are enough for each of its queries
    lists = lists.withColumn("rn", F.row_number().over(W.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rn") <= k + 1)
    answer = lists.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rn", "vec_id", "score"))).alias("a"))
    each = of.join(answer, F.expr("cid = qid")).select("query_id", F.slice(F.filter("a", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("a"))
    return each.select("query_id", F.posexplode("a").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def calibrate(index: DataFrame, asked: DataFrame, tree: Tree, dtype: str, k: int, target: float) -> int:
    """The number of leaves to visit: doubled, then narrowed, until the mean recall of at most CALIBRATION
    queries, against brute force over the whole index, reaches target."""
    probes = [(r["cid"], r["v"]) for r in asked.orderBy(F.xxhash64("cid", F.lit("probe"))).limit(CALIBRATION).collect()]
    if not probes:
        return 1
    q = np.frombuffer(b"".join(v for _, v in probes), dtype).reshape(len(probes), -1).astype(np.float64)

    def brute(batches):
        for b in batches:
            if b.num_rows:
                ids, leaf, m = b.column(0).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(1), dtype)
                pos, score = _top(q, m, ids, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), pos.shape[1]).astype(np.int32)), pa.array(ids[pos].ravel()), pa.array(score.ravel()), pa.array(leaf[pos].ravel())], names=["q", "cid", "score", "leaf"])

    got = index.mapInArrow(brute, "q int, cid long, score double, leaf int")
    rn = F.row_number().over(W.partitionBy("q").orderBy(F.col("score").desc(), "cid"))
    truth = got.withColumn("rn", rn).where(F.col("rn") <= k + 1).select("q", "cid", "leaf").collect()  # CALIBRATION * (k + 1) rows at most
    unit, ranks = _unit(q), []
    order = [{leaf: i for i, leaf in enumerate(tree.best_bins(u, tree.n_leaves))} for u in unit]
    for r in truth:
        if r["cid"] != probes[r["q"]][0]:
            ranks.append(order[r["q"]][r["leaf"]])
    if not ranks:
        return 1
    recall = lambda v: float(np.mean(np.array(ranks) < v))
    visits = 1
    while recall(visits) < target and visits < tree.n_leaves:
        visits *= 2
    low = visits // 2
    while visits - low > 1:
        mid = (low + visits) // 2
        low, visits = (low, mid) if recall(mid) >= target else (mid, visits)
    return min(visits, tree.n_leaves)


def op1_ann_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), k=5, query="pmod(id, 50) = 0")
