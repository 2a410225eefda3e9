"""Focus keywords from several sources, clashes between posts, semantic overlap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions import scoring, text
from linkloom.operators.pairs import KEYS, NARROW, within
from linkloom.operators.reports import published
from linkloom.sources.scratch import discard, written

#: Meta keys of the sources, in order of trust.
SOURCES = {"rankmath": ("rank_math_focus_keyword", True), "yoast": ("_yoast_wpseo_focuskw", False), "aioseo": (None, False), "seopress": ("_seopress_analysis_target_kw", True)}
SEMANTIC = 0.86

PIVOTS, SAMPLE = 24, 1000
#: Tiles of blocks on a side at least, and blocks of a tile's side at most.
TILES, TILE = 6, 32


def from_meta(meta: DataFrame, posts: DataFrame, key: str, first_of_list: bool = False) -> DataFrame:
    """(post_id, keyword) of published posts with a value under that meta key."""
    v = F.col("meta_value")
    word = text.collapse(text.strip_tags(F.element_at(F.split(v, ","), 1) if first_of_list else v))
    rows = meta.where((F.col("meta_key") == key) & (v != "")).join(published(posts).select(F.col("id").alias("post_id")), "post_id", "left_semi")
    return rows.select("post_id", word.alias("keyword")).where("keyword <> ''")


def from_json(aioseo: DataFrame, posts: DataFrame) -> DataFrame:
    """(post_id, keyword) from a JSON column with focus.keyphrase."""
    k = F.from_json("keyphrases", "focus struct<keyphrase:string>")["focus"]["keyphrase"]
    rows = aioseo.join(published(posts).select(F.col("id").alias("post_id")), "post_id", "left_semi")
    return rows.select("post_id", text.collapse(k).alias("keyword")).where("keyword <> ''")


def all_sources(meta: DataFrame, aioseo: DataFrame, posts: DataFrame) -> DataFrame:
    """(post_id, keyword, source, place) over all sources, place by trust."""
    parts = []
    for place, (name, (key, first)) in enumerate(SOURCES.items()):
        rows = from_json(aioseo, posts) if key is None else from_meta(meta, posts, key, first)
        parts.append(rows.withColumns({"source": F.lit(name), "place": F.lit(place)}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def live(rows: DataFrame) -> DataFrame:
    """One keyword per post: the most trusted source's."""
    return rows.groupBy("post_id").agg(F.min(F.struct("place", "keyword", "source")).alias("x")).select("post_id", "x.keyword", "x.source")


def newest(own: DataFrame) -> DataFrame:
    """Each post's newest own keyword."""
    return own.groupBy("post_id").agg(F.max_by("keyword", "id").alias("keyword"))


def focus(own: DataFrame, live_: DataFrame, prefer: str = "seo_plugin") -> DataFrame:
    """Both maps joined; the preferred side wins where both have a post."""
    a = newest(own).select("post_id", F.col("keyword").alias("own"))
    b = live_.select("post_id", F.col("keyword").alias("live"))
    order = ["live", "own"] if prefer == "seo_plugin" else ["own", "live"]
    return a.join(b, "post_id", "full_outer").select("post_id", F.coalesce(*order).alias("keyword"))


def for_posts(own: DataFrame, live_: DataFrame) -> DataFrame:
    """All keywords of each post: the live one first unless it is among its own, which come newest first."""
    mine = own.select("post_id", "keyword", F.col("id").alias("key"), F.lit(1).alias("rank_"))
    known = mine.select("post_id", F.lower("keyword").alias("k")).distinct()
    first = live_.select("post_id", "keyword").withColumn("k", F.lower("keyword")).join(known, ["post_id", "k"], "left_anti").select("post_id", "keyword", F.lit(None).cast("long").alias("key"), F.lit(0).alias("rank_"))
    rows = first.unionByName(mine)
    place = F.row_number().over(W.partitionBy("post_id").orderBy("rank_", F.col("key").desc()))
    return rows.withColumn("place", place).select("post_id", "place", "keyword")


def source_counts(rows: DataFrame, own: DataFrame) -> DataFrame:
    """total and new keywords per source."""
    known = own.select("post_id", F.lower("keyword").alias("k")).distinct().withColumn("known", F.lit(True))
    j = rows.withColumn("k", F.lower("keyword")).join(known, ["post_id", "k"], "left")
    return j.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("known").isNull()).alias("new"))


def dedupe_import(rows: DataFrame, own: DataFrame) -> DataFrame:
    """Rows that are new: not stored yet and not twice in the batch, case apart."""
    r = rows.withColumn("k", F.lower("keyword")).groupBy("post_id", "k").agg(F.min("keyword").alias("keyword"))
    return r.join(own.select("post_id", F.lower("keyword").alias("k")), ["post_id", "k"], "left_anti").select("post_id", "keyword")


def clash_groups(keywords: DataFrame, posts: DataFrame) -> DataFrame:
    """(norm, n) of keywords that several published posts share."""
    return normed(keywords, posts).groupBy("norm").agg(F.count("*").alias("n")).where("n > 1")


def normed(keywords: DataFrame, posts: DataFrame) -> DataFrame:
    k = keywords.join(published(posts).select(F.col("id").alias("post_id")), "post_id", "left_semi")
    return k.select("post_id", text.normalize_anchor(F.col("keyword")).alias("norm")).where("norm <> ''").distinct()


def clashes(keywords: DataFrame, posts: DataFrame) -> DataFrame:
    """(a, b, norm), a < b: every two published posts with the same focus keyword. The report is of pairs, so
    its size is that of the answer; they are made in cells of a keyword's posts and not shuffled. While keywords that
    posts share are at most KEYS, what is copied to cells is two numbers, and the keyword joins last."""
    rows = written(normed(keywords, posts))
    names = written(rows.groupBy("norm").agg(F.count("*").alias("n")).where("n > 1").select("norm", F.monotonically_increasing_id().alias("no")))
    ends = F.col("p.post_id").alias("a"), F.col("q.post_id").alias("b")
    if names.count() > KEYS:
        return within(rows, "post_id", "norm", NARROW).select(*ends, "norm")
    shared = written(rows.join(F.broadcast(names), "norm").select("post_id", "no"))
    return within(shared, "post_id", "no", NARROW).select(*ends, "no").join(F.broadcast(names), "no").select("a", "b", "norm")


def cosine(a, b):
    """Cosine over the shorter length, 0 where a norm is 0; in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p.cast("double") * q.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm).otherwise(0.0)


def overlap_pairs(vectors: DataFrame, threshold: float = SEMANTIC, block: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, report: dict | None = None) -> DataFrame:
    """(a, b, similarity), a < b, of all pairs at or above the threshold, rounded to 4 digits: an exact join of angles.

    Every vector is filed under the nearest of a few pivots (far apart, from a sample of at most SAMPLE), in order of its angle to it, in
    blocks of at most `block` rows. A block knows the range of its vectors' angles to each pivot. By the triangle inequality two vectors
    within an angle of each other lie within it to every pivot too, so only blocks meet whose ranges do, and of these only the rows that lie
    within the other's ranges are multiplied. Blocks are moved to tiles of blocks, where they meet, as often as there are tiles on a side. Vectors of different lengths are not compared, nor null, zero ones or ones with null or non-finite
    components. On vectors without clusters most blocks meet, and the work is quadratic. report gets the number of `compared` pairs and of the `copies` of rows that were moved."""
    limit = math.acos(max(-1.0, threshold - 6e-5)) + 1e-6
    kind = vectors.schema[vec_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # stored and moved as it is, computed in double precision
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast(kind).alias("v")).where("v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    none = vectors.sparkSession.createDataFrame([], "a long, b long, similarity double")
    if not sample:
        return none
    chosen = {w: far_apart(np.array([r["v"] for r in sample if len(r["v"]) == w]), pivots) for w in {len(r["v"]) for r in sample}}

    def placed(v: np.ndarray) -> np.ndarray:
        """Angles to the pivots of that length, infinite for those that lack; a length that the sample lacks has no pivots: its vectors are all compared."""
        angles = np.zeros((len(v), pivots))
        if v.shape[1] in chosen:
            got = _angles(v, chosen[v.shape[1]])
            angles[:, : got.shape[1]], angles[:, got.shape[1] :] = got, np.inf
        return angles

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for w, part in pdf.groupby(pdf["v"].map(len)):
                angles = placed(np.stack(part["v"]).astype(float))
                home = angles.argmin(axis=1)
                angles[np.isinf(angles)] = 0.0
                yield pd.DataFrame({"w": w, "home": home, "near": angles[np.arange(len(part)), home], "id": part["id"].to_numpy(), "v": list(part["v"]), "angles": list(angles)})

    filed = rows.mapInPandas(file, f"w int, home int, near double, id long, v {kind}, angles array<double>")
    n = max(1, -(-rows.count() // block))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, size, last = TaskContext.get().partitionId() << 32, 0, None
        for pdf in batches:  # in order: a block ends where its cell does or where it is full
            names = []
            for cell in zip(pdf["w"], pdf["home"]):
                if last is not None and (cell != last or size == block):
                    at, size = at + 1, 0
                names.append(at)
                size, last = size + 1, cell
            yield pdf.assign(block=names)

    ordered = filed.repartitionByRange(n, "w", "home", "near", F.xxhash64("id")).sortWithinPartitions("w", "home", "near")
    part = written(ordered.mapInPandas(cut, f"w int, home int, near double, id long, v {kind}, angles array<double>, block long"))
    spans = [f(F.col("angles")[i]).alias(f"{k}{i}") for i in range(pivots) for k, f in (("l", F.min), ("h", F.max))]
    shelf = written(part.groupBy("w", "home", "block").agg(F.count("*").alias("n"), *spans))  # a row for each block
    cells = shelf.groupBy("w", "home").agg(*[f(f"{k}{i}").alias(f"{k}{i}") for i in range(pivots) for k, f in (("l", F.min), ("h", F.max))])  # a row for each pivot and length

    def meeting(left: DataFrame, right: DataFrame, on) -> DataFrame:
        p, q = left.alias("p"), right.alias("q")
        near = F.greatest(*[F.greatest(F.col(f"p.l{i}") - F.col(f"q.h{i}"), F.col(f"q.l{i}") - F.col(f"p.h{i}")) for i in range(pivots)], F.lit(0.0)) <= limit
        return p.join(q, on & near)

    two = meeting(cells, cells, F.col("p.w") == F.col("q.w")).select(F.col("p.w").alias("cw"), F.col("p.home").alias("ph"), F.col("q.home").alias("qh"))
    named = shelf.join(two, (F.col("w") == F.col("cw")) & (F.col("home") == F.col("ph"))).drop("cw", "ph")
    pairs = meeting(named, shelf.drop("n"), (F.col("p.w") == F.col("q.w")) & (F.col("p.qh") == F.col("q.home")) & (F.col("p.block") <= F.col("q.block")))
    pairs = written(pairs.select(F.col("p.block").alias("x"), F.col("q.block").alias("y")))
    wide = min(n, max(TILES, -(-n // TILE)))  # tiles on a side; a block is copied to those that it meets, not to each block there
    tile = lambda c: F.floor(F.shiftright(c, 32) * wide / n).cast("int")
    tiles = pairs.select("x", "y", tile("x").alias("tx"), tile("y").alias("ty"))
    tiles = tiles.select(F.explode(F.array("x", "y")).alias("block"), "tx", "ty").distinct()
    both = part.select("block", "id", "v").join(tiles, "block").repartition(2 * wide * wide, "tx", "ty")

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        tx, ty = pdf["tx"].iloc[0], pdf["ty"].iloc[0]
        of = lambda b: (b >> 32) * wide // n
        blocks = {}
        for b, rows_ in pdf.groupby("block"):
            m = np.stack(rows_["v"]).astype(float)
            angles = placed(m)
            angles[np.isinf(angles)] = 0.0
            blocks[b] = rows_["id"].to_numpy(), m, np.linalg.norm(m, axis=1), angles, (angles.min(axis=0), angles.max(axis=0))
        out, met = [], 0
        for x, left in blocks.items():
            for y, right in blocks.items():
                if of(x) != tx or of(y) != ty or x > y or left[1].shape[1] != right[1].shape[1]:
                    continue
                p, q = left[:3], right[:3]
                if x != y:  # rows that lie within reach of the other block's ranges
                    fits = lambda one, other: ((one[3] >= other[4][0] - limit) & (one[3] <= other[4][1] + limit)).all(axis=1)
                    u, v = fits(left, right), fits(right, left)
                    p, q = [c[u] for c in p], [c[v] for c in q]
                k = len(p[0]) * len(q[0])
                met += k if x != y else k // 2
                if k:
                    s = p[1] @ q[1].T / np.maximum(p[2][:, None] * q[2][None, :], 1e-300)
                    i, j = np.nonzero(s >= threshold - 5e-5)
                    a, b = p[0][i], q[0][j]
                    ok = a < b if x == y else a != b
                    out.append(pd.DataFrame({"a": np.minimum(a, b)[ok], "b": np.maximum(a, b)[ok], "similarity": np.round(s[i, j][ok], 4)}))
        got = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "similarity": []})
        got = got[got["similarity"] >= threshold].assign(met=0)
        return pd.concat([pd.DataFrame({"a": [-1], "b": [-1], "similarity": [0.0], "met": [met]}), got])

    found = written(both.groupBy("tx", "ty").applyInPandas(product, "a long, b long, similarity double, met long"))
    if report is not None:
        report["compared"], report["copies"] = found.agg(F.sum("met")).first()[0], both.count()
    discard(part, shelf, pairs)
    return found.where("met = 0 and a <> b").select("a", "b", "similarity")


def _angles(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def far_apart(v: np.ndarray, n: int) -> np.ndarray:
    """At most n unit vectors of v, each the farthest from those before it."""
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    chosen = [0]
    near = unit @ unit[0]
    while len(chosen) < min(n, len(unit)):
        k = int(near.argmin())
        if near[k] > 1 - 1e-9:
            break
        chosen.append(k)
        near = np.maximum(near, unit @ unit[k])
    return unit[chosen]


def _merged(normed_: DataFrame, semantic: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the semantic pairs, (a, b, similarity, norm) those that share a keyword, once for each, and (a, b, similarity) the others."""
    a, b = normed_.select(F.col("post_id").alias("a"), "norm"), normed_.select(F.col("post_id").alias("b"), "norm")
    both = written(semantic.join(a, "a").join(b, ["b", "norm"]).select("a", "b", "similarity", "norm"))
    return both, semantic.join(both.select("a", "b").distinct(), ["a", "b"], "left_anti")


def cannibal(normed_: DataFrame, semantic: DataFrame, equity: DataFrame, threshold: float = SEMANTIC) -> DataFrame:
    """Keyword and semantic pairs merged: a, b, keyword, similarity, severity, equity of both, stronger. normed_: (post_id, norm), a table of
    distinct rows; semantic: pairs as overlap_pairs() has them. Posts bring their equity and the semantic partners of their keyword along, so
    the pairs of a keyword are neither shuffled nor joined."""
    both, only = _merged(normed_, semantic)
    e = equity.select(F.col("id").alias("post_id"), "equity")
    of = lambda side: e.select(F.col("post_id").alias(side), F.col("equity").alias(f"equity_{side}"))
    partners = both.groupBy(F.col("a").alias("post_id"), "norm").agg(F.collect_list("b").alias("met"))
    posts = written(normed_.join(e, "post_id", "left").join(partners, ["post_id", "norm"], "left"))
    shared = within(posts, "post_id", "norm").where(~F.coalesce(F.array_contains("p.met", F.col("q.post_id")), F.lit(False)))
    shared = shared.select(F.col("p.post_id").alias("a"), F.col("q.post_id").alias("b"), "norm", F.lit(None).cast("double").alias("similarity"), F.col("p.equity").alias("equity_a"), F.col("q.equity").alias("equity_b"))
    near = both.unionByName(only, allowMissingColumns=True).join(of("a"), "a", "left").join(of("b"), "b", "left")
    out = shared.unionByName(near).fillna(0.0, ["equity_a", "equity_b"])
    return out.select("a", "b", F.coalesce("norm", F.lit("")).alias("keyword"), "similarity", scoring.severity(F.col("norm").isNotNull(), F.col("similarity"), threshold).alias("severity"), "equity_a", "equity_b",
                      F.when(F.col("equity_a") >= F.col("equity_b"), F.col("a")).otherwise(F.col("b")).alias("stronger"))


def cannibal_counts(normed_: DataFrame, semantic: DataFrame, threshold: float = SEMANTIC) -> DataFrame:
    """(severity, n) of cannibal(): the pairs of a keyword are counted by its posts, and only semantic pairs are looked at one by one."""
    both, only = _merged(normed_, semantic)
    one = both.unionByName(only, allowMissingColumns=True).select(scoring.severity(F.col("norm").isNotNull(), F.col("similarity"), threshold).alias("severity")).groupBy("severity").agg(F.count("*").alias("n"))
    alone = scoring.severity(F.lit(True), F.lit(None).cast("double"), threshold).alias("severity")
    shared = normed_.groupBy("norm").agg(F.count("*").alias("k")).select(alone, F.expr("k * (k - 1) div 2").alias("n"))
    every = shared.unionByName(one).unionByName(both.select("a", "b", "norm").distinct().agg((-F.count("*")).alias("n")).select(alone, "n"))
    return every.groupBy("severity").agg(F.sum("n").alias("n")).where("n > 0")


def stale(posts: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """Posts whose text has no embedding of this model yet: (id, hash, text), at most 8000 characters of text."""
    hash_ = F.md5(F.concat_ws("|", F.lit(model), "title", "content"))
    now = posts.select("id", hash_.alias("hash"), F.substring(F.concat(F.col("title"), F.lit("\n\n"), text.plain_text(F.col("content"))), 1, 8000).alias("text"))
    return now.join(stored.select("id", "hash"), ["id", "hash"], "left_anti")


def embed(rows: DataFrame, provider) -> DataFrame:
    """Vectors from an injected provider (a function of a list of texts), a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "hash": b["hash"], "embedding": provider(list(b["text"]))})

    return rows.mapInPandas(run, "id long, hash string, embedding array<float>")


def index_status(posts: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    hash_ = F.md5(F.concat_ws("|", F.lit(model), "title", "content"))
    now = posts.select("id", hash_.alias("hash")).join(stored.select("id", F.col("hash").alias("old")), "id", "left")
    return now.agg(F.count("*").alias("total"), F.count_if(F.col("hash") == F.col("old")).alias("done"), F.count_if(F.col("old").isNotNull() & (F.col("hash") != F.col("old"))).alias("stale"))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack_vector(s: pd.Series) -> pd.Series:
    """Vectors from base64 of little-endian float32; bad ones are null."""
    import base64

    def one(x):
        try:
            return np.frombuffer(base64.b64decode(x, validate=True), "<f4").tolist()
        except (ValueError, TypeError):
            return None

    return s.map(one)


@F.pandas_udf(T.StringType())
def pack_vector(s: pd.Series) -> pd.Series:
    import base64

    return s.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode())
