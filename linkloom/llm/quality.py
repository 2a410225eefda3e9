"""Quality by hierarchical empirical Bayes: a document's evidence joined with its host's and path's record.

Evidence: two logistic regressions (good quality, toxic) over the words, word beginnings, punctuation runs
and shape of a whole text, fitted on at most TRAIN_ROWS labelled documents (a documented bound; all
else covers all rows). Sites: the mean of all documents' evidence per host and per (host, path), by grouped
aggregation, with labels in place of evidence where there are any. Each host is shrunk towards the global mean
and each path towards its host, with strengths estimated from the spread between hosts and between paths, so
sparse sites say little. A document's posterior odds are its likelihood ratio times the prior odds of its
site, from which its own evidence is left out: of its path's, its host's and the global sum. (The two strengths are
moments over all sites and the same for all documents.)
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, drop_rejected, join_checked, materialize, null_mark

TRAIN_ROWS = 8000
FEATURES = 500  # kept for each of the two regressions, by their G statistic: held-out error rises again beyond
MIN_DOCS = 4  # labelled documents that a feature must be in
PIECE = 1 << 21  # characters of a long text taken at a time

_WORD = re.compile(r"[^\W\d_]+")
_MARK = re.compile(r"[^\w\s]+")
_LOUD = re.compile(r"\b[^\W\d_a-z]{3,}\b")


def _pieces(text: str) -> Iterator[str]:
    """Pieces of PIECE characters or more, cut at white space."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def features(text: str | None) -> list[str]:
    """The set of a text's features."""
    out: set[str] = set()
    words = marks = loud = twice = 0
    seen: set[str] = set()
    text = text or ""
    for part in _pieces(text):
        low = part.lower()
        got, mark = _WORD.findall(low), _MARK.findall(low)
        seen.update(got)
        words += len(got)
        marks += len(mark)
        loud += len(_LOUD.findall(part))
        twice += sum(map(str.__eq__, got, got[1:]))
        out.update(f"m:{x[:4]}" for x in set(mark))
    out.update(seen)
    out.update(f"^{w[:4]}" for w in seen)
    out.update(f"^{w[:5]}" for w in seen)
    n = max(words, 1)
    for name, x in (("marks", marks / n), ("loud", loud / n), ("twice", twice / n), ("fresh", len(seen) / n)):
        out.add(f"s:{name}:{min(10, int(10 * x))}")
    out.add(f"s:long:{int(math.log2(n))}")
    return list(out)


def _gain(ids: np.ndarray, rows: np.ndarray, y: np.ndarray, v: int) -> np.ndarray:
    """G statistic of each feature against a label."""
    n, n1 = len(y), float(y.sum())
    df = np.bincount(ids, minlength=v).astype(float)
    a = np.bincount(ids, weights=y[rows], minlength=v)
    g = np.zeros(v)
    for o, e in ((a, df * n1 / n), (df - a, df * (n - n1) / n), (n1 - a, (n - df) * n1 / n), (n - df - n1 + a, (n - df) * (n - n1) / n)):
        g += 2 * np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0)
    return g


def fit_logistic(ids: np.ndarray, rows: np.ndarray, y: np.ndarray, v: int, l2: float = 2e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias over binary features, by Adam over the full batch."""
    n = len(y)
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    w = np.zeros(v + 1)
    w[v] = math.log(mean / (1 - mean))
    m, s = np.zeros(v + 1), np.zeros(v + 1)
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=w[ids], minlength=n) + w[v]
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.append(np.bincount(ids, weights=err[rows], minlength=v), err.sum()) / n + l2 * w
        g[v] -= l2 * w[v]
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w[:v], float(w[v])


class Model:
    """Feature weights of both regressions; good(text) is the chance of good quality and no toxicity."""

    def __init__(self, weights: dict[str, tuple[float, float]], bias: tuple[float, float], prior: float):
        self.weights, self.bias, self.prior = weights, bias, prior

    def good(self, text: str | None) -> float:
        q, t = self.bias
        for f in self.weights.keys() & features(text):
            a, b = self.weights[f]
            q, t = q + a, t + b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, q)))) / (1 + math.exp(max(-30.0, min(30.0, t))))


def labelled(labels: DataFrame, label_id: str = "doc_id") -> DataFrame:
    """(l_id, quality, toxic) of usable labels, one per id (the worst of repeated ones)."""
    ok = labels.where(F.col(f"`{label_id}`").isNotNull() & F.col("quality").isNotNull())
    return ok.groupBy(F.col(f"`{label_id}`").cast("long").alias("l_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"), F.max(F.coalesce(F.col("toxic").cast("int"), F.lit(0))).alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    """Fits on at most about train_rows labelled documents, chosen by a hash of the id."""
    known = labelled(labels)
    n = known.count()
    part = F.pmod(F.xxhash64("l_id", F.lit("train")), F.lit(1 << 40)) < int((1 << 40) * min(1.0, train_rows / max(n, 1)))
    chosen = materialize(known.where(part).limit(2 * train_rows), "chosen")
    text = docs.select(F.col(f"`{id_col}`").cast("long").alias("l_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = text.join(F.broadcast(chosen), "l_id").select("quality", "toxic", "text")  # 2 * train_rows rows at most

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 200):
                c = b.slice(s, 200)
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array([features(x.as_py()) for x in c.column(2)], pa.list_(pa.string()))], names=["quality", "toxic", "f"])

    train = materialize(rows.mapInArrow(spell, "quality int, toxic int, f array<string>"), "train")
    vocab = [r["f"] for r in train.select(F.explode("f").alias("f")).groupBy("f").count().where(F.col("count") >= MIN_DOCS).select("f").collect()]  # bounded by the sample
    vocab.sort()
    index = {f: i for i, f in enumerate(vocab)}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.array([index[f] for f in x.as_py() if f in index], np.int32).tobytes() for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], names=["quality", "toxic", "f"])

    got = train.mapInArrow(number, "quality int, toxic int, f binary").collect()
    discard(train)
    discard(chosen)
    if not got or not vocab:
        return Model({}, (2.0, -4.0), 0.85)
    got.sort(key=lambda r: (r["f"], r["quality"], r["toxic"]))
    lists = [np.frombuffer(r["f"], np.int32) for r in got]
    ids, row = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    weights: dict[str, list[float]] = {}
    bias = []
    ys = [np.array([r["quality"] for r in got], float), np.array([r["toxic"] for r in got], float)]
    for h, y in enumerate(ys):
        best = np.sort(np.argsort(-_gain(ids, row, y, len(vocab)), kind="stable")[:FEATURES])
        place = np.full(len(vocab), -1)
        place[best] = np.arange(len(best))
        use = place[ids] >= 0
        w, b = fit_logistic(place[ids[use]], row[use], y, len(best))
        bias.append(b)
        for i, x in zip(best, w):
            weights.setdefault(vocab[i], [0.0, 0.0])[h] = float(x)
    prior = float(np.mean(ys[0] * (1 - ys[1])))
    return Model({k: (a, b) for k, (a, b) in weights.items()}, (bias[0], bias[1]), min(max(prior, 0.01), 0.99))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: str, total: str, n: str) -> float:
    """Pseudo-count of a beta prior by moments: how much groups differ from `mean` beyond chance."""
    m = F.greatest(F.least(F.col(mean), F.lit(0.999)), F.lit(0.001))
    rate = F.col(total) / F.col(n)
    r = groups.where(f"{n} > 1").agg(F.avg((rate - m) ** 2 / (m * (1 - m))).alias("d"), F.avg(1 / F.col(n)).alias("c")).first()
    if r["d"] is None:
        return 50.0
    between = max(r["d"] - r["c"], 1e-4)
    return min(max(1 / between - 1, 5.0), 5000.0)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
          threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, evidence, site, posterior, keep) per input row.

    Defined cases: a null text has no words; null hosts and paths are hosts and paths; rows that repeat an id are
    scored each by its text; labels without a document or with null quality are left out; without any labels all
    evidence is a fixed prior and all rows are kept; an empty table gives no rows.
    """
    return _score(docs, labels, id_col, text_col, host_col, path_col, threshold, train_rows)


def _score(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str, threshold: float, train_rows: int = TRAIN_ROWS,
           mark: Column | None = None) -> DataFrame:
    """score(), and the string column `mark` of docs if it is given."""
    model = fit(docs, labels, id_col, text_col, train_rows)
    extra = [] if mark is None else ["mark"]
    names = ["doc_id", "host", "path", "evidence", *extra]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [model.good(x.as_py()) for x in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(p, pa.float64()), *b.columns[4:]], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{host_col}`").cast("string").alias("host"), F.col(f"`{path_col}`").cast("string").alias("path"), F.col(f"`{text_col}`").cast("string").alias("text"),
                       *([] if mark is None else [mark.alias("mark")]))
    seen = materialize(rows.mapInArrow(judge, f"doc_id {kind}, host string, path string, evidence double" + "".join(f", {c} string" for c in extra)), "evidence")
    known = labelled(labels).select("l_id", (F.col("quality") * (1 - F.col("toxic"))).cast("double").alias("label"))
    told = materialize(seen.join(known, F.expr("cast(doc_id as bigint) = l_id"), "left").select(*names, F.coalesce("label", "evidence").alias("e")), "told")
    discard(seen)
    paths = materialize(told.groupBy("host", "path").agg(F.sum("e").alias("pe"), F.count("*").alias("pn")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("pe").alias("he"), F.sum("pn").alias("hn"))
    all_ = hosts.agg(F.sum("he").alias("e"), F.sum("hn").alias("n")).first()
    mean = (all_["e"] / all_["n"]) if all_["n"] else model.prior
    k1 = _strength(hosts.withColumn("m", F.lit(mean)), "m", "he", "hn")
    shrunk = hosts.withColumn("hm", (F.lit(k1 * mean) + F.col("he")) / (k1 + F.col("hn"))).select(F.col("host").alias("h_"), "hm", "he", "hn")
    both = materialize(paths.join(shrunk, F.expr("host <=> h_")).select(F.col("host").alias("h_"), F.col("path").alias("p_"), "pe", "pn", "hm", "he", "hn"), "sites")
    k2 = _strength(both, "hm", "pe", "pn")
    j = join_checked(told, both, F.expr("host <=> h_ and path <=> p_"), "inner", 144)
    e = F.col("e")
    others = (F.lit(float(all_["e"] or 0.0)) - e) / (all_["n"] - 1) if (all_["n"] or 0) > 1 else F.lit(model.prior)
    host = (k1 * others + F.col("he") - e) / (k1 + F.col("hn") - 1)
    site = (k2 * host + F.col("pe") - e) / (k2 + F.col("pn") - 1)
    odds = _logit(F.col("evidence")) - F.lit(math.log(model.prior / (1 - model.prior))) + _logit(F.col("site"))
    out = j.withColumn("site", site).withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return out.select("doc_id", F.round("evidence", 6).alias("evidence"), F.round("site", 6).alias("site"), F.round("posterior", 6).alias("posterior"), (F.col("posterior") >= threshold).alias("keep"), *extra)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, with all their columns; rows that share an id go together, rows with a
    null id are judged one by one."""
    mark = null_mark(*[F.col(f"`{c}`") for c in (id_col, text_col, host_col, path_col)])
    bad = _score(docs, labels, id_col, text_col, host_col, path_col, threshold, mark=mark).where("not keep")
    return drop_rejected(docs, materialize(bad.select(F.col("doc_id").alias("id"), "mark").distinct(), "rejected"), id_col, mark)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
