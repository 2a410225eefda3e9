"""Answers of a remote service, asked for once: batches from tasks, with a rate, retries and a table of what is known.

An answer is filed under a hash of the content and the model. Only rows whose hash has no answer are sent; a rerun asks for what is new or
was refused. Each partition sends one batch after another, at most `rate` a second and partition, and tries a batch again after
growing pauses. A batch that fails for good gives no answers and is noted in an error log of the newest LOG entries, merged from
all tasks; an entry has the batch's own key, so a task that runs twice is noted once.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import AccumulatorParam
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkloom.sources.scratch import discard, written
from linkloom.sources.stored import StoredTable

LOG = 25
ANSWER = "hash string, model string, answer string, asked_at double"
ERROR = "key string, at double, message string"


class Newest(AccumulatorParam):
    """A dictionary of the newest LOG entries: key to (time, message)."""

    def zero(self, value):
        return {}

    def addInPlace(self, a, b):
        out = dict(a)
        for k, v in b.items():
            if k not in out or v[0] < out[k][0]:  # the same event again: it happened when it was first seen
                out[k] = v
        return dict(sorted(out.items(), key=lambda x: (-x[1][0], x[0]))[:LOG])


def content_hash(model: str, content: Column) -> Column:
    return F.sha2(F.concat(F.lit(model + "\n"), content), 256)


def ask(rows: DataFrame, known: StoredTable, errors: StoredTable, provider: Callable[[list[str]], list], model: str, batch: int = 16, rate: float | None = None, tries: int = 3, pause: float = 1.0) -> DataFrame:
    """rows (id, content) with answer (JSON; null where there is none yet). provider: from a list of contents to a list of answers, which are
    kept as JSON. known and errors: tables of ANSWER and ERROR; both are brought up to date. Null contents are not asked about."""
    spark = rows.sparkSession
    hashed = rows.withColumn("hash", content_hash(model, F.col("content")))
    new = hashed.where("content is not null").groupBy("hash").agg(F.min("content").alias("content")).join(known.read().where(F.col("model") == model).select("hash"), "hash", "left_anti")
    log = spark.sparkContext.accumulator({}, Newest())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for f in frames:
            for s in range(0, len(f), batch):
                part = f[s : s + batch]
                for k in range(tries):
                    if rate:
                        time.sleep(max(0.0, last + 1 / rate - time.monotonic()))
                    last = time.monotonic()
                    try:
                        got = provider(list(part["content"]))
                        if len(got) != len(part):
                            raise ValueError(f"{len(got)} answers to {len(part)} contents")
                        yield pd.DataFrame({"hash": part["hash"], "answer": [json.dumps(x, ensure_ascii=False, sort_keys=True) for x in got]})
                        break
                    except Exception as e:  # noqa: BLE001  whatever a service does wrong
                        if k + 1 == tries:
                            log.add({f"{model}:{part['hash'].iloc[0]}": (time.time(), f"{type(e).__name__}: {e}"[:500])})
                        else:
                            time.sleep(pause * 2**k)

    got = new.mapInPandas(run, "hash string, answer string").select("hash", F.lit(model).alias("model"), "answer", F.lit(time.time()).alias("asked_at"))
    got = written(got)  # asked once, and read twice below
    known.upsert(got, ["hash", "model"])
    discard(got)
    note(errors, log.value)
    return hashed.join(known.read().where(F.col("model") == model).select("hash", "answer"), "hash", "left").drop("hash")


def note(errors: StoredTable, entries: dict) -> None:
    """Adds entries to the log, of which the newest LOG stay."""
    if entries:
        rows = errors.spark.createDataFrame([(k, float(t), m) for k, (t, m) in entries.items()], ERROR)
        both = errors.read().unionByName(rows).groupBy("key").agg(F.max(F.struct("at", "message")).alias("x")).select("key", "x.*")
        errors.load(both.orderBy(F.col("at").desc(), "key").limit(LOG))


def forget(known: StoredTable, model: str | None = None) -> None:
    """Clears the answers, of one model or all."""
    known.load(known.read().where("false") if model is None else known.read().where(F.col("model") != model))


def keywords_of(answers: DataFrame, most: int = 5) -> DataFrame:
    """(post_id, keyword, place): the keywords a model extracted; answers: id, answer (a JSON list of strings). Blank and repeated ones
    (case apart) are left out, at most `most` a post."""
    each = answers.select(F.col("id").alias("post_id"), F.posexplode(F.from_json("answer", "array<string>")).alias("at", "raw"))
    clean = each.withColumn("keyword", F.regexp_replace(F.trim("raw"), r"\s+", " ")).where("keyword <> ''")
    first = clean.groupBy("post_id", F.lower("keyword").alias("low")).agg(F.min(F.struct("at", "keyword")).alias("x"))
    place = F.row_number().over(W.partitionBy("post_id").orderBy("x.at"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("post_id", "x.keyword", "place")


def suggestions_of(answers: DataFrame) -> DataFrame:
    """(src, phrase, target, match, reason) as suggest.llm_answers() takes them; answers: id, answer (a JSON list of objects)."""
    form = "array<struct<phrase:string,target:long,match:int,reason:string>>"
    return answers.select(F.col("id").alias("src"), F.explode(F.from_json("answer", form)).alias("x")).select("src", "x.phrase", "x.target", "x.match", "x.reason").where("phrase is not null and target is not null")
