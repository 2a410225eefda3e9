"""Stored tables, cached results, recorded answers and the error log."""

import json
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkloom.operators import suggest
from linkloom.sources import answers as A
from linkloom.sources.stored import StoredTable, cached, drop_cached


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_loads_replace_and_failed_ones_change_nothing(spark, tmp_path):
    t = StoredTable(spark, f"{tmp_path}/t", "k long, v string, on boolean")
    frame = lambda x: spark.createDataFrame(x, "k long, v string, on boolean")
    assert t.version() is None and t.read().count() == 0
    t.load(frame([(1, "a", True), (2, None, None), (2, None, None)]))
    first = t.version()
    reader = t.read()
    t.load(frame([(5, "b", False)]).withColumn("more", F.lit(1)))
    assert rows(t.read()) == {(5, "b", False): 1} and rows(reader) == {(1, "a", True): 1, (2, None, None): 2}  # a reader that had begun
    second = t.version()
    with pytest.raises(Exception):
        t.load(frame([(1, "a", True)]).withColumn("v", F.raise_error(F.lit("lost"))))
    assert t.version() == second and rows(t.read()) == {(5, "b", False): 1} and second != first
    assert sorted(n for n in os.listdir(f"{tmp_path}/t") if n.startswith("v-")) == sorted([first, second])
    t.load(frame([]))
    assert t.read().count() == 0 and len([n for n in os.listdir(f"{tmp_path}/t") if n.startswith("v-")]) == 2


def test_edits(spark, tmp_path):
    t = StoredTable(spark, f"{tmp_path}/t", "k long, v string, on boolean")
    t.load(spark.createDataFrame([(k, f"v{k}", False) for k in range(6)], "k long, v string, on boolean"))
    t.upsert(spark.createDataFrame([(2, "new", True), (9, "more", None)], "k long, v string, on boolean"), ["k"])
    t.remove(spark.createDataFrame([(4,), (4,), (77,)], "k long"))
    t.flag(spark.createDataFrame([(0,), (0,)], "k long"), "on", True)
    assert rows(t.read()) == {(0, "v0", True): 1, (1, "v1", False): 1, (2, "new", True): 1, (3, "v3", False): 1, (5, "v5", False): 1, (9, "more", None): 1}


def test_a_cached_result_is_computed_once_until_a_file_changes(spark, tmp_path):
    src, made = f"{tmp_path}/in", []
    spark.range(10).write.parquet(src)

    def compute():
        made.append(1)
        return spark.read.parquet(src).agg(F.sum("id").alias("s"))

    get = lambda **k: cached(spark, f"{tmp_path}/c", "sum", [src], compute, **k).first()["s"]
    assert (get(), get(), len(made)) == (45, 45, 1)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assert jobs is not None
    spark.range(10, 12).write.mode("append").parquet(src)
    assert (get(), get(), len(made)) == (66, 66, 2)
    assert get(asked="other") == 66 and len(made) == 3
    assert get(asked="other", max_age=0.0) == 66 and len(made) == 4
    drop_cached(spark, f"{tmp_path}/c", "sum")
    assert get(asked="other") == 66 and len(made) == 5 and len(os.listdir(f"{tmp_path}/c/sum")) == 1


def test_answers_are_asked_for_once_and_failures_are_noted_once(spark, tmp_path):
    known, errors = StoredTable(spark, f"{tmp_path}/k", A.ANSWER), StoredTable(spark, f"{tmp_path}/e", A.ERROR)
    log = f"{tmp_path}/calls"

    def provider(texts):
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        if "bad" in texts:
            raise TimeoutError("no answer")
        return [[t.split()[0], t.upper()] for t in texts]

    table = lambda x: spark.createDataFrame(x, "id long, content string").coalesce(1)
    ask = lambda x, model="m": {r["id"]: r["answer"] and json.loads(r["answer"]) for r in A.ask(table(x), known, errors, provider, model, batch=1, rate=1000, tries=2, pause=0.0).collect()}
    first = [(1, "one two"), (2, "one two"), (3, "three"), (4, None), (5, "bad")]
    assert ask(first) == {1: ["one", "ONE TWO"], 2: ["one", "ONE TWO"], 3: ["three", "THREE"], 4: None, 5: None}
    calls = lambda: Counter(open(log).read().split("\n")[:-1])
    assert calls() == {"one two": 1, "three": 1, "bad": 2}  # equal contents once, a failing one as often as it is tried
    assert ask(first[:4] + [(6, "six")])[6] == ["six", "SIX"] and calls() == {"one two": 1, "three": 1, "bad": 2, "six": 1}
    assert ask([(1, "one two")], "other")[1] and calls()["one two"] == 2
    assert [r["message"] for r in errors.read().collect()] == ["TimeoutError: no answer"]
    ask(first)
    assert errors.read().count() == 1 and calls()["bad"] == 4  # tried again, noted under the same key
    A.forget(known, "m")
    assert {r["model"] for r in known.read().collect()} == {"other"}
    A.forget(known)
    assert known.read().count() == 0


def test_the_log_keeps_the_newest_and_counts_repeated_tasks_once(spark, tmp_path):
    n = A.Newest()
    all_ = {f"k{i}": (float(i), "x") for i in range(60)}
    parts = [{k: v for k, v in all_.items() if int(k[1:]) % 7 == m} for m in range(7)]
    a = n.zero({})
    for p in parts + parts[:3]:
        a = n.addInPlace(a, p)
    b = n.zero({})
    for p in reversed(parts):
        b = n.addInPlace(n.addInPlace({}, p), b)
    assert a == b == dict(sorted(all_.items(), key=lambda x: -x[1][0])[:25])
    t = StoredTable(spark, f"{tmp_path}/e", A.ERROR)
    A.note(t, a)
    A.note(t, {"late": (99.0, "y"), "k59": (59.0, "x")})
    got = t.read().collect()
    assert len(got) == 25 and {"late", "k59"} <= {r["key"] for r in got} and "k35" not in {r["key"] for r in got}


def test_extracted_keywords(spark):
    said = [(1, '["Coffee", " coffee ", "", "Burr  grinder", "a", "b", "c", "d"]'), (2, "[]"), (3, "not json"), (4, None), (5, '[null, "x"]')]
    got = sorted(map(tuple, A.keywords_of(spark.createDataFrame(said, "id long, answer string"), 4).collect()))
    assert got == [(1, "Burr grinder", 2), (1, "Coffee", 1), (1, "a", 3), (1, "b", 4), (5, "x", 1)]


def test_suggestions_of_a_model_against_brute_force(spark):
    r = random.Random(3)
    words = "burr grinder kettle café espresso roast".split()
    posts = [(k, "t", f"<p>{' '.join(r.choices(words + ['<a href=x>kettle</a>', 'Kettle', 'roasting'], k=12))}</p>", "") for k in range(1, 25)] + [(90, "t", None, "")]
    said = {k: [{"phrase": r.choice(words + ["roast", "absent"]), "target": r.choice([*range(1, 25), 500]), "match": r.randrange(30, 101), "reason": "x"} for _ in range(9)] for k, *_ in posts}
    linked, rejected = {(k, k % 24 + 1) for k in range(1, 25)}, {(k, (k * 5) % 24 + 1) for k in range(1, 25)}
    plain = lambda c: re.sub(r"\s+", " ", re.sub(r"<[^>]*>", "", re.sub(r"(?is)<a\b[^>]*>.*?</a>", " ", c or ""))).strip()
    want = set()
    for k, _, c, _ in posts:
        best = {}
        for x in said[k]:
            m = re.search(rf"\b{re.escape(x['phrase'])}\b", plain(c), re.I)
            if m and x["target"] != k and x["target"] in {p[0] for p in posts} and (k, x["target"]) not in linked | rejected:
                key = (-x["match"], x["phrase"])
                if x["target"] not in best or key < best[x["target"]][0]:
                    best[x["target"]] = (key, m.group())
        ranked = sorted((key[0], t, g) for t, (key, g) in best.items() if -key[0] >= 50)[:5]
        want |= {(k, t, g, -m, n + 1) for n, (m, t, g) in enumerate(ranked)}
    pair = lambda x: spark.createDataFrame(sorted(x), "src long, target long")
    answers = A.suggestions_of(spark.createDataFrame([(k, json.dumps(v)) for k, v in said.items()] + [(91, None)], "id long, answer string"))
    got = suggest.llm_answers(answers, spark.createDataFrame(posts, "id long, title string, content string, keyword string"), pair(linked), pair(rejected))
    assert {(x["src"], x["target"], x["phrase"], x["match"], x["rank"]) for x in got.collect()} == want and len(want) > 20
