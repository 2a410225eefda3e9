"""Joins in cells, and the queries that make pairs of them."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import keywords as K
from linkloom.operators import pairs
from linkloom.operators import suggest as S
from linkloom.sources.scratch import written


@pytest.mark.parametrize("cell", [1, 3, 1000])
def test_cells_equal_a_join(spark, cell):
    r = random.Random(4)
    a = spark.createDataFrame([(r.choice("aaaaabc"), k) for k in range(40)] + [(None, 50), ("z", 51)], "g string, l long")
    b = spark.createDataFrame([(r.choice("aaabbd"), k) for k in range(30)] + [(None, 50), ("b", 3), ("b", 3)], "g string, r long")
    got = sorted(map(tuple, pairs.meet(a, b, "g", cell).select("g", "l", "r").collect()))
    assert got == sorted(map(tuple, a.join(b, "g").select("g", "l", "r").collect())) and len(got) > 200
    got = sorted(map(tuple, pairs.within(a, "l", "g", cell).select("g", "p.l", "q.l").collect()))
    other = a.select("g", F.col("l").alias("m"))
    assert got == sorted(map(tuple, a.join(other, "g").where("l < m").select("g", "l", "m").collect())) and len(got) > 100


def _merge(spark):
    normed = [(i, f"k{i % 3}") for i in range(1, 13)] + [(2, "k1"), (5, "k1")]
    semantic = [(1, 4, 0.9), (1, 2, 0.95), (2, 5, 0.99), (3, 6, 0.41), (7, 8, 0.7), (20, 21, 0.8), (2, 20, 0.9), (2, 5, 0.5)]  # an id that occurs twice gives two rows
    normed = sorted(set(normed))
    rows = []
    for i, n in normed:
        for j, m in normed:
            if n == m and i < j:
                rows += [(i, j, n, s) for a, b, s in semantic if (a, b) == (i, j)] or [(i, j, n, None)]
    shared = {(a, b) for a, b, *_ in rows}
    rows += [(a, b, "", s) for a, b, s in semantic if (a, b) not in shared]
    equity = {i: i * 7 % 5 / 4 for i in range(1, 11)}
    level = lambda n, s: ("direct" if s is not None and s >= 0.86 else "keyword") if n else "overlap"
    want = [(a, b, n, s, level(n, s), equity.get(a, 0.0), equity.get(b, 0.0), a if equity.get(a, 0.0) >= equity.get(b, 0.0) else b) for a, b, n, s in rows]
    return (written(spark.createDataFrame(normed, "post_id long, norm string")), written(spark.createDataFrame(semantic, "a long, b long, similarity double")),
            spark.createDataFrame(list(equity.items()), "id long, equity double"), want)


@pytest.mark.parametrize("cell", [2, 2048])
def test_merged_pairs_equal_brute_force_and_are_not_shuffled(spark, cell, monkeypatch):
    monkeypatch.setattr(pairs.within, "__defaults__", (cell,))
    normed, semantic, equity, want = _merge(spark)
    df = K.cannibal(normed, semantic, equity)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key) and {r[4] for r in want} == {"direct", "keyword", "overlap"}
    assert "FullOuter" not in df._jdf.queryExecution().optimizedPlan().toString()  # the pairs of a keyword met the semantic ones by a shuffle of both


def test_counts_equal_the_pairs_without_making_them(spark, monkeypatch):
    normed, semantic, equity, want = _merge(spark)
    monkeypatch.setattr(K, "within", lambda *_: pytest.fail("pairs"))
    got = dict(map(tuple, K.cannibal_counts(normed, semantic).collect()))
    assert got == {x: sum(r[4] == x for r in want) for x in ("direct", "keyword", "overlap")}
    none = semantic.where("false")
    assert dict(map(tuple, K.cannibal_counts(normed, none).collect())) == {"keyword": sum(1 for r in {(r[0], r[1], r[2]) for r in want if r[2]})}


@pytest.mark.parametrize("keys", [1, 250_000])
def test_keyword_opportunities_equal_brute_force_and_do_not_shuffle_pairs(spark, keys):
    words = "burr grinder kettle espresso beans Coffee filter".split()
    r = random.Random(6)
    body = {i: " ".join(r.choice(words) for _ in range(12)) + ("" if i % 4 else " <a href='/x'>kettle beans</a>") for i in range(1, 25)}
    named = {i: " ".join(r.sample(words, 1 + i % 2)) if i % 7 else "!!" for i in body}
    links = [(a, b) for a in body for b in body if (a * b) % 5 == 0]
    posts = spark.createDataFrame(list(body.items()), "id long, content string")
    targets = spark.createDataFrame(list(named.items()), "target long, keyword string")
    df = S.keyword_opportunities(targets, posts, spark.createDataFrame(links, "src long, target long"), keys)
    text = {i: f" {t.split(' <a')[0]} " for i, t in body.items()}
    want = {(a, b) for a in body for b, n in named.items() if a != b and (a, b) not in links and f" {n.lower()} " in text[a].lower()}
    got = df.collect()
    assert {(x["post_id"], x["target"]) for x in got} == want and len(got) == len(want) > 40
    assert all(x["phrase"].lower() == x["keyword"].lower() and f" {x['phrase']} " in text[x["post_id"]] for x in got)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 3 and "LeftAnti" not in plan  # pairs come of the last join


def test_blocks_are_copied_to_tiles_not_to_each_other(spark):
    import numpy as np

    r = np.random.default_rng(5)
    v = r.normal(size=(640, 8)).astype("float32")
    rows = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<float>")
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    s = unit @ unit.T
    want = {(i, j) for i, j in zip(*np.nonzero(np.round(s, 4) >= 0.8)) if i < j}
    seen = {}
    got = K.overlap_pairs(rows, 0.8, block=16, report=seen).collect()
    assert {(x["a"], x["b"]) for x in got} == want and len(got) == len(want) > 100 and seen["compared"] <= 640 * 639 // 2
    assert seen["copies"] <= 640 * K.TILES  # some 40 blocks each met 40
