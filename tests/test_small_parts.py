"""Parts that no other test compares: link map files, embeddings by a provider, single inserts, the meter, reasons, repointing, external targets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from linkloom.functions import scoring
from linkloom.operators import corpus, keywords, suggest
from linkloom.operators import rewrite as X
from linkloom.sources import readers


def test_link_map_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text('﻿Keyword,URL\n" burr grinder ", /a \n,/none\nkettle,\n"comma, inside",https://x.example/?a=1\n')
    assert sorted(map(tuple, readers.read_link_map(spark, str(tmp_path / "m.csv")).collect())) == [("burr grinder", "/a"), ("comma, inside", "https://x.example/?a=1")]
    (tmp_path / "n.csv").write_text("kettle,/k\nscale,/s\n")  # no header: by place
    assert sorted(map(tuple, readers.read_link_map(spark, str(tmp_path / "n.csv")).collect())) == [("kettle", "/k"), ("scale", "/s")]


def test_embeddings_are_asked_for_what_is_stale(spark):
    posts = spark.createDataFrame([(1, "A", "<p>x</p>"), (2, "B", "y"), (3, "C", "z")], "id long, title string, content string")
    none = spark.createDataFrame([], "id long, hash string")
    first = keywords.embed(keywords.stale(posts, none, "m"), lambda texts: [[float(len(t)), 1.0] for t in texts]).cache()
    assert {r["id"]: list(r["embedding"]) for r in first.collect()} == {k: [4.0, 1.0] for k in (1, 2, 3)}  # title, blank line, text
    edited = posts.withColumn("content", F.when(F.col("id") == 2, "changed").otherwise(F.col("content")))
    assert [r["id"] for r in keywords.stale(edited, first, "m").collect()] == [2] and keywords.stale(posts, first, "other").count() == 3
    one = keywords.index_status(edited, first, "m").first()
    assert (one["total"], one["done"], one["stale"]) == (3, 2, 1)


def test_single_inserts(spark):
    posts = spark.createDataFrame([(1, "A Kettle and <a href='/x'>kettle</a>"), (2, "<b title='kettle'>none</b>"), (3, None), (4, "kettles")], "id long, content string")
    todo = spark.createDataFrame([(k, "kettle", "/k?a&b") for k in range(1, 6)], "id long, phrase string, url string")
    got = {r["id"]: r["after"] for r in X.insert_links(posts, todo).collect()}
    assert got == {1: "A " + X.anchor_html("kettle", "/k?a&b") + " and <a href='/x'>kettle</a>", 2: None, 3: None, 4: None}


def test_meter(spark):
    rows = [(80, 9.0, 0.8), (None, 9.0, 0.9), (None, None, 0.5), (140, None, 1.0), (-3, None, 0.0)]
    df = spark.createDataFrame(rows, "m int, s double, want double").withColumn("got", scoring.strength(F.col("m"), F.col("s")))
    assert all(r["got"] == pytest.approx(r["want"]) for r in df.collect())


def test_reasons_say_what_the_score_is_made_of(spark):
    rows = [("exact", None, 0.06, 0.06, 0.254, 1.0), ("partial", 0.61, 0.01, 0.61, 0.0, 0.5), ("title", None, 0.3, 0.3, 1.0, 0.0), ("salient", 0.25, 0.0, 0.25, 0.5, 0.0)]
    df = spark.createDataFrame(rows, "tier string, semantic double, lexical double, similarity double, overlap double, cluster double")
    tail = {"exact": "The anchor is the focus keyword.", "partial": "The anchor is part of the focus keyword.", "title": "The anchor is a phrase of the title.", "salient": "The anchor is a word of the title."}
    for r in suggest.explain(df).collect():
        shown = r["semantic"] if r["semantic"] is not None else min(1.0, r["lexical"] / 0.12)
        near = ", same cluster" if r["cluster"] == 1 else ", related cluster" if r["cluster"] > 0 else ""
        assert r["reason"] == f"Post similarity {shown:.2f}, keyword overlap {round(r['overlap'] * 100)}%{near}. {tail[r['tier']]}"


def test_repointing_changes_the_named_links_only(spark):
    r = random.Random(2)
    urls = ["/a", "/a/", "/b?x=1&y=2", "https://x.example/c", "/d", "/A"]
    link = lambda u: f"<a class='k' href={chr(34)}{u.replace('&', '&amp;')}{chr(34)} rel=n>t {u}</a>"
    posts = [(k, " and ".join(link(r.choice(urls)) for _ in range(r.randint(0, 6)))) for k in range(30)] + [(90, None)]
    moves = [(k, u, f"https://new.example{n}") for k in range(30) for n, u in enumerate(["/a", "/b?x=1&y=2", "/zzz"]) if r.random() < 0.7]
    df, jobs = spark.createDataFrame(posts[:-1], "id long, content string"), spark.createDataFrame(moves, "src long, url string, redirects_to string")
    got = {x["id"]: (x["after"], x["n"]) for x in X.repoint(df, jobs).collect()}
    fold = lambda u: u.strip().lower().rstrip("/")
    for k, c in posts[:-1]:
        mine = {fold(u): to for i, u, to in moves if i == k}
        hrefs = [u.replace("&amp;", "&") for u in re.findall(r'href="([^"]*)"', c)]
        if mine:
            want = [mine.get(fold(u), u) for u in hrefs]
            after, n = got[k]
            assert [u.replace("&amp;", "&") for u in re.findall(r'href="([^"]*)"', after)] == want
            assert n == sum(fold(u) in mine for u in hrefs) and re.sub(r'href="[^"]*"', "", after) == re.sub(r'href="[^"]*"', "", c)
        else:
            assert k not in got


def test_external_targets_need_a_title_that_stands_in_the_text(spark):
    posts = spark.createDataFrame([(1, "P", "Read about burr grinders and water. Coffee coffee.", ""), (2, "Q", "coffee water", ""), (3, "R", "<a href='/x'>kettle</a> coffee", "")], "id long, title string, content string, keyword string")
    pages = spark.createDataFrame([(11, "Burr Grinder"), (12, "Coffee"), (13, "Espresso machines"), (14, "")], "id long, title string")
    df = corpus.document_frequency(posts)
    got = {(r["src"], r["target"], r["anchor"], r["confidence"], r["match"]) for r in suggest.fixed_targets(posts, pages, "external", df, 3).collect()}
    assert got == {(1, 11, "burr grinders", 0.4, 40), (1, 12, "Coffee", 0.4, 40), (2, 12, "coffee", 0.4, 40), (3, 12, "coffee", 0.4, 40)}
