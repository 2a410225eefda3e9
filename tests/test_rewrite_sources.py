"""Rewrites, imports, suggestions, click throttling."""

import json
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.operators import rewrite as X
from linkloom.operators import suggest as S
from linkloom.sources import readers, sinks
from linkloom.streaming import clicks as K


@pytest.mark.parametrize("content,phrase,want", [
    ("<p>burr grinder and burr grinder</p>", "Burr Grinder", "<p>[X] and burr grinder</p>"),
    ('<a href="/x">burr grinder</a> then burr grinder', "burr grinder", '<a href="/x">burr grinder</a> then [X]'),
    ('<img alt="burr grinder"> text', "burr grinder", None),
    ("burrgrinder", "burr", None), ("café au lait", "café", "[X] au lait"), ("a $1 b", "b", "a $1 [X]"), ("", "x", None), ("x", "", None),
])
def test_first_outside_tags(content, phrase, want):
    assert X.first_outside_tags(content, phrase, "[X]") == want


@given(st.text(alphabet="ab <>/\"=href", max_size=60))
@settings(max_examples=200, deadline=None)
def test_rewriting_never_nests_links(s):
    out, _ = X.outside_tags(s + " ab", X.Rule(1, "ab", "u").pattern(), lambda m: X.anchor_html(m.group(), "u"), 9)
    depth = 0
    for tag in X._TAG.findall(out):
        if 'data-auto="1"' in tag:
            assert depth == 0
        depth = 1 if X._OPEN.match(tag) else 0 if X._CLOSE.match(tag) else depth


def test_rules_apply_in_order_and_skip_their_target():
    rules = [X.Rule(3, "burr grinder", "/bg"), X.Rule(2, "grinder", "/g", max_per_post=2), X.Rule(1, "grinder", "/self", target=7, active=False)]
    pats = {r.id: r.pattern() for r in rules}
    out, n = X.apply_rules(5, "burr grinder, grinder, grinder, grinder", rules, pats)
    assert n == {3: 1, 2: 2, 1: 1} and out.count("/bg") == 1 and out.count('"/g"') == 2
    assert X.apply_rules(7, "grinder", rules, pats)[1] == {2: 1}


def test_rewrite_anchor_matches_the_whole_url():
    c = '<a href="/?p=99">a</a> <a href="/?p=999">b</a> <a class="k" href="/?P=99/"><i>c</i></a>'
    assert X.rewrite_anchor(c, "/?p=99", "", "replace", "/n?a&b")[1] == 2
    assert X.rewrite_anchor(c, "/?p=99", "C", "remove", "") == ('<a href="/?p=99">a</a> <a href="/?p=999">b</a> <i>c</i>', 1)
    assert "p=999" in X.rewrite_anchor(c, "/?p=99", "", "remove", "")[0]


def test_url_rewrite_bounds(spark):
    rows = [(1, '<a href="https://a.test/page/">'), (2, "see https://a.test/page, or https://a.test/pages"), (3, "https://a.test/page"), (4, "https://a.test/page.html"), (5, None)]
    posts = spark.createDataFrame(rows, "id long, content string")
    got = {r["id"]: r["after"] for r in X.url_rewrite(posts, "https://a.test/page/", "https://b.test/$1").collect()}
    assert got == {1: '<a href="https://b.test/$1">', 3: "https://b.test/$1"}
    assert {r["id"]: r["n"] for r in X.url_preview(posts, "https://a.test/page").collect()} == {1: 1, 3: 1}


def test_link_map_respects_order_and_cap(spark):
    posts = spark.createDataFrame([(i, f"burr grinder and kettle {i}") for i in range(4)], "id long, content string")
    e = spark.createDataFrame([(0, "Burr Grinder", "/bg"), (1, "grinder", "/g"), (2, "kettle", "/k")], "place int, keyword string, url string")
    got = {r["id"]: r["n"] for r in X.link_map(posts, e, max_posts=2).collect()}
    assert got == {0: 2, 1: 2}


def test_csv_rules(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text('﻿url,keyword,active\nhttps://a.test,"burr, grinder",0\n,missing,1\n\nhttps://b.test,kettle,\n', encoding="utf-8")
    rules, n = readers.read_rules(spark, str(p))
    got = {r["keyword"]: (r["url"], r["active"], r["max_per_post"]) for r in rules.collect()}
    assert got == {"burr, grinder": ("https://a.test", False, 1), "kettle": ("https://b.test", True, 1)}
    assert n.first().asDict() == {"imported": 2, "skipped": 1}
    q = tmp_path / "q.csv"
    q.write_text("kettle,https://k.test,1,0,yes,0,-3,1\n")
    r = readers.read_rules(spark, str(q))[0].first()
    assert r["case_sensitive"] and r["new_tab"] and r["max_per_post"] == 1


def test_search_csv(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text('Top pages,Clicks,Impressions,CTR,Position\nhttps://a.test/x/,"1,234",5000,24.7%,3.2\nnot a url,1,1,1,1\n')
    r = readers.read_search(spark, str(p)).collect()
    assert [(x["clicks"], x["impressions"], x["ctr"], x["position"]) for x in r] == [(1234, 5000, 24.7, 3.2)]


def test_sitemaps(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<urlset xmlns="x"><url><loc> https://o.test/burr-grinders </loc></url><url><loc>https://www.me.test/x</loc></url><url><loc>https://o.test/burr-grinders/</loc></url></urlset>')
    got = readers.read_sitemaps(spark, str(tmp_path), "other", "me.test").collect()
    assert [(r["site_label"], r["title"]) for r in got] == [("other", "Burr Grinders")]


def test_walk_columns():
    assert readers.walk_columns(["title", "title", "password", "Date", "date"]) == ["id", "content", "title", "date"]


def test_export_header_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("=evil", 3, 2)], "host string, links long, posts_linking long")
    files = lambda name: [f.read_text().splitlines() for f in sorted((tmp_path / name).glob("part-*.csv"))]
    sinks.write_csv(df.repartition(5), str(tmp_path / "out"), "domains")
    assert files("out") == [["host,links,posts_linking", "'=evil,3,2"]]
    sinks.write_csv(df.where("false"), str(tmp_path / "none"), "domains")
    assert files("none") == [["host,links,posts_linking"]]
    many = spark.range(25).select(F.col("id").cast("string").alias("host"), F.lit(1).alias("links"), F.lit(2).alias("posts_linking"))
    sinks.write_csv(many, str(tmp_path / "many"), "domains", rows_per_file=10)
    got = files("many")
    assert {f[0] for f in got} == {"host,links,posts_linking"} and all(2 <= len(f) <= 11 for f in got)
    assert sorted(int(r.split(",")[0]) for f in got for r in f[1:]) == list(range(25))
    assert all(h.split() for h in sinks.HEADERS.values()) and len(sinks.HEADERS) == 9


def picked(spark, body, title, keyword="", existing=()):
    src = spark.createDataFrame([(1, body)], "id long, content string")
    tgt = spark.createDataFrame([(2, title, keyword)], "id long, title string, keyword string")
    ex = spark.createDataFrame([(1, a) for a in existing] or [(0, "")], "src long, anchor string")
    weak = S.Settings(weak=frozenset({"the", "to", "how", "make", "guide", "ultimate", "over", "and", "for"}))
    r = S.anchors(src, tgt, ex, weak).collect()
    return (r[0]["anchor"], r[0]["tier"]) if r else None


@pytest.mark.parametrize("body,title,keyword,existing,want", [
    ("I own two Burr Grinders now.", "x", "burr grinder", (), ("Burr Grinders", "exact")),
    ("a single origin brew", "x", "best single origin", (), ("single origin", "partial")),
    ("we made pour-over coffee today", "How to Make Pour Over Coffee", "", (), ("pour-over coffee", "title")),
    ("good coffee", "The Guide to Coffee", "", (), ("coffee", "salient")),
    ("the ultimate guide", "The Ultimate Guide", "", (), None),
    ("Burr grinders and grinders", "Burr Grinders", "", ("burr grinders",), ("grinders", "salient")),
    ('<a href="/x">burr grinders</a> only', "Burr Grinders", "", (), None),
    ("nothing here", "Burr Grinders", "", (), None),
])
def test_anchor_cascade(spark, body, title, keyword, existing, want):
    assert picked(spark, body, title, keyword, existing) == want


def test_suggestions_end_to_end(spark):
    text = "Burr grinders crush beans evenly. Fresh beans and a kettle make better espresso shots every morning."
    posts = spark.createDataFrame([(1, "Morning Espresso", text, "morning espresso"), (2, "Burr Grinders", "Burr grinders crush beans. Burr grinders last. Beans need grinders.", "burr grinders"),
                                   (3, "Kettle Care", "Descale the kettle monthly. Kettle scale ruins espresso.", "kettle care"), (4, "Garden Paths", "Stone garden paths drain rain.", "garden paths")], "id long, title string, content string, keyword string")
    frame = S.pair_frame(posts)
    got = {(r["src"], r["target"]) for r in S.outbound(frame).collect()}
    assert (1, 2) in got and not any(4 in p for p in got)
    asked = spark.createDataFrame([(1, 2), (1, 4), (1, 1), (1, 77)], "src long, target long")
    stages = {(r["src"], r["target"]): r["stage"] for r in S.diagnose(asked, frame, posts, S.outbound(frame)).collect()}
    assert stages == {(1, 2): "ok", (1, 4): "anchor", (1, 1): "input", (1, 77): "candidate"}
    linked = S.pair_frame(posts, links=spark.createDataFrame([(1, 2)], "src long, target long"))
    assert (1, 2) not in {(r["src"], r["target"]) for r in S.outbound(linked).collect()}


def test_throttle_needs_a_gap():
    ok, state = K.accept([float(i) for i in range(35)], (0, 0.0), 30, 60)
    assert sum(ok) == 30 and ok[29] and not ok[30]
    assert K.accept([state[1] - 1], state, 30, 60)[0] == [False]
    assert K.accept([state[1]], state, 30, 60)[0] == [True]


def test_click_stream(spark, tmp_path):
    t0 = datetime(2024, 1, 1, 12)
    rows = [{"post_id": 1, "url": "/a" if i % 2 else "https://me.test/b", "anchor": "x", "ip": "1.2.3.4", "ts": (t0 + timedelta(seconds=i)).isoformat()} for i in range(40)]
    rows += [{"post_id": 1, "url": "https://other.test/", "anchor": "x", "ip": "9.9.9.9", "ts": t0.isoformat()}, {"post_id": 0, "url": "/a", "anchor": "", "ip": "9.9.9.9", "ts": t0.isoformat()}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    K.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), "me.test", "salt")
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 30 and "ip" not in out.columns
    assert K.daily_counts(out.withColumnRenamed("post_id", "target")).collect()[0]["clicks"] == 30
