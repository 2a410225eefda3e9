"""Graph, placement, scores, rejections, history, activity."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from linkloom.functions import scoring
from linkloom.operators import feedback, graph, keywords, links, reports
from linkloom.operators import clusters as C


def nodes_edges(spark, n, e):
    return spark.createDataFrame([(i,) for i in n], "id long"), spark.createDataFrame(e or [(0, 0)], "src long, dst long").where("src <> dst")


def ranks(spark, n, e, **kw):
    return {r["id"]: r["rank"] for r in graph.pagerank(*nodes_edges(spark, n, e), **kw).collect()}


def test_pagerank_textbook(spark):
    got = ranks(spark, [1, 2, 3], [(1, 2), (1, 3), (2, 3), (3, 1)])
    assert got[1] == pytest.approx(0.3878, abs=5e-4) and got[2] == pytest.approx(0.2148, abs=5e-4) and got[3] == pytest.approx(0.3974, abs=5e-4)


@pytest.mark.parametrize("n,e", [([1, 2, 3], [(1, 2), (2, 3)]), ([1, 2, 3, 4], [(2, 1), (3, 1), (4, 1)]), ([1, 2], []), ([7], [])])
def test_pagerank_sums_to_one(spark, n, e):
    assert sum(ranks(spark, n, e, rounds=10).values()) == pytest.approx(1, abs=1e-6)


def test_depths_with_cycle_and_unreachable(spark):
    n, e = nodes_edges(spark, range(1, 7), [(1, 2), (1, 5), (2, 3), (3, 4), (4, 2)])
    got = {r["id"]: r["depth"] for r in graph.depths(e, n.where("id = 1")).collect()}
    assert got == {1: 0, 2: 1, 5: 1, 3: 2, 4: 3}


def test_graph_keeps_distinct_edges_between_published(spark):
    posts = spark.createDataFrame([(1, "post", "publish"), (2, "post", "publish"), (3, "post", "draft"), (4, "note", "publish")], "id long, type string, status string")
    k = spark.createDataFrame([(1, 2, "internal"), (1, 2, "internal"), (2, 2, "internal"), (3, 1, "internal"), (1, 0, "internal"), (2, 4, "internal"), (2, 1, "external")], "src long, target long, type string")
    assert [(r.src, r.dst) for r in graph.graph(posts, k)[1].collect()] == [(1, 2)]


def test_placement(spark):
    filler = "word " * 100
    link = '<a href="/in">a</a>'
    rows = [(1, link + filler), (2, filler + link), (3, filler + link + filler), (4, filler), (5, '<a href="https://other.test/">x</a>' + filler), (6, link + filler + link), (7, None), (8, "")]
    posts = spark.createDataFrame([(i, c, "https://me.test/p") for i, c in rows], "id long, html string, url string")
    spots = links.positions(posts)
    at = {r["src"]: r["position"] for r in spots.where("src < 4").collect()}
    assert at[1] == 0 and at[2] > 0.98 and 0.45 < at[3] < 0.55
    shape = {r["src"]: r["shape"] for r in links.placement(spots, posts).collect()}
    assert shape == {1: "single", 2: "single", 3: "single", 4: "none", 5: "none", 6: "mixed", 7: "none", 8: "none"}


def test_link_classes(spark):
    inside = ["/a", "a", "?p=1", "#x", "https://example.test/a", "http://EXAMPLE.test", "https://www.example.test/b", "//example.test/c", "HTTPS://Www.Example.Test", "../x", ""]
    outside = ["https://other.test/", "http://sub.example.test/", "//cdn.test/x", "https://example.test.evil.test/", "http://example.com"]
    html = "".join(f'<a href="{u}">x</a>' for u in inside + outside)
    posts = spark.createDataFrame([(1, html, "https://example.test/p")], "id long, html string, url string")
    got = [r["type"] for r in links.build_index(posts).orderBy("n").collect()]
    assert got == ["internal"] * 11 + ["external"] * 5


def test_scores(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first()[0]
    lit = F.lit
    assert [val(scoring.need(lit(x))) for x in (0.0, 0.25, 1.0, 3.0)] == [1.0, 1.0, 0.0, 0.0]
    assert val(scoring.need(lit(0.625))) == pytest.approx(0.5)
    assert val(scoring.priority(lit(0.8), lit(1.0), 0.15)) == pytest.approx(0.92)
    assert val(scoring.demand(lit(5), lit(12.0))) is None and val(scoring.demand(lit(100), lit(0.0))) is None
    assert val(scoring.demand(lit(10000), lit(10.5))) == pytest.approx(1.0)
    assert val(scoring.impact(lit(1.0), lit(1.0), lit(None).cast("double"))) == pytest.approx(1.0)
    assert val(scoring.idf(lit(1), lit(1))) == 1.0 and val(scoring.idf(lit(9), lit(9))) == 0.0
    assert [val(scoring.severity(lit(a), lit(b).cast("double"))) for a, b in ((True, 0.9), (True, 0.5), (True, None), (False, 0.9))] == ["direct", "keyword", "keyword", "overlap"]
    assert [val(scoring.band(lit(x))) for x in (85, 84, 69, 10)] == ["Excellent", "Good", "Needs Work", "Poor"]
    assert [val(scoring.delta_pct(lit(a), lit(b))) for a, b in ((15, 10), (5, 0), (0, 0), (0, 4))] == [50, 100, 0, -100]


def rejections(spark, rows):
    return spark.createDataFrame(rows, "post_id long, target long, anchor string, happened long, kind string")


def test_rejections_learn_and_restore(spark):
    base = [(1, 9, "Coffee", 1, "reject"), (1, 9, "coffee!", 2, "reject"), (2, 9, "coffee", 3, "reject"), (3, 8, "coffee", 4, "reject"), (4, 7, "", 5, "reject")]
    b = {(r["norm"], r["target"]): r["posts"] for r in feedback.blocked(rejections(spark, base)).collect()}
    assert b == {("coffee", None): 3, ("coffee", 9): 2}
    assert [(r["norm"], r["target"]) for r in feedback.suppressed(rejections(spark, base)).collect()] == [("coffee", None)]
    assert feedback.blocked(rejections(spark, base), 0, 0).count() == 0
    again = base + [(0, 0, "Coffee", 6, "restore_anchor"), (5, 9, "coffee", 7, "reject")]
    assert feedback.blocked(rejections(spark, again)).count() == 0
    assert [(r["norm"], r["needed"]) for r in feedback.pending(rejections(spark, again)).collect()] == [("coffee", 2)]
    pair = base + [(0, 9, "coffee", 6, "restore_pair")]
    assert [r["target"] for r in feedback.blocked(rejections(spark, pair)).collect()] == [None]


def history(spark, rows):
    cols = "taken_on date, posts int, internal int, external int, orphaned int, broken int, opportunities int, avg_depth double"
    return spark.createDataFrame(rows, cols)


def test_trends(spark):
    h = history(spark, [(date(2024, 1, 1), 5, 10, 1, 4, 2, 7, 2.0), (date(2024, 1, 2), 5, 12, 1, 4, 3, 7, 2.0), (date(2024, 1, 3), 5, 15, 1, 6, 1, 7, 2.0)])
    got = {r["metric"]: (r["change"], r["good"]) for r in feedback.trends(h).collect()}
    assert got == {"internal": (5.0, True), "orphaned": (2.0, False), "broken": (-1.0, True), "opportunities": (0.0, None)}
    assert feedback.trends(h.where("false")).count() == 0


def test_last_reading_of_a_day_wins(spark):
    r = spark.createDataFrame([(date(2024, 1, 1), 2, 5), (date(2024, 1, 1), 9, 7), (date(2024, 1, 2), 1, 1)], "taken_on date, taken long, posts int")
    assert sorted((str(x["taken_on"]), x["posts"]) for x in feedback.daily(r).collect()) == [("2024-01-01", 7), ("2024-01-02", 1)]


def test_digest_first_run_and_diff(spark):
    k = lambda *x: spark.createDataFrame([(i,) for i in x], "key string")
    o = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert feedback.digest(None, k("a"), None, o(1), 0, 5).first()["new_broken"] == 0
    r = feedback.digest(k("a", "b"), k("b", "c", "d"), o(1), o(1, 2), 9, 4).first()
    assert (r["new_broken"], r["fixed_broken"], r["new_orphans"], r["new_opps"], r["subject"]) == (2, 1, 1, 0, "2 broken links, 1 orphaned post")


def test_activity_keeps_the_newest_batch_whole(spark):
    log = spark.createDataFrame([(i, "b2" if i > 5 else "b1") for i in range(1, 11)], "id long, batch string")
    assert sorted(r["id"] for r in feedback.retained(log, 2).collect()) == [6, 7, 8, 9, 10]
    assert feedback.retained(log, 0).count() == 0 and feedback.retained(log, 50).count() == 10


def test_revert_only_what_is_unchanged(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, content string")
    after = spark.createDataFrame([(1, "A"), (2, "B"), (3, "c")], "id long, content string")
    log = feedback.record(before, after, "replace", "s", "b")
    assert log.count() == 2
    now = spark.createDataFrame([(1, "A"), (2, "edited")], "id long, content string")
    got = {r["post_id"]: (r["outcome"], r["restored"]) for r in feedback.revert(log, now).collect()}
    assert got == {1: ("done", "a"), 2: ("changed since", None)}


def test_cluster_snapshot(spark):
    posts = spark.createDataFrame([(i, "post", "publish") for i in range(1, 6)], "id long, type string, status string")
    k = spark.createDataFrame([(1, 2, "internal"), (3, 2, "internal"), (2, 2, "internal"), (4, 1, "internal")], "src long, target long, type string")
    m = C.grouping(posts, spark.createDataFrame([(7, 1), (7, 2), (7, 3), (7, 99)], "cluster long, post_id long"))
    got = {r["cluster"]: r.asDict() for r in C.snapshot(posts, k, m).collect()}
    assert got[7]["count"] == 3 and got[7]["pillar"] == 2 and got[7]["internal"] == 2 and got[7]["connected"] == 1 and got[7]["health"] == pytest.approx(0.3333)
    assert got[-1]["count"] == 2 and got[-1]["pillar"] == 0


def test_overlap_pairs_match_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)], "vec_id long, embedding array<double>")
    got = {(r["a"], r["b"]) for r in keywords.overlap_pairs(df, 0.7, block=16).collect()}
    s = v @ v.T / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1))
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if round(s[i, j], 4) >= 0.7}


def test_vector_codec(spark):
    df = spark.createDataFrame([(1, [0.5, -1.0]), (2, None)], "id int, v array<float>")
    got = [r[0] for r in df.select(keywords.unpack_vector(keywords.pack_vector("v"))).collect()]
    assert got == [[0.5, -1.0], None]


def test_page_clamps(spark):
    posts = spark.createDataFrame([(i, f"t{i:02}", "post", "publish", date(2024, 1, 1), False) for i in range(30)], "id long, title string, type string, status string, taken date, money boolean")
    none = spark.createDataFrame([], "src long, target long, type string")
    clicks = spark.createDataFrame([], "target long, ts timestamp")
    page, total = reports.links_report(posts, none, clicks, per_page=1, page=0, orderby="drop table")
    assert page.count() == 5 and total.first()["total"] == 30


def test_insertions_window_is_half_open(spark):
    t = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2024, 1, 31),)], "ts timestamp")
    assert reports.insertions(t, datetime(2024, 1, 31), 30, 0).first()["n"] == 1
