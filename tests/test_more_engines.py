"""Sequential operators against brute force: auto-links, link positions, click throttle, converged ranks."""

import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from linkloom.operators import links as L
from linkloom.operators import rewrite as X

SF = "/root/testdata/sf0.001"


def naive(post, content, rules):
    """Rules one after another, each over the whole content anew."""
    counts = {}
    for active in (True, False):
        for r in rules:
            if r.active is active and r.keyword and not (r.target and r.target == post):
                new, n = X.outside_tags(content, r.pattern(), lambda m, r=r: X.anchor_html(m.group(), r.url, r.new_tab, r.nofollow), max(1, r.max_per_post))
                if n:
                    counts[r.id] = n
                    content = new if active else content
    return content, counts


def test_rule_set_equals_rules_one_by_one():
    r = random.Random(4)
    words = ["burr", "grinder", "Café", "au", "lait", "a+b", "x.y", "grind", "GRINDER", "7"]
    for _ in range(300):
        rules = [X.Rule(k, " ".join(r.choices(words, k=r.randint(1, 2))) if r.random() < 0.9 else "rin", f"/u{k}?a&b", r.choice([0, 0, 5]), r.random() < 0.3, r.random() < 0.3, r.random() < 0.5, r.random() < 0.5, r.randint(0, 3), r.random() < 0.8) for k in range(8)]
        bits = words + ["<p>", "</p>", "<a href='grinder'>", "</a>", "<b class='burr'>", "a < b", "x > y", "\n", "&amp;"]
        content = " ".join(r.choices(bits, k=40))
        assert X.RuleSet(rules).apply(5, content) == naive(5, content, rules)


def made_rules(r, n, words):
    return [X.Rule(k, " ".join(r.choices(words, k=r.randint(1, 2))) if r.random() < 0.8 else r.choice(["rin", "é", "+", "a+", "ur"]), f"/u{k}?a&b", r.choice([0, 0, 5]), r.random() < 0.3, r.random() < 0.3, r.random() < 0.5, r.random() < 0.5, r.randint(1, 3), r.random() < 0.7) for k in range(n)]


def test_rules_that_come_by_a_join_equal_all_rules_one_by_one(spark):
    r = random.Random(9)
    words = ["burr", "grinder", "Café", "au", "lait", "a+b", "x.y", "grind", "GRINDER", "7", "_z"]
    rules = made_rules(r, 60, words)
    bits = words + ["<p>", "</p>", "<a href='grinder'>", "</a>", "<b class='burr'>", "a < b", "x > y", "\n", "&amp;"]
    posts = [(k, " ".join(r.choices(bits, k=40))) for k in range(1, 40)] + [(90, None), (91, ""), (92, "nothing here")]
    table = spark.createDataFrame([tuple(getattr(x, c.split(" ")[0]) for c in X.RULE.split(", ")) for x in rules], X.RULE)
    df = spark.createDataFrame(posts, "id long, content string")
    ordered = sorted(rules, key=lambda x: -x.id)
    live = [x for x in ordered if x.active]
    assert {x["id"]: x["linked"] for x in X.auto_link(df, table).collect()} == {i: None if c is None else naive(i, c, live)[0] for i, c in posts}
    links, held = {}, {}
    for i, c in posts:
        for k, n in naive(i, c or "", ordered)[1].items():
            links[k], held[k] = links.get(k, 0) + n, held.get(k, 0) + 1
    assert {x["rule"]: (x["links"], x["posts"]) for x in X.link_counts(df, table).collect()} == {k: (links[k], held[k]) for k in links} and len(links) > 20
    # columns that are not given, and no rules at all
    few = spark.createDataFrame([(1, "burr", "/b")], "id long, keyword string, url string")
    assert X.link_counts(df, few).first()["links"] > 0 and X.link_counts(df, few.where("id > 1")).count() == 0
    assert X.auto_link(df, few.where("id > 1")).where("not (linked <=> content)").count() == 0


def test_many_rules(spark):
    """20,000 rules, of which each text holds a few: what reaches a text is only these."""
    rules = spark.range(20000).select("id", F.concat(F.lit("term"), "id", F.lit(" word"), F.col("id") % 50).alias("keyword"), F.concat(F.lit("/k/"), "id").alias("url"))
    posts = spark.range(300).select("id", F.concat_ws(" ", *[F.concat(F.lit("see term"), (F.col("id") * 61 + k * 17) % 20000, F.lit(" word"), ((F.col("id") * 61 + k * 17) % 20000) % 50, F.lit(".")) for k in range(4)]).alias("content"))
    met = X.with_rules(posts, rules)
    assert met.agg(F.max(F.size("rules_")), F.min(F.size("rules_"))).first() == (4, 4)
    got = X.link_counts(posts, rules).agg(F.sum("links"), F.sum("posts")).first()
    assert tuple(got) == (1200, 1200)


def test_link_positions_and_placement(spark):
    strip = lambda c: re.sub(r"(?s)<[^>]*>", "", re.sub(r"(?is)<script[^>]*?>.*?</script>|<style[^>]*?>.*?</style>", "", c)).strip(" \t\n\r\x00\x0b")
    host = lambda u: re.sub(r"^www\.", "", (re.match(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", u.strip()) or re.match("()", "")).group(1).lower())
    want, shapes = {}, {}
    for row in spark.read.parquet(f"{SF}/pages.parquet").collect():
        c, spots = row["html"] or "", []
        total = len(strip(c))
        for n, m in enumerate(re.finditer(r"""(?is)<a\s[^>]*href=(["'])(.*?)\1[^>]*>(.*?)</a>""", c)):
            url = html.unescape(m.group(2))
            if total and host(url) in ("", host(row["url"])):
                spots.append(min(1.0, len(strip(c[: m.start()])) / total))
                want[row["page_id"], n] = spots[-1]
        avg = sum(spots) / len(spots) if spots else None
        shapes[row["page_id"]] = (len(spots), sum(p <= 0.25 for p in spots), sum(p >= 0.75 for p in spots), "none" if not spots else "single" if len(spots) < 2 else "bottom" if avg >= 0.6 else "top" if avg <= 0.4 else "mixed")
    got = entry.queries()["link_positions"](spark, SF).collect()
    assert {(r["src"], r["n"]): r["position"] for r in got} == pytest.approx(want) and len(want) > 20
    assert {r["src"]: (r["links"], r["first_quarter"], r["last_quarter"], r["shape"]) for r in entry.queries()["placement_summary"](spark, SF).collect()} == shapes


def test_visible_text_before_each_offset_is_measured_in_one_pass():
    r = random.Random(1)
    bits = ["<p>", "</p>", "<script>", "</script>", "<style x>", "</style>", " ", "\n", "a", "bc", "<", "> ", ">", "<a href='x'>", "</a>", "< b", "\t"]
    for _ in range(4000):
        h = "".join(r.choices(bits, k=r.randint(0, 25)))
        at = sorted({r.randrange(len(h) + 1) for _ in range(4)})
        assert L.visible_before(h, at) == [L._measure(h[:p]) for p in at]


def test_positions_on_a_page_with_ten_thousand_links(spark):
    page = "<p>word word <a href='/x'>y</a></p>" * 10000
    df = spark.createDataFrame([(1, page, "https://site.example/"), (2, None, "https://site.example/"), (3, "", None)], "id long, html string, url string")
    began = time.time()
    got = {r["n"]: r["position"] for r in L.positions(df).collect()}
    assert time.time() - began < 60 and len(got) == 10000
    assert all(got[n] == pytest.approx((11 * n + 9) / 110000) for n in range(1, 10000, 997))


def test_click_throttle(spark):
    hits = sorted((str(r["user_id"] % 97), r["ts"], r["event_id"]) for r in spark.read.parquet(f"{SF}/events.parquet").collect())
    want, state = set(), {}
    for client, ts, event in hits:
        n, until = state.get(client, (0, 0.0))
        n = 0 if ts.timestamp() >= until else n
        if n < 3:
            state[client] = (n + 1, ts.timestamp() + 3600)
            want.add(event)
    assert {r["event_id"] for r in entry.queries()["click_throttle"](spark, SF).collect()} == want


def test_ranks_converge(spark):
    nodes, edges = {r["id"] for r in entry.queries()["degrees"](spark, SF).collect()}, {(r["src"], r["dst"]) for r in entry.queries()["edges"](spark, SF).collect()}
    out = {i: [] for i in nodes}
    for a, b in edges:
        out[a].append(b)
    rank, n = {i: 1 / len(nodes) for i in nodes}, len(nodes)
    for _ in range(200):
        new = dict.fromkeys(nodes, 0.15 / n + 0.85 * sum(rank[i] for i in nodes if not out[i]) / n)
        for a, bs in out.items():
            for b in bs:
                new[b] += 0.85 * rank[a] / len(bs)
        rank = new
    got = {r["id"]: r["rank"] for r in entry.queries()["equity_converged"](spark, SF).collect()}
    assert got.keys() == rank.keys() and all(got[i] == pytest.approx(rank[i], abs=1e-5) for i in nodes) and sum(got.values()) == pytest.approx(1, abs=1e-4)


def test_link_map(spark):
    """Entries in order, each into the first posts by id that hold its keyword and do not link there, over small contents."""
    r = random.Random(6)
    words = "burr grinder kettle scale espresso roast filter café".split()
    posts = [(k, " ".join(r.choices(words + ["<b>", "</b>", "<a href='/x'>kettle</a>", '<a href="/u1">scale</a>', "KETTLE"], k=15))) for k in range(40)] + [(90, None), (91, "")]
    entries = [(k, " ".join(r.choices(words, k=r.randint(1, 2))), f"/u{k}") for k in range(12)] + [(20, "", "/no"), (21, "kettle", ""), (22, None, "/n")]
    state, done = dict(posts), {}
    for place, keyword, url in sorted(entries):
        if not keyword or not url:
            continue
        low = {i: re.sub(r"\s+", " ", re.sub(r"(?s)<[^>]*>", "", re.sub(r"(?is)<a\b[^>]*>.*?</a>", " ", c or ""))).strip().lower() for i, c in posts}
        may = [i for i, c in posts if keyword.lower() in low[i] and f'"{url}"' not in c and keyword.split()[0] in re.findall(r"\w+", low[i])]
        for i in sorted(may)[:5]:
            m = re.search(rf"\b{re.escape(keyword)}\b", state[i], re.I)
            new = X.first_outside_tags(state[i], keyword, X.anchor_html(m.group() if m else keyword, url))
            done.setdefault(i, 0)
            if new is not None:
                state[i], done[i] = new, done[i] + 1
    got = X.link_map(spark.createDataFrame(posts, "id long, content string"), spark.createDataFrame(entries, "place int, keyword string, url string"), 5).collect()
    assert {r["id"]: (r["after"], r["n"]) for r in got} == {i: (state[i], n) for i, n in done.items()} and sum(done.values()) > 20
