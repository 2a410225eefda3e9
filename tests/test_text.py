"""Text functions: stems, tokens, anchors, URLs, cells."""

import pytest
from pyspark.sql import functions as F

from linkloom.functions import text
from linkloom.functions.words import GENERIC_ANCHORS, STOP_WORDS, ignore_words
from linkloom.operators import anchors


def values(spark, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.select(f(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


@pytest.mark.parametrize("pairs", [[
    ("caresses", "caress"), ("ponies", "poni"), ("boss", "boss"), ("cats", "cat"), ("agreed", "agree"), ("feed", "feed"), ("Machines", "machine"), ("running", "run"), ("linked", "link"),
    ("hopped", "hop"), ("falling", "fall"), ("troubled", "trouble"), ("created", "create"), ("sized", "size"), ("happy", "happi"), ("cry", "cry"), ("quickly", "quickli"), ("bed", "bed"), ("sing", "sing"), ("the", "the"), ("Café", "café"), ("grinders", "grinder"), (None, None), ("", ""),
]])
def test_stem(spark, pairs):
    got = values(spark, [a for a, _ in pairs], text.stem)
    assert got == [b for _, b in pairs]


def test_variants_share_a_stem(spark):
    a = values(spark, ["linking", "links", "linked", "Link"], text.stem)
    assert set(a) == {"link"}


def test_tokens(spark):
    got = values(spark, ["Pour-over coffee, don't 4k 2026 é1", "", None], text.tokens)
    assert got == [["Pour", "over", "coffee", "don't", "k", "é1"], [], None]


def test_anchor_spellings_fold(spark):
    rows = ["Burr Grinders", " burr  grinders ", "burr grinders,", "“Burr Grinders”", "<b>Burr</b> Grinders", "BURR GRINDERS!", "(burr grinders)", "burr&nbsp;grinders", "'burr grinders'", "burr\ngrinders", "burr grinders..."]
    assert set(values(spark, rows, text.normalize_anchor)) == {"burr grinders"}


def test_generic_anchors(spark):
    rows = ["Click here", "read more", "HERE!", "this post", "learn more.", "details", "website"]
    fine = ["read more about grinders", "coffee", "", "how to go"]
    got = values(spark, rows + fine, lambda c: anchors.is_generic(text.normalize_anchor(c)))
    assert got == [True] * len(rows) + [False] * len(fine)


def test_word_lists():
    assert len(STOP_WORDS) == 148 - 12 or len(STOP_WORDS) > 100
    assert len(GENERIC_ANCHORS) == len(set(GENERIC_ANCHORS)) == 39
    assert "coffee" in ignore_words("Coffee, tea") and "the" in ignore_words("")


def test_plain_and_linkable_text(spark):
    h = "<p>One&amp;two <a href='/x'>three</a></p><script>var a = '<p>'</script> four"
    assert values(spark, [h, None, ""], text.plain_text) == ["One&two three four", None, ""]
    assert values(spark, [h], text.linkable_text) == ["One&two four"]
    assert values(spark, ["a &eacute; &amp;lt; b"], lambda c: text.plain_text(c, full=True)) == ["a é &lt; b"]


def test_parse_links(spark):
    got = values(spark, ["""<A class=x HREF="/a?x=1&amp;y=2">one <b>two</b></A> <a href='b'>c</a> <a name="n">no</a>"""], text.parse_links)
    assert [(x["url"], x["anchor"]) for x in got[0]] == [("/a?x=1&y=2", "one two"), ("b", "c")]


def test_hosts_and_urls(spark):
    assert values(spark, ["https://WWW.Example.test/a", "//cdn.example.test:80/x", "/rel", "mailto:a@b", " http://u@h.test?q"], text.host_of) == ["example.test", "cdn.example.test", None, None, "h.test"]
    assert values(spark, [" HTTPS://a.test/B// "], text.url_key) == ["https://a.test/b"]
    assert values(spark, ["https://a.test/x/burr-grinders_101.html?q=1", "https://www.a.test/", "https://a.test/caf%C3%A9-guide/"], text.title_from_url) == ["Burr Grinders 101", "a.test", "Café Guide"]


def test_defuse(spark):
    rows = ["=1+1", "+x", "-5", "-a", "@cmd", "\tx", "plain", "", None, "+1.5"]
    assert values(spark, rows, text.defuse) == ["'=1+1", "'+x", "-5", "'-a", "'@cmd", "'\tx", "plain", "", None, "+1.5"]


def test_sentence(spark):
    body = "First one. The burr grinder is here! Last."
    assert values(spark, [body], lambda c: text.sentence_containing(c, F.lit("Burr"))) == ["The burr grinder is here!"]
    assert values(spark, ["x" * 400], lambda c: text.sentence_containing(c, F.lit("zz"))) == ["x" * 160 + "…"]
    long = "a " * 200 + "needle " + "b " * 200
    got = values(spark, [long], lambda c: text.sentence_containing(c, F.lit("needle")))[0]
    assert got.startswith("…") and got.endswith("…") and "needle" in got
    assert values(spark, ["", None], lambda c: text.sentence_containing(c, F.lit("x"))) == ["", None]


def test_build_anchor(spark):
    got = values(spark, ["Tom & co"], lambda c: text.build_anchor(c, F.lit("https://a.test/?x=1&y=2"), F.lit(True), F.lit(True)))
    assert got == ['<a href="https://a.test/?x=1&#038;y=2" target="_blank" rel="nofollow noopener" data-auto="1">Tom &amp; co</a>']


def test_original_case(spark):
    assert values(spark, ["We love Burr Grinders.", "none"], lambda c: text.original_case(c, F.lit("burr grinders"))) == ["Burr Grinders", "burr grinders"]
