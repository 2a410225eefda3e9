"""Text, HTML and URL functions as columns; Arrow UDFs only where a sequential scan is inherent."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANCHOR = r"""(?is)<a\s[^>]*href=(["'])(.*?)\1[^>]*>(.*?)</a>"""
TOKEN = r"\p{L}[\p{L}\p{N}'’]*"
TRIM = " \t\n\r\x00\x0b.,;:!?\"'“”‘’()[]"


def strip_tags(c: Column) -> Column:
    """Markup removed, script and style with their bodies; trimmed."""
    bare = F.regexp_replace(c, r"(?is)<script[^>]*?>.*?</script>|<style[^>]*?>.*?</style>", "")
    return F.btrim(F.regexp_replace(bare, r"(?s)<[^>]*>", ""), F.lit(" \t\n\r\x00\x0b"))


#: The entities that columns decode on the JVM, & last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"),
            ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&#8217;", "’"), ("&#8211;", "–"), ("&amp;", "&")]


def decode_common(c: Column) -> Column:
    """Decodes the common entities with built-ins."""
    out = c
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if x is not None and "&" in x else x)


def decode_entities(c: Column) -> Column:
    """Decodes all HTML entities (an Arrow UDF; use decode_common where the common ones will do)."""
    return _unescape(c)


def collapse(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(" "))


def plain_text(c: Column, full: bool = False) -> Column:
    return collapse((decode_entities if full else decode_common)(strip_tags(c)))


def linkable_text(c: Column, full: bool = False) -> Column:
    """Plain text without the contents of existing links."""
    return plain_text(F.regexp_replace(c, r"(?is)<a\b[^>]*>.*?</a>", " "), full)


def parse_links(c: Column) -> Column:
    """array<struct<url, anchor>> of a text's links, in order."""
    urls, anchors = (F.regexp_extract_all(c, F.lit(ANCHOR), F.lit(g)) for g in (2, 3))
    return F.transform(F.arrays_zip(urls.alias("u"), anchors.alias("a")), lambda x: F.struct(decode_common(x["u"]).alias("url"), strip_tags(x["a"]).alias("anchor")))


def normalize_anchor(c: Column) -> Column:
    return F.lower(F.btrim(collapse(decode_common(strip_tags(c))), F.lit(TRIM)))


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def stem(c: Column) -> Column:
    """A rough English stem: plurals, -ed and -ing, final y, -ly. Short and non-ASCII words are only lowered."""
    cut = lambda x, n: F.substring(x, F.lit(1), F.length(x) - n)

    def repair(x):
        return F.when(x.rlike("(?:at|bl|iz)$"), F.concat(x, F.lit("e"))).when((F.length(x) > 2) & x.rlike(r"([^aeioulsz])\1$"), cut(x, 1)).otherwise(x)

    def tense(a):
        agreed = F.regexp_replace(cut(a, 3), "[^a-z]", "").rlike("[aeiou][^aeiou]")
        return (F.when(a.rlike("eed$"), F.when(agreed, cut(a, 1)).otherwise(a)).when(a.rlike("[aeiouy].*ed$"), let(cut(a, 2), repair))
                .when(a.rlike("[aeiouy].*ing$"), let(cut(a, 3), repair)).otherwise(a))

    def final_y(b):
        return F.when(b.rlike("[aeiouy].*y$"), F.concat(cut(b, 1), F.lit("i"))).otherwise(b)

    def no_ly(d):
        return F.when(d.rlike("ly$") & (F.length(d) > 4), cut(d, 2)).otherwise(d)

    def english(w):
        singular = F.regexp_replace(w, "(?:(?<=ss)es|(?<=i)es|(?<!s)s)$", "")
        return F.when(w.rlike("^[a-z][a-z'-]*$") & (F.length(w) > 3), let(let(let(singular, tense), final_y), no_ly)).otherwise(w)

    return let(F.lower(c), english)


def tokens(c: Column) -> Column:
    """array<string>: words that start with a letter; hyphens part them, apostrophes don't."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def url_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "/+$", "")


def url_hash(c: Column) -> Column:
    return F.md5(url_key(c))


def host_of(url: Column) -> Column:
    """Host in lower case without a leading www., null for relative URLs."""
    h = F.nullif(F.regexp_extract(F.trim(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))
    return F.regexp_replace(F.lower(h), r"^www\.", "")


def title_from_url(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    last = F.element_at(F.split(F.regexp_replace(path, r"^/+|/+$", ""), "/"), -1)
    words = F.coalesce(F.try_url_decode(F.regexp_replace(F.regexp_replace(last, r"(?i)\.(html?|php|aspx?)$", ""), "[-_]+", " ")), last)
    named = F.array_join(F.transform(F.split(F.trim(words), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")
    return F.when(F.trim(words) == "", F.coalesce(host_of(url), F.lit(""))).otherwise(named)


def defuse(c: Column) -> Column:
    """A leading apostrophe for strings that a spreadsheet would run as a formula; numbers pass."""
    risky = c.rlike(r"^[=+\-@\t\r]") & c.try_cast("double").isNull()
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def quote(text: str) -> str:
    """A literal for a regular expression of the JVM."""
    return re.sub(r"([^A-Za-z0-9_\s\u0080-\U0010ffff])", r"\\\1", text)


def escape_html(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for char, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def build_anchor(phrase: Column, url: Column, new_tab: Column, nofollow: Column, mark: str = "data-auto") -> Column:
    rel = F.concat_ws(" ", F.when(nofollow, "nofollow"), F.when(new_tab, "noopener"))
    return F.concat(F.lit('<a href="'), F.replace(F.replace(url, F.lit("&"), F.lit("&#038;")), F.lit('"'), F.lit("%22")), F.lit('"'), F.when(new_tab, ' target="_blank"').otherwise(""),
                    F.when(rel != "", F.concat(F.lit(' rel="'), rel, F.lit('"'))).otherwise(""), F.lit(f' {mark}="1">'), escape_html(phrase), F.lit("</a>"))


def sentence_containing(plain: Column, phrase: Column, window: int = 160) -> Column:
    """The first sentence with the phrase (any case) if it has at most 320 characters, else a window around it."""
    p = F.trim(plain)
    at = F.position(F.lower(phrase), F.lower(p))
    hits = F.filter(F.split(p, r"(?<=[.!?])\s+"), lambda s: F.contains(F.lower(s), F.lower(phrase)))
    first = F.trim(F.try_element_at(hits, F.lit(1)))
    start = F.greatest(F.lit(0), at - 1 - window // 2)
    around = F.concat(F.when(start > 0, "…").otherwise(""), F.trim(F.substring(p, start + 1, F.length(phrase) + window)), F.lit("…"))
    return (F.when((p == "") | (phrase == ""), "").when(first.isNotNull() & (F.length(first) <= 320), first).when(at == 0, F.concat(F.substring(p, 1, window), F.lit("…"))).otherwise(around))


def original_case(content: Column, phrase: Column) -> Column:
    """The first whole-word match in its own case, else the phrase."""
    quoted = F.concat(F.lit(r"(?iU)\b\Q"), F.replace(phrase, F.lit("\\E"), F.lit("")), F.lit(r"\E\b"))
    got = F.regexp_substr(content, quoted)
    return F.coalesce(got, phrase)
