"""The link index: links parsed from HTML posts, classified and resolved to posts."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text


def build_index(posts: DataFrame, html_col: str = "html", url_col: str = "url", home: str | None = None) -> DataFrame:
    """(src, n, url, anchor, host, type): one row per link of each post, in order.

    A link is internal when it has no host or its host is the site's (the post's own, or `home`), case and
    a leading www. apart. Null contents have no links."""
    own = text.host_of(F.lit(home)) if home else text.host_of(F.col(url_col))
    rows = posts.select(F.col("id").alias("src"), own.alias("own"), F.posexplode(text.parse_links(F.col(html_col))).alias("n", "l"))
    host = text.host_of(F.col("l.url"))
    return rows.select("src", "n", "l.url", "l.anchor", F.coalesce(host, F.lit("")).alias("host"), F.when(host.isNull() | (host == F.col("own")), "internal").otherwise("external").alias("type"))


def canonical(url, site: str):
    """The key that links and permalinks share: host folded, fragment dropped, path and query kept."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    path = F.regexp_replace(bare, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?]*", "")
    return F.concat(F.coalesce(text.host_of(url), F.lit(site)), F.regexp_replace(path, "/+$", ""))


def resolve(links: DataFrame, posts: DataFrame, site: str, link_col: str = "link") -> DataFrame:
    """links with target: the id of the post whose permalink a link names, 0 if none."""
    by = posts.select(canonical(F.col(link_col), site).alias("key"), F.col("id").alias("hit")).groupBy("key").agg(F.min("hit").alias("hit"))
    keyed = links.withColumn("key", F.when(F.col("type") == "internal", canonical(F.col("url"), site)))
    return keyed.join(by, "key", "left").withColumn("target", F.coalesce("hit", F.lit(0))).drop("key", "hit")


_BLOCK = re.compile(r"<script[^>]*?>.*?</script>|<style[^>]*?>.*?</style>", re.I | re.S)
_TAG = re.compile(r"<[^>]*>")
_BLANK = " \t\n\r\0\x0b"


def _measure(html: str) -> int:
    return len(_TAG.sub("", _BLOCK.sub("", html)).strip(_BLANK))


def visible_before(html: str, starts: list[int]) -> list[int]:
    """For each offset, in order, how many visible signs stand before it: what strip_tags() leaves of the text up to there. One pass:
    blocks and tags that end before an offset count, one that it lies in is still text."""
    rest, blocks, at = [], [], 0  # the text without blocks; each block's start, end and place in it
    size = 0
    for m in _BLOCK.finditer(html):
        rest.append(html[at : m.start()])
        size += m.start() - at
        blocks.append((m.start(), m.end(), size))
        at = m.end()
    rest.append(html[at:])
    plain = "".join(rest)
    tags = [m.span() for m in _TAG.finditer(plain)]
    seen = _TAG.sub("", plain)
    lead = len(seen) - len(seen.lstrip(_BLANK))
    full = [0]  # of each prefix of what is seen, its length without blanks at its end
    for k, c in enumerate(seen):
        full.append(full[-1] if c in _BLANK else k + 1)
    out, b, t, gone, taken = [], 0, 0, 0, 0
    for p in starts:
        while b < len(blocks) and blocks[b][1] <= p:
            gone += blocks[b][1] - blocks[b][0]
            b += 1
        if b < len(blocks) and blocks[b][0] < p:
            out.append(_measure(html[:p]))  # within a script or style, which doesn't end before it
            continue
        q = p - gone
        while t < len(tags) and tags[t][1] <= q:
            taken += tags[t][1] - tags[t][0]
            t += 1
        if t < len(tags) and tags[t][0] < q:  # a tag that is open here is text
            head = tags[t][0] - taken
            out.append(head - min(lead, head) + len(plain[tags[t][0] : q].rstrip(_BLANK)))
        else:
            out.append(max(0, full[q - taken] - lead))
    return out


def positions(posts: DataFrame, html_col: str = "html", url_col: str = "url", strict_host: bool = False) -> DataFrame:
    """(src, n, anchor, url, position): how far into the visible text, from 0 to 1, each internal link stands. Each text is
    read once, however many links it has."""
    c = F.col(html_col)
    lengths = lambda x: F.transform(x, lambda y: F.length(y))
    base = posts.select(F.col("id").alias("src"), text.host_of(F.col(url_col)).alias("own"), c.alias("html"), F.length(text.strip_tags(c)).cast("double").alias("total"), text.parse_links(c).alias("links"),
                        lengths(F.split(c, text.ANCHOR)).alias("gaps"), lengths(F.regexp_extract_all(c, F.lit(text.ANCHOR), F.lit(0))).alias("whole")).where("total > 0")

    @F.pandas_udf("array<int>")
    def before(htmls: pd.Series, gaps: pd.Series, whole: pd.Series) -> pd.Series:
        out = []
        for h, g, w in zip(htmls, gaps, whole):
            starts = np.cumsum(np.array(g[: len(w)], int)) + np.concatenate([[0], np.cumsum(np.array(w, int))[:-1]]) if len(w) else []
            out.append(visible_before(h, [int(x) for x in starts]))
        return pd.Series(out, dtype=object)

    rows = base.select("src", "own", "total", F.posexplode(F.arrays_zip("links", before("html", "gaps", "whole").alias("before"))).alias("n", "x"))
    host = text.host_of(F.col("x.links.url"))
    keep = host.isNull() | (host == F.col("own"))
    return rows.where(keep).select("src", "n", F.col("x.links.anchor").alias("anchor"), F.col("x.links.url").alias("url"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("x.before") / F.col("total"))).alias("position"))


def placement(spots: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per post of `ids`: links, avg, first_quarter, last_quarter, shape."""
    p = F.col("position")
    got = spots.groupBy("src").agg(F.count("*").alias("links"), F.avg("position").alias("avg"), F.count_if(p <= 0.25).alias("first_quarter"), F.count_if(p >= 0.75).alias("last_quarter"), F.array_sort(F.collect_list("position")).alias("spots"))
    all_ = ids.select(F.col("id").alias("src")).join(got, "src", "left").fillna(0, ["links", "first_quarter", "last_quarter"])
    shape = F.when(F.col("links") == 0, "none").when(F.col("links") < 2, "single").when(F.col("avg") >= 0.60, "bottom").when(F.col("avg") <= 0.40, "top").otherwise("mixed")
    return all_.withColumn("shape", shape)
