"""Rewrites of post contents: auto-links, single insertions, link maps, URL changes, repointing.

Replacement outside markup is a sequential scan over tags and text, and rules apply in order to what earlier ones
left; so a document's rules are folded over it inside one Arrow UDF, to which a join brings those that it may hold. Plain URL changes stay on the JVM.
"""

from __future__ import annotations

import dataclasses
import functools
import html
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions import text
from linkloom.sources.scratch import written

_TAG = re.compile(r"(<[^>]+>)")
_OPEN = re.compile(r"<a[\s>]", re.I)
_CLOSE = re.compile(r"</a\s*>", re.I)


def outside_tags(content: str, pattern: re.Pattern, make, most: int) -> tuple[str, int]:
    """content with up to `most` matches replaced in text that is in no tag and no link; and how many."""
    done, inside, out = 0, False, []
    for part in _TAG.split(content):
        if part.startswith("<") and part.endswith(">"):
            inside = (inside or bool(_OPEN.match(part))) and not _CLOSE.match(part)
        elif part and not inside and done < most:
            part, n = pattern.subn(make, part, count=most - done)
            done += n
        out.append(part)
    return "".join(out), done


def first_outside_tags(content: str, phrase: str, replacement: str) -> str | None:
    """content with the first whole-word match of phrase (any case) replaced, None if there is no safe one."""
    if not phrase:
        return None
    got, n = outside_tags(content, re.compile(rf"\b{re.escape(phrase)}\b", re.I), lambda _: replacement, 1)
    return got if n else None


def anchor_html(phrase: str, url: str, new_tab: bool = False, nofollow: bool = False) -> str:
    rel = " ".join([*(["nofollow"] if nofollow else []), *(["noopener"] if new_tab else [])])
    return f'<a href="{html.escape(url, True)}"' + (' target="_blank"' if new_tab else "") + (f' rel="{rel}"' if rel else "") + f' data-auto="1">{html.escape(phrase, True)}</a>'


@dataclass(frozen=True)
class Rule:
    id: int
    keyword: str
    url: str
    target: int = 0
    case_sensitive: bool = False
    partial_match: bool = False
    new_tab: bool = False
    nofollow: bool = False
    max_per_post: int = 1
    active: bool = True

    def pattern(self) -> re.Pattern:
        return _pattern(self.keyword, self.partial_match, self.case_sensitive)


@functools.lru_cache(1 << 14)
def _pattern(keyword: str, partial: bool, case_sensitive: bool) -> re.Pattern:
    body = re.escape(keyword)
    return re.compile(body if partial else rf"\b{body}\b", 0 if case_sensitive else re.I)


RULE = "id long, keyword string, url string, target long, case_sensitive boolean, partial_match boolean, new_tab boolean, nofollow boolean, max_per_post int, active boolean"
STARTS = 3  # signs by which keywords that may begin within a word are found


def rule_table(rules: DataFrame) -> DataFrame:
    """rules with all columns of RULE; those that the table lacks, and nulls, have a rule's defaults."""
    given = {f.name: f.default for f in dataclasses.fields(Rule) if f.default is not dataclasses.MISSING}
    kinds = dict(x.split(" ") for x in RULE.split(", "))
    col = lambda c: (F.col(c) if c in rules.columns else F.lit(None)).cast(kinds[c])
    return rules.select(*[(F.coalesce(col(c), F.lit(given[c])) if c in given else col(c)).alias(c) for c in kinds])


def _starts(low, n: int):
    at = F.when(F.length(low) >= n, F.sequence(F.lit(1), F.length(low) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat(F.lit("~"), F.substring(low, i, F.lit(n))))


def with_rules(posts: DataFrame, rules: DataFrame) -> DataFrame:
    """posts (id, content, ...) with rules_, an array of the rules whose keyword the content may hold, newest first; null where there is none.

    Texts and rules meet by a join: a keyword's longest word must be among a text's words. Keywords that may begin within a word meet texts by their
    first signs. So rules are never gathered in one place, however many there are, and a text carries only its own."""
    table = rule_table(rules).where("keyword is not null and keyword <> ''")
    words = F.filter(F.split(F.lower("keyword"), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    longest = F.element_at(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    loose = F.col("partial_match") | (F.size(words) == 0)
    start = F.substring(F.lower("keyword"), 1, STARTS)
    keyed = written(table.withColumn("key_", F.when(loose, F.concat(F.lit("~"), start)).otherwise(longest)))
    lengths = [r["n"] for r in keyed.where(F.col("key_").startswith("~")).select((F.length("key_") - 1).alias("n")).distinct().collect()]  # at most STARTS numbers
    low = F.lower(F.coalesce("content", F.lit("")))
    keys = F.split(low, r"[^\p{L}\p{N}_]+")
    keys = F.concat(keys, *[_starts(low, n) for n in sorted(lengths)])
    order = F.array_sort(F.collect_list(F.struct((-F.col("rule.id")).alias("o"), "rule")))
    rule = F.struct(*[F.col(x.split(" ")[0]) for x in RULE.split(", ")]).alias("rule")
    found = posts.select(F.col("id").alias("post_"), F.explode(F.array_distinct(keys)).alias("key_")).join(keyed.select("key_", rule), "key_")
    per = found.groupBy("post_").agg(F.transform(order, lambda x: x["rule"]).alias("rules_"))
    return posts.join(per, posts["id"].eqNullSafe(per["post_"]), "left").drop("post_")


_WORD = re.compile(r"\w+")


class RuleSet:
    """One text's rules in order, those that it may hold found by the first word of their keywords."""

    def __init__(self, rules: list[Rule]):
        self.rules = [r for active in (True, False) for r in rules if r.active is active and r.keyword]
        self.patterns = [r.pattern() for r in self.rules]
        self.by_word: dict[str, list[int]] = {}
        self.always: list[int] = []  # keywords that may begin within a word
        for i, r in enumerate(self.rules):
            word = None if r.partial_match else _WORD.search(r.keyword.lower())
            (self.by_word.setdefault(word.group(), []) if word else self.always).append(i)

    def candidates(self, content: str) -> list[int]:
        """Places of the rules whose keyword the text holds. Links put in later add no text outside links, so they are all
        that can ever match."""
        low = content.lower()
        found = [i for w in {*_WORD.findall(low)} & self.by_word.keys() for i in self.by_word[w]] + self.always
        return sorted(i for i in found if (self.rules[i].keyword in content if self.rules[i].case_sensitive else self.rules[i].keyword.lower() in low))

    def apply(self, post: int | None, content: str) -> tuple[str, dict[int, int]]:
        """content after all active rules in order, and matches per rule; paused rules are counted on the result."""
        counts: dict[int, int] = {}
        todo = self.candidates(content)
        parts = _parts(content, False)[0] if todo else []
        for i in todo:
            r = self.rules[i]
            if r.target and r.target == post:
                continue
            left, new = max(1, r.max_per_post), []
            for part, free in parts:
                n = 0
                if free and left:
                    changed, n = self.patterns[i].subn(lambda m, r=r: anchor_html(m.group(), r.url, r.new_tab, r.nofollow), part, count=left)
                    left -= n
                new += _parts(changed, False)[0] if n and r.active else [(part, free)]
            done = max(1, r.max_per_post) - left
            if done:
                counts[r.id] = done
                parts = new
        return "".join(p for p, _ in parts) if todo else content, counts


def _parts(content: str, inside: bool) -> tuple[list[tuple[str, bool]], bool]:
    """Tags and texts in order, and which of them may take a link."""
    out = []
    for part in _TAG.split(content):
        tag = part.startswith("<") and part.endswith(">")
        if tag:
            inside = (inside or bool(_OPEN.match(part))) and not _CLOSE.match(part)
        if part:
            out.append((part, not tag and not inside))
    return out, inside


def apply_rules(post: int | None, content: str, rules: list[Rule], patterns: dict[int, re.Pattern] | None = None) -> tuple[str, dict[int, int]]:
    return RuleSet(rules).apply(post, content)


def _set(rules) -> RuleSet:
    return RuleSet([Rule(**r) for r in rules])


def auto_link(posts: DataFrame, rules: DataFrame) -> DataFrame:
    """posts (id, content) with linked, the content that readers see. rules: see RULE."""

    @F.pandas_udf("string")
    def run(ids: pd.Series, contents: pd.Series, rules_: pd.Series) -> pd.Series:
        return pd.Series([c if c is None or r is None else _set(r).apply(i, c)[0] for i, c, r in zip(ids, contents, rules_)], dtype=object)

    return with_rules(posts, rules.where("active") if "active" in rules.columns else rules).withColumn("linked", run("id", "content", "rules_")).drop("rules_")


def link_counts(posts: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, links, posts): how many links each rule makes, paused ones as if they came last."""

    @F.pandas_udf("array<struct<rule:long,n:int>>")
    def run(ids: pd.Series, contents: pd.Series, rules_: pd.Series) -> pd.Series:
        return pd.Series([[] if c is None else [{"rule": k, "n": n} for k, n in _set(r).apply(i, c)[1].items()] for i, c, r in zip(ids, contents, rules_)], dtype=object)

    met = with_rules(posts.select("id", "content"), rules).where("rules_ is not null")
    return met.select("id", F.explode(run("id", "content", "rules_")).alias("x")).groupBy("x.rule").agg(F.sum("x.n").alias("links"), F.count("*").alias("posts"))


def toggled(rules: DataFrame, switches: DataFrame) -> DataFrame:
    """rules (id, active, ...) after switches (id, active); a null switch deletes its rule. The last of repeated switches is
    not known, so a rule is switched on if any of them says so."""
    by = switches.groupBy("id").agg(F.max("active").alias("to_"), F.lit(True).alias("told_"))
    j = rules.join(by, "id", "left").where("told_ is null or to_ is not null")
    return j.withColumn("active", F.coalesce("to_", "active")).drop("to_", "told_")


def insert_links(posts: DataFrame, inserts: DataFrame) -> DataFrame:
    """(id, content, after): posts with one link each (inserts: id, phrase, url); after is null without a safe place."""

    @F.pandas_udf("string")
    def run(contents: pd.Series, phrases: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([None if c is None or p is None else first_outside_tags(c, p, anchor_html(p, u or "")) for c, p, u in zip(contents, phrases, urls)], dtype=object)

    return posts.join(inserts, "id").withColumn("after", run("content", "phrase", "url"))


def link_map(posts: DataFrame, entries: DataFrame, max_posts: int = 25) -> DataFrame:
    """(id, content, after, n): each entry (place, keyword, url) links up to max_posts posts, by id, that hold its
    keyword and do not link there; entries apply in order to what earlier ones left."""
    table = entries.select("place", "keyword", "url").where("keyword <> '' and url <> ''")
    plain = text.linkable_text(F.col("content"))
    first = F.regexp_extract_all(F.lower(plain), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    # an entry meets only posts that have its first word; then the whole keyword is looked for
    word = F.element_at(F.regexp_extract_all(F.lower("keyword"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), 1)
    have = posts.select("id", F.explode(F.array_distinct(first)).alias("w"))
    cand = have.join(table.withColumn("w", word), "w").select("id", "place", "keyword", "url")
    cand = cand.join(posts.select("id", F.lower(plain).alias("plain"), F.col("content").alias("c")), "id").where(F.contains("plain", F.lower("keyword")) & ~F.contains(F.col("c"), F.concat(F.lit('"'), "url", F.lit('"'))))
    rank = F.row_number().over(W.partitionBy("place").orderBy("id"))
    picked = cand.withColumn("r", rank).where(F.col("r") <= max_posts).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "keyword", "url"))).alias("jobs"))

    @F.pandas_udf("struct<after:string,n:int>")
    def run(contents: pd.Series, jobs: pd.Series) -> pd.DataFrame:
        out = []
        for c, todo in zip(contents, jobs):
            n = 0
            for j in todo:
                m = re.search(rf"\b{re.escape(j['keyword'])}\b", c, re.I)
                new = first_outside_tags(c, j["keyword"], anchor_html(m.group() if m else j["keyword"], j["url"]))
                c, n = (new, n + 1) if new is not None else (c, n)
            out.append((c, n))
        return pd.DataFrame(out, columns=["after", "n"])

    return posts.join(picked, "id").withColumn("x", run("content", "jobs")).select("id", "content", "x.after", "x.n")


def boundary(old: str) -> str:
    """A JVM pattern for a URL with or without its final slash, followed by what may end one."""
    return text.quote(old.rstrip("/")) + r"/?(?=['\"\s<>)\]]|$)"


def url_preview(posts: DataFrame, old: str) -> DataFrame:
    """(id, n): posts that hold the URL and how often."""
    return posts.where(F.col("content").contains(old.rstrip("/"))).select("id", F.regexp_count("content", F.lit(boundary(old))).cast("long").alias("n")).where("n > 0")


def url_rewrite(posts: DataFrame, old: str, new: str) -> DataFrame:
    """(id, content, after) of the posts that change."""
    put = new.replace("\\", "\\\\").replace("$", "\\$")
    return posts.where(F.col("content").contains(old.rstrip("/"))).withColumn("after", F.regexp_replace("content", boundary(old), put)).where("after <> content").select("id", "content", "after")


_A = re.compile(r"<a\s([^>]*)>(.*?)</a>", re.I | re.S)
_HREF = re.compile(r"(href=)([\"'])(.*?)\2", re.I)


def rewrite_anchor(content: str, url: str, anchor: str, op: str, value: str) -> tuple[str, int]:
    """Replaces the href of, unwraps, or renames each link with that URL (and text, if anchor is not empty)."""
    want, n = url.strip().lower().rstrip("/"), 0

    def one(m: re.Match) -> str:
        nonlocal n
        h = _HREF.search(m.group(1))
        if not h or html.unescape(h.group(3)).strip().lower().rstrip("/") != want:
            return m.group()
        if anchor and re.sub(r"<[^>]*>", "", m.group(2)).strip().lower() != anchor.lower():
            return m.group()
        n += 1
        if op == "remove":
            return m.group(2)
        if op == "anchor":
            return f"<a {m.group(1)}>{html.escape(value)}</a>"
        attrs = m.group(1)[: h.start()] + f"{h.group(1)}{h.group(2)}{html.escape(value, True)}{h.group(2)}" + m.group(1)[h.end():]
        return f"<a {attrs}>{m.group(2)}</a>"

    return _A.sub(one, content), n


def fold_rewrites(posts: DataFrame, jobs: DataFrame) -> DataFrame:
    """(id, content, after, n): jobs (id, place, url, anchor, op, value) applied in order to each post, in one pass."""
    per = jobs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "url", "anchor", "op", "value"))).alias("jobs"))

    @F.pandas_udf("struct<after:string,n:int>")
    def run(contents: pd.Series, todo: pd.Series) -> pd.DataFrame:
        out = []
        for c, js in zip(contents, todo):
            n = 0
            for j in js:
                c, k = rewrite_anchor(c, j["url"], j["anchor"] or "", j["op"], j["value"] or "")
                n += k
            out.append((c, n))
        return pd.DataFrame(out, columns=["after", "n"])

    return posts.join(per, "id").withColumn("x", run("content", "jobs")).select("id", "content", "x.after", "x.n")


def repoint(posts: DataFrame, redirects: DataFrame) -> DataFrame:
    """Every link that a permanent redirect answers, pointed at where it lands: redirects (src, url, redirects_to)."""
    jobs = redirects.select(F.col("src").alias("id"), F.col("url").alias("place"), "url", F.lit("").alias("anchor"), F.lit("replace").alias("op"), F.col("redirects_to").alias("value")).distinct()
    return fold_rewrites(posts, jobs)


def serve_redirects(requests: DataFrame, changes: DataFrame) -> DataFrame:
    """requests (path) with new_url where a redirect applies: paths decoded, without a final slash; a redirect to
    itself is not served."""
    norm = lambda c: F.regexp_replace(F.coalesce(F.try_url_decode(F.regexp_replace(c, r"[?#].*$", "")), c), "(?<=.)/+$", "")
    by = changes.where("redirect").withColumn("p", norm(F.col("old_path"))).groupBy("p").agg(F.max_by("new_url", "id").alias("new_url"))
    out = requests.withColumn("p", norm(F.col("path"))).join(by, "p")
    return out.where(norm(F.regexp_replace("new_url", r"^[a-z]+://[^/]*", "")) != F.col("p")).drop("p")
