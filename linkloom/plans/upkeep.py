"""Queries on what is kept up to date: the link index after changes, scans with progress, the scheduled run's reading."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from linkloom.plans.content import PAGE_LINKS
from linkloom.operators import suggest as G
from linkloom.sources import answers as A
from linkloom.sources.scratch import shared_folder
from linkloom.sources.site import site, site_sql, table
from linkloom.sources.stored import StoredTable
from linkloom.streaming import index as I
from linkloom.streaming import scan as S

from .base import Plans

plans = Plans()

MORE = '<p><a href="https://changed.example/new">New here</a></p>'
#: Pages as labels change them: those of low quality are deleted, other labelled ones get one link more.
CHANGED = f"""with v as (select doc_id, min(quality) quality from labels group by doc_id), changed as (select page_id, url, case when doc_id is null then html else concat(html, '{MORE}') end html
 from pages left join v on page_id = doc_id where coalesce(quality, 1) > 0), """


def _folder(s) -> str:
    return f"{shared_folder(s)}/linkloom-tables/{uuid.uuid4().hex}"


@plans.add("reindex_delta", CHANGED + PAGE_LINKS[5:].replace("from pages", "from changed") + "select src, n, url, anchor, host, case when host in ('', own) then 'internal' else 'external' end type from i")
def reindex_delta(s, d):
    """Indexes all pages, then applies a batch of changes and deletions."""
    root = _folder(s)
    pages = table(s, d, "pages").select(F.col("page_id").alias("id"), "html", "url")
    pages.withColumns({"version": F.lit(1).cast("long"), "deleted": F.lit(False)}).write.parquet(f"{root}/in")
    I.maintain(s, f"{root}/in", f"{root}/index", f"{root}/checkpoint", buckets=16)
    marks = table(s, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"))
    batch = pages.join(marks, "id").withColumns({"html": F.concat("html", F.lit(MORE)), "version": F.lit(2).cast("long"), "deleted": F.col("quality") == 0})
    batch.drop("quality").write.mode("append").parquet(f"{root}/in")
    I.maintain(s, f"{root}/in", f"{root}/index", f"{root}/checkpoint", buckets=16)
    return I.read_index(s, f"{root}/index").withColumn("n", F.col("n").cast("long"))


def _posts(s, d) -> tuple[str, str]:
    root = _folder(s)
    table(s, d, "pages").select(F.col("page_id").alias("id"), "html", "url").write.parquet(f"{root}/posts")
    return f"{root}/posts", f"{root}/state"


@plans.add("scan_progress", PAGE_LINKS + "select 'links' job, (select count(*) from pages) scanned, count(*) found, (select count(*) from pages) total from i")
def scan_progress(s, d):
    """A scan of all pages that is stopped after its first batch and then goes on to the end."""
    posts, state = _posts(s, d)
    if not S.scan(s, posts, state, files=3, budget=0.0):
        S.scan(s, posts, state, files=3)
    return S.progress(s, posts, state)


@plans.add("scan_results", PAGE_LINKS + "select src, n, url, anchor, host, case when host in ('', own) then 'internal' else 'external' end type from i")
def scan_results(s, d):
    """The rows of that scan: each page's links once."""
    posts, state = _posts(s, d)
    if not S.scan(s, posts, state, files=3, budget=0.0):
        S.scan(s, posts, state, files=3)
    return S.results(s, state).withColumn("n", F.col("n").cast("long"))


@plans.add("scheduled_reading", PAGE_LINKS + """select date '2024-03-01' as day, (select count(*) from pages) posts, count(*) filter (where host in ('', own)) internal, count(*) filter (where host not in ('', own)) "external" from i""")
def scheduled_reading(s, d):
    """The reading that the scheduled run records, in as many runs as its budget asks for; each ends after one batch here."""
    posts, state = _posts(s, d)
    day = date(2024, 3, 1)
    if S.scheduled_run(s, posts, state, day, "example.test", budget=0.0, files=3) is None:
        S.scheduled_run(s, posts, state, day, "example.test", files=3)
    return S.history(s, state).select("day", "posts", "internal", "external")


@plans.add("stored_search", site_sql("gsc") + "select url, post_id, clicks * 2 clicks, impressions from gsc")
def stored_search(s, d):
    """Search rows that a second import replaces."""
    t = StoredTable(s, _folder(s), "url string, post_id long, clicks long, impressions long")
    rows = site(s, d, "gsc").select("url", "post_id", "clicks", "impressions")
    t.load(rows)
    t.load(t.read().withColumn("clicks", F.col("clicks") * 2))
    return t.read()


@plans.add("stored_keywords", site_sql("keywords", "posts") + """select k.id, post_id, case when money then upper(keyword) else keyword end keyword from keywords k join posts p on p.id = post_id where status <> 'draft'""")
def stored_keywords(s, d):
    """Target keywords of which drafts' are deleted and money pages' edited."""
    t = StoredTable(s, _folder(s), "id long, post_id long, keyword string")
    t.load(site(s, d, "keywords"))
    posts = site(s, d, "posts")
    t.remove(posts.where("status = 'draft'").select(F.col("id").alias("post_id")))
    money = posts.where("money").select(F.col("id").alias("post_id"))
    t.upsert(t.read().join(money, "post_id", "left_semi").withColumn("keyword", F.upper("keyword")), ["id"])
    return t.read()


@plans.add("stored_money_flags", site_sql("posts", "clicks") + "select id, (money or id in (select target from clicks)) and status <> 'draft' money from posts")
def stored_money_flags(s, d):
    """Money pages: what is clicked becomes one, drafts cease to be."""
    posts = site(s, d, "posts")
    t = StoredTable(s, _folder(s), "id long, money boolean")
    t.load(posts.select("id", "money"))
    t.flag(site(s, d, "clicks").select(F.col("target").alias("id")), "money", True)
    t.flag(posts.where("status = 'draft'").select("id"), "money", False)
    return t.read()


@plans.add("stored_sites", site_sql("external") + "select site_label, url, title from external where title <> ''")
def stored_sites(s, d):
    """Imported pages of other sites without those that have no title."""
    t = StoredTable(s, _folder(s), "site_label string, url string, title string")
    t.load(site(s, d, "external"))
    t.remove(t.read().where("title = ''").select("url"))
    return t.read()


def _recorded(s, d):
    """Answers as a model gives them, made of each document's first words."""
    w = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    return table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), w.alias("w"))


@plans.add("llm_keywords", r"""with w as (select doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), ' ') w from documents where text is not null),
 k as (select doc_id, unnest([w[1], '  ' || coalesce(w[2], '') || ' ', w[1] || ' ', '', w[3], w[4], w[5], w[6], w[7]]) keyword, unnest(range(9)) pos from w),
 c as (select doc_id, trim(keyword) keyword, pos from k where trim(keyword) <> ''), f as (select doc_id, arg_min(keyword, pos) keyword, min(pos) pos from c group by doc_id, lower(keyword)),
 r as (select doc_id post_id, keyword, row_number() over (partition by doc_id order by pos) place from f) select * from r where place <= 5""")
def llm_keywords(s, d):
    """Keywords that a model extracts, from recorded answers with blanks and repeats."""
    w = F.col("w")
    said = F.to_json(F.array(F.get(w, F.lit(0)), F.concat(F.lit("  "), F.coalesce(F.get(w, F.lit(1)), F.lit("")), F.lit(" ")), F.concat(F.get(w, F.lit(0)), F.lit(" ")), F.lit(""), *[F.get(w, F.lit(k)) for k in range(2, 7)]))
    return A.keywords_of(_recorded(s, d).select("id", said.alias("answer"))).withColumn("place", F.col("place").cast("long"))


@plans.add("llm_suggestions", None)
def llm_suggestions(s, d):
    """Suggestions that a model gives, from recorded answers, as far as they hold up."""
    from linkloom.plans.engines import _pairs, text_posts

    one = lambda k: F.struct(F.get("w", F.lit(k)).alias("phrase"), (F.col("id") + k).alias("target"), ((F.col("id") * 13 + k * 29) % 101).cast("int").alias("match"), F.lit("recorded").alias("reason"))
    said = _recorded(s, d).select("id", F.to_json(F.array(*[one(k) for k in range(7)])).alias("answer"))
    rejected = site(s, d, "rejections").where("kind = 'reject'").select(F.col("post_id").alias("src"), "target").distinct()
    return G.llm_answers(A.suggestions_of(said), text_posts(s, d), _pairs(s, d), rejected)
