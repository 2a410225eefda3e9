"""The incremental link index, resumable scans and the scheduled run."""

import os
from collections import Counter
from datetime import date

import pytest

from linkloom.operators.links import build_index
from linkloom.streaming import index as I
from linkloom.streaming import scan as S


def page(k, extra=""):
    return f'<p>x <a href="/p/{k + 1}">next {k}</a> and <a href="https://other.example/{k % 3}">away</a>{extra}</p>' if k % 5 else f"<p>no link {extra}</p>"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def rows_of(df):
    return Counter(map(tuple, df.select("src", "n", "url", "anchor", "host", "type").collect()))


def full(spark, posts):
    df = spark.createDataFrame([(k, h, f"https://site.example/p/{k}") for k, h in posts.items()], "id long, html string, url string")
    return rows_of(build_index(df))


def change(spark, folder, rows):
    spark.createDataFrame(rows, I.CHANGE).coalesce(1).write.mode("append").parquet(folder)


def test_changes_equal_a_rebuild_and_touch_their_buckets_only(spark, tmp_path):
    src, path, ck = f"{tmp_path}/in", f"{tmp_path}/index", f"{tmp_path}/ck"
    url = lambda k: f"https://site.example/p/{k}"
    posts = {k: page(k) for k in range(60)}
    change(spark, src, [(k, h, url(k), 1, False) for k, h in posts.items()] + [(None, "x", None, 1, False)])
    I.maintain(spark, src, path, ck, buckets=16)
    assert rows_of(I.read_index(spark, path)) == full(spark, posts)
    before = files(f"{path}/links")
    # one change, one deletion, one new post, one stale change, two versions of one post, null html
    change(spark, src, [(7, page(7, '<a href="/q">more</a>'), url(7), 2, False), (8, None, None, 2, True), (61, page(61), url(61), 1, False), (9, "<p>old</p>", url(9), 1, False), (11, "<p>gone over</p>", url(11), 2, False), (11, page(11, "!"), url(11), 3, None), (12, None, url(12), 5, False)])
    I.maintain(spark, src, path, ck, buckets=16)
    posts |= {7: page(7, '<a href="/q">more</a>'), 61: page(61), 11: page(11, "!"), 12: None}
    del posts[8]
    assert rows_of(I.read_index(spark, path)) == full(spark, posts)
    touched = {r["bucket"] for r in spark.createDataFrame([(k,) for k in (7, 8, 61, 9, 11, 12)], "src long").select(I._bucket(16).alias("bucket")).collect()}
    after = files(f"{path}/links")
    same = lambda f: any(f"bucket={b}/" in f for b in touched)
    assert {f: t for f, t in before.items() if not same(f)} == {f: t for f, t in after.items() if not same(f)} and len(touched) < 16
    assert {r["src"] for r in I.versions(spark, path).where("deleted").collect()} == {8}
    # nothing new: nothing happens; a deleted post can come back
    I.maintain(spark, src, path, ck, buckets=16)
    assert files(f"{path}/links") == after
    change(spark, src, [(8, page(8), url(8), 3, False)])
    I.maintain(spark, src, path, ck, buckets=16)
    assert rows_of(I.read_index(spark, path)) == full(spark, posts | {8: page(8)})


def test_a_batch_that_died_half_way_is_finished_by_its_repetition(spark, tmp_path, monkeypatch):
    path, posts = f"{tmp_path}/index", {k: page(k) for k in range(1, 30)}
    frame = lambda rows: spark.createDataFrame(rows, I.CHANGE)
    url = "https://site.example/p/1"
    I.apply_changes(frame([(k, h, url, 1, False) for k, h in posts.items()]), path, 0, 4)
    second = frame([(k, page(k, "?"), url, 2, False) for k in (3, 4)])
    rows = I.pending_rows(second, path, 4)
    rows.write.partitionBy("bucket").parquet(f"{path}/pending/1")
    victim = sorted(d for d in os.listdir(f"{path}/links") if d.startswith("bucket="))[0]
    touched = sorted(d for d in os.listdir(f"{path}/pending/1") if d.startswith("bucket="))
    for f in os.listdir(f"{path}/links/{touched[0]}"):  # the bucket was deleted, its new files had not come yet
        os.remove(f"{path}/links/{touched[0]}/{f}")
    assert victim
    for _ in range(2):  # and once more for nothing
        I.apply_changes(second, path, 1, 4)
        want = full(spark, posts | {k: page(k, "?") for k in (3, 4)})
        assert {k: v for k, v in rows_of(I.read_index(spark, path)).items()} == {k: v for k, v in want.items()}


@pytest.fixture(scope="module")
def posts(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("posts"))
    rows = [(k, page(k), f"https://site.example/p/{k}") for k in range(1, 81)] + [(90, None, "https://site.example/p/90")]
    spark.createDataFrame(rows, S.POST).repartition(6).write.mode("overwrite").parquet(d)
    return d


def test_a_stopped_scan_goes_on_and_scans_every_post_once(spark, posts, tmp_path):
    state, runs = f"{tmp_path}/s", []
    while not S.scan(spark, posts, state, files=1, budget=0.0):
        runs.append(S.progress(spark, posts, state).first()["scanned"])
        assert len(runs) < 20
    assert len(runs) >= 1 and runs[0] < 81
    table = spark.read.schema(S.POST).parquet(posts)
    assert rows_of(S.results(spark, state)) == rows_of(build_index(table))
    at = S.progress(spark, posts, state).first()
    assert (at["job"], at["scanned"], at["total"], at["found"]) == ("links", 81, 81, S.results(spark, state).count())
    assert S.scan(spark, posts, state)  # nothing left to do
    assert rows_of(S.results(spark, state)) == rows_of(build_index(table))
    # files that come later are scanned by the next call
    spark.createDataFrame([(91, page(1), "https://site.example/p/91")], S.POST).write.mode("append").parquet(posts)
    assert S.scan(spark, posts, state) and S.progress(spark, posts, state).first()["scanned"] == 82


def test_scheduled_runs_with_a_tiny_budget_equal_one_without(spark, posts, tmp_path):
    a, b, day = f"{tmp_path}/a", f"{tmp_path}/b", date(2024, 3, 1)
    one = S.scheduled_run(spark, posts, a, day, "site.example")
    n, many = 0, None
    while many is None:
        many, n = S.scheduled_run(spark, posts, b, day, "site.example", budget=0.0), n + 1
    assert n > 1 and one.collect() == many.collect()
    table = lambda s, name: Counter(map(tuple, spark.read.parquet(f"{s}/{name}").collect()))
    for name in ("history", "digest", "dead", "orphans"):
        assert table(a, name) == table(b, name)
    # the same day again changes nothing
    S.scheduled_run(spark, posts, a, day, "site.example")
    assert table(a, "history") == table(b, "history") and len(table(a, "history")) == 1
    # the next day has a new page that is linked by none and links to none: one orphan more, one dead link less
    spark.createDataFrame([(200, '<a href="/nowhere">x</a>', "https://site.example/p/200")], S.POST).write.mode("append").parquet(posts)
    got = S.scheduled_run(spark, posts, a, date(2024, 3, 2), "site.example", opportunities=4).first()
    assert (got["new_broken"], got["fixed_broken"], got["new_orphans"], got["new_opps"], got["subject"]) == (1, 0, 1, 4, "1 broken link, 1 orphaned post, 4 new suggestions")
    S.scheduled_run(spark, posts, a, date(2024, 3, 9), "site.example", keep_days=7)
    assert sorted(r["day"] for r in spark.read.parquet(f"{a}/history").collect()) == [date(2024, 3, 9)]
