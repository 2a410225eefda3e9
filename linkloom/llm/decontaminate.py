"""Benchmark decontamination: a prefix-filtered set join with exact containment over word windows.

Words are runs of digits, a-z (after A-Z are lowered) and non-ASCII characters. Each benchmark item is
cut into windows of `window` consecutive words (one window for a shorter item). Windows are shingles
whose words are ordered by rarity in the whole corpus; containment needs every word, so the one rarest
word is the necessary prefix. Only document words that equal some window's prefix word are joined; the
word's offset in the window fixes where the window would start, length and position bounds discard
starts outside the document, and the remaining candidates are verified word for word on the document.

Plan: the corpus is scanned twice (word counts of benchmark words, then the join) and its words are
never shuffled: they are exploded, probed against a broadcast table and dropped inside one
codegen stage. The broadcast side is cut into slices of SLICE_BYTES at most by its measured bytes, one scan for each slice
(one slice for usual benchmarks). A row of it has a bound too: windows of more than LONG_BYTES (words of a script without spaces can be
whole texts) are broadcast as hashes of their prefix word and of themselves, and their hits are then compared word for word by a
join with the windows. So what is broadcast has a proven bound whatever the benchmark holds.
Candidates are found with full lower-casing (a superset), verification lowers A-Z only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, drop_rejected, join_checked, lower_ascii, materialize, null_mark

#: Between words: ASCII other than digits and letters (A-Z are lowered before they are compared).
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SLICE_BYTES = 64 << 20
LONG_BYTES = 2048
ROW_BYTES = 96  # of a broadcast row besides its strings


def raw_words(text: Column) -> Column:
    """Words in their original case; the first and last may be the empty string."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), GAP)


def count_words(words: Column) -> Column:
    """Number of words in raw_words()."""
    n = F.size(words)
    first, last = (F.element_at(words, 1) == "").cast("int"), (F.element_at(words, -1) == "").cast("int")
    return F.when(n == 1, 1 - first).otherwise(n - first - last).cast("long")


def windows(benchmark: DataFrame, window: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, wtext, len): the items' windows, words joined by a space."""
    words = benchmark.select(F.col(item_col).alias("item_id"), F.filter(raw_words(lower_ascii(F.col(text_col).cast("string"))), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    return words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(window)))).alias("w")).select(
        "item_id", F.array_join("w", " ").alias("wtext"), F.size("w").alias("len")).distinct()


def _slices(df: DataFrame, key: str, *texts: str) -> list[DataFrame]:
    """df in parts of about SLICE_BYTES at most: its rows and the bytes of its strings are measured."""
    width = sum((F.octet_length(t) for t in texts), F.lit(ROW_BYTES))
    k = max(1, -(-(df.agg(F.sum(width)).first()[0] or 0) // SLICE_BYTES))
    return [df] if k == 1 else [df.where(F.pmod(F.xxhash64(key), F.lit(k)) == i) for i in range(k)]


def prefixes(docs: DataFrame, wins: DataFrame, text_col: str = "text") -> DataFrame:
    """(wid, wtext, len, token, off): each distinct window with its rarest word in the corpus. Words are counted by their hashes: should two
    share one, only the choice of the prefix changes."""
    uniq = materialize(wins.select("wtext", "len").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    tokens = uniq.select("wid", F.posexplode(F.split(F.lower("wtext"), " ")).alias("off", "token"))
    vocab = materialize(tokens.select(F.xxhash64("token").alias("h")).distinct(), "vocab")
    corpus = docs.select(F.explode(raw_words(F.col(text_col))).alias("word")).select(F.xxhash64(F.lower("word")).alias("h"))
    counts = reduce(DataFrame.unionAll, [corpus.join(F.broadcast(part), "h", "left_semi").groupBy("h").count() for part in _slices(vocab, "h")])
    counts = materialize(counts, "counts")
    ranked = tokens.withColumn("h", F.xxhash64("token")).join(counts, "h", "left").groupBy("wid").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("c"), "token", "off")).alias("p"))
    out = materialize(uniq.join(ranked, "wid").select("wid", "wtext", "len", "p.token", "p.off"), "prefixes")
    for t in (uniq, vocab, counts):
        discard(t)
    return out


def find_windows(docs: DataFrame, prefix: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' columns but the text, with uid, n_words and start, len, wid of each verified window; a row
    with null wid stands for the document itself."""
    keep = [c for c in docs.columns if c != text_col]
    columns = [F.col(f"`{c}`") for c in keep]
    base = docs.select(*columns, F.monotonically_increasing_id().alias("uid"), raw_words(F.col(text_col)).alias("words"))
    words = base.select(*columns, "uid", "words", count_words(F.col("words")).alias("n_words"), F.posexplode("words").alias("pos", "word"))
    long_ = F.octet_length("wtext") > LONG_BYTES
    here = lambda p: lower_ascii(F.array_join(F.slice(words["words"], F.greatest(F.lit(1), words["pos"] - p["off"] + 1), p["len"]), " "))
    fits = lambda p: (words["pos"] >= p["off"]) & (words["pos"] - p["off"] + p["len"] <= F.size(words["words"]))
    start = (F.col("pos") - F.col("off")).alias("start")
    found = []
    for k, part in enumerate(_slices(prefix.where(~long_), "wid", "wtext", "token")):
        p = F.broadcast(part)
        hit = words.join(p, (F.lower(words["word"]) == p["token"]) & fits(p) & (here(p) == p["wtext"]), "left_outer")
        of = F.col("wid").isNotNull() if k else F.col("wid").isNotNull() | (F.col("pos") == 0)
        found.append(hit.where(of).select(*columns, "uid", "n_words", start, "len", "wid"))
    large = prefix.where(long_)
    if not large.isEmpty():
        hashed = large.select("wid", "len", "off", F.xxhash64("token").alias("h"), F.xxhash64("wtext").alias("hw"))
        for part in _slices(hashed, "wid"):
            p = F.broadcast(part)
            hit = words.join(p, (F.xxhash64(F.lower(words["word"])) == p["h"]) & fits(p) & (F.xxhash64(here(p)) == p["hw"]))
            hit = hit.select(*columns, "uid", "n_words", start, p["len"], p["wid"].alias("wid_"), here(p).alias("here_"))
            exact = hit.join(large.select("wid", "wtext").hint("merge"), F.expr("wid = wid_ and here_ = wtext"))
            found.append(exact.select(*columns, "uid", "n_words", "start", "len", "wid"))
    return reduce(DataFrame.unionAll, found)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Defined cases: a null or wordless text has n_words 0 and no hits; rows that repeat an id, or have a
    null id, are documents of their own; items that repeat an id count once; items with a null id hit words but are not
    counted or listed; an empty benchmark hits nothing; an empty documents table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wins = materialize(windows(benchmark, window, item_col, item_text_col), "items")
    prefix = prefixes(rows, wins)
    hits = materialize(find_windows(rows, prefix), "hits")
    by_start = W.partitionBy("uid").orderBy("start")
    end = F.col("start") + F.col("len")
    before = F.max(end).over(by_start.rowsBetween(W.unboundedPreceding, -1))
    covered = hits.withColumn("add", F.greatest(end - F.greatest(F.coalesce(before, F.lit(0)), "start"), F.lit(0)))
    base = covered.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.coalesce(F.sum("add"), F.lit(0)).cast("long").alias("n_hit"))
    of_window = materialize(wins.where("item_id is not null").join(prefix, "wtext").select("wid", F.col("item_id").cast("string").alias("item")), "owners")
    listed = (join_checked(hits.where("wid is not null").select("uid", "wid").distinct(), of_window, "wid", "inner", 48)
              .select("uid", "item").distinct().groupBy("uid").agg(F.sort_array(F.collect_list("item")).alias("items")))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return base.join(listed, "uid", "left").select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no window of the benchmark. A contaminated row's id goes
    with all rows of that id; rows with a null id are judged by their text alone."""
    mark = null_mark(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    rows = docs.select(F.col(id_col).alias("id"), mark.alias("mark"), F.col(text_col).cast("string").alias("text"))
    wins = materialize(windows(benchmark, window), "items")
    found = find_windows(rows, prefixes(rows, wins)).where("wid is not null")
    bad = materialize(found.select("id", "mark").distinct(), "bad")
    return drop_rejected(docs, bad, id_col, mark)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP2_SQL = r"""
with items as (
  select item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w
  from benchmark where text is not null),
wins as (
  select distinct item_id, array_to_string(list_slice(w, i, i + 9), ' ') wtext, least(len(w), 10) n
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) i from items where len(w) > 0)),
docs as (
  select row_number() over () uid, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w
  from documents),
grams as (
  select uid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') g
  from (select uid, w, n, unnest(range(1, len(w) - n + 2)) i from docs, (select distinct n from wins) where len(w) >= n)),
hits as (select uid, i, grams.n, item_id from grams join wins on g = wtext),
words as (select uid, count(*) n_hit from (select distinct uid, unnest(range(i, i + n)) p from hits) group by uid),
lists as (select uid, list_sort(list(item)) l from (select distinct uid, cast(item_id as varchar) item from hits where item_id is not null) group by uid)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(len(l), 0) as bigint) n_items,
  sha256(coalesce(array_to_string(l, ','), '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from docs left join words using (uid) left join lists using (uid)
"""
