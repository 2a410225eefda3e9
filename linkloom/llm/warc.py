"""WARC archives: written by Spark, read back by boundary-chain verification.

Writing: one record per page. Of pages with equal payloads the one with the least id is a response,
the others are revisits that refer to it and carry no payload. Records are rows of a text table
whose line separator is the blank line that ends a record, so Spark's committer writes the files.

Reading: tasks split archives at the magic that starts a record and emit, for each candidate, its offset
and the offset of its successor (from the header's Content-Length). Pointer jumping from the start of each
file, doubling the stride each round, retains only the reachable records; magic inside a payload is
never reached. A record whose payload holds the magic is put together from its pieces.

Payloads never pass through a shuffle: digests are computed in the scans, all joins are on narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, join_checked, materialize, scratch_path

MAGIC = "WARC/1.1\r\n"
BLANK = "\r\n\r\n"
RECORDS_PER_FILE = 4000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 10 hex digits are 8 digits to the base 32."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", date: str = "2024-01-01T00:00:00Z",
               min_revisit_bytes: int = 0) -> None:
    """Writes the archives under path. Ids are written as text; a null payload is empty."""
    page = F.col(f"`{id_col}`").alias("id")
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    url = F.coalesce(F.regexp_replace(F.col(f"`{url_col}`").cast("string"), r"[\r\n]", ""), F.lit("")) if url_col else F.lit("")
    rows = pages.select(page, payload.alias("payload"), url.alias("url"), base32_sha1(payload.cast("binary")).alias("digest"))
    meta = materialize(rows.select("id", "digest", F.octet_length("payload").alias("n")), "payloads")
    first = meta.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1 and first is not null")
    again = materialize(meta.where(F.col("n") >= min_revisit_bytes).join(first, "digest").where("not (id <=> first)").select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), "first").distinct(), "revisits")
    out = join_checked(rows, again, F.expr("id <=> r_id and digest = r_digest"), "left", 72)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(c.cast("string")), F.lit("~null")), F.lit(">"))
    is_revisit = F.col("first").isNotNull()
    body = F.when(is_revisit, F.lit("")).otherwise(F.concat(F.lit(HTTP + "\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(BLANK), F.col("payload")))
    out = out.withColumn("body", body)
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\nWARC-Record-ID: "), urn(F.col("id")),
        F.when(is_revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("first")))).otherwise(F.lit("")),
        F.lit("\r\nWARC-Target-URI: "), F.col("url"), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit(BLANK))
    out.select(F.concat(head, "body").alias("value")).write.option("lineSep", BLANK).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    discard(meta)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, mid, value): what stands between magics, in order of mid within a block of a file."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"), "value")


def reachable(cand: DataFrame) -> DataFrame:
    """(file, off) of the candidates (file, off, nxt) on the chain from offset 0 of their file."""
    now = materialize(cand.select("file", "off", "nxt", (F.col("off") == 0).alias("hit")), "jump")
    while not now.where("nxt is not null").isEmpty():
        came = now.where("hit and nxt is not null").select(F.col("file").alias("c_file"), F.col("nxt").alias("c_off")).distinct()
        new = now.alias("a").join(now.alias("b"), F.expr("a.file = b.file and a.nxt = b.off"), "left").select(
            F.col("a.file").alias("file"), F.col("a.off").alias("off"), F.col("b.nxt").alias("nxt"), F.col("a.hit").alias("hit"))
        new = new.join(came, F.expr("file = c_file and off = c_off"), "left").select("file", "off", "nxt", (F.col("hit") | F.col("c_file").isNotNull()).alias("hit"))
        nxt = materialize(new, "jump")
        discard(now)
        now = nxt
    return now.where("hit").select("file", "off")


def _fields(value: Column) -> dict[str, Column]:
    head = F.substring_index(value, BLANK, 1)
    get = lambda name: F.nullif(F.regexp_extract(F.concat(F.lit("\r\n"), head), rf"(?i)\r\n{name}: *([^\r\n]*)", 1), F.lit(""))
    return {"head": (F.octet_length(head) + 4).cast("long"), "clen": get("Content-Length").try_cast("long"),
            "kind": get("WARC-Type"), "rid": get("WARC-Record-ID"), "refers": get("WARC-Refers-To"), "url": get("WARC-Target-URI"), "stated": get("WARC-Payload-Digest")}


def _payload(data: Column, head: Column, clen: Column) -> Column:
    """The payload of a record: its block after the HTTP header. data: binary from the end of the magic."""
    block = F.substring(data, (head + 1).cast("int"), clen.cast("int"))
    text = block.cast("string")
    http = F.substring_index(text, BLANK, 1)
    return F.when(text.startswith("HTTP/"), F.substring(block, F.octet_length(http) + 5, F.octet_length(block))).otherwise(block)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, refers_to, url, stated_digest, payload_bytes, payload_digest): the true
    records. Ids lose their urn; null stays null. Digest and bytes are of the payload in the record; a
    revisit's are null."""
    raw = _chunks(spark, path)
    f = _fields(F.col("value"))
    parts = raw.select("file", "block", "mid", F.octet_length("value").cast("long").alias("len"), *[c.alias(n) for n, c in f.items()], "value")
    fits = F.col("len") == F.col("head") + F.col("clen") + 4
    data = F.when(fits & (F.col("kind") != "revisit"), _payload(F.col("value").cast("binary"), F.col("head"), F.col("clen")))
    table = materialize(parts.withColumn("data", data).select(
        "file", "block", "mid", "len", "head", "clen", "kind", "rid", "refers", "url", "stated", F.coalesce(fits, F.lit(False)).alias("fits"),
        F.octet_length("data").cast("long").alias("payload_bytes"), F.when(F.col("data").isNotNull(), base32_sha1(F.col("data"))).alias("payload_digest")), "chunks")
    by_block = W.partitionBy("file", "block").orderBy("mid")
    size = F.col("len") + len(MAGIC)
    blocks = table.groupBy("file", "block").agg(F.sum(size).alias("bytes"))
    blocks = materialize(blocks.withColumn("at", F.coalesce(F.sum("bytes").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("file", "block", "at"), "blocks")
    placed = join_checked(table.withColumns({"inner": F.sum(size).over(by_block) - size, "nth": F.row_number().over(by_block)}), blocks, ["file", "block"], "inner", 32)
    placed = materialize(placed.withColumn("off", F.col("at") + F.col("inner") - len(MAGIC)).drop("at", "inner"), "placed")
    discard(table)
    cand = placed.where("off >= 0 and clen is not null and clen >= 0").select("file", "off", (F.col("off") + len(MAGIC) + F.col("head") + F.col("clen") + 4).alias("nxt"))
    true = materialize(reachable(cand), "true")
    rec = placed.join(true, ["file", "off"])
    whole = rec.where("fits or kind = 'revisit'")
    cols = ["kind", "rid", "refers", "url", "stated", "payload_bytes", "payload_digest"]
    out = whole.select(*cols)
    torn = materialize(rec.where("not fits and kind <> 'revisit'").select("file", "off", "head", "clen", *cols[:5]), "torn")
    if not torn.isEmpty():
        # over the files that hold torn records only: a chunk belongs to the last true record at or before it
        some = placed.join(torn.select("file").distinct(), "file", "left_semi").join(true.withColumn("is", F.lit(True)), ["file", "off"], "left")
        own = F.last(F.when(F.col("is"), F.col("off")), True).over(W.partitionBy("file").orderBy("off"))
        need = some.withColumn("own", own).join(torn.select("file", F.col("off").alias("own")), ["file", "own"], "left_semi").select("file", "block", "nth", "own")
        need = materialize(need, "need")
        again = raw.join(need.select("file", "block").distinct(), ["file", "block"], "left_semi")
        text = again.withColumn("nth", F.row_number().over(W.partitionBy("file", "block").orderBy("mid"))).join(need, ["file", "block", "nth"])
        glued = text.groupBy("file", "own").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "nth", "value"))), lambda x: x["value"]), MAGIC).alias("value"))
        full = torn.join(glued, (torn["file"] == glued["file"]) & (torn["off"] == glued["own"])).withColumn("data", _payload(F.col("value").cast("binary"), F.col("head"), F.col("clen")))
        out = out.unionAll(full.select(*cols[:5], F.octet_length("data").cast("long").alias("payload_bytes"), base32_sha1(F.col("data")).alias("payload_digest")))
    bare = lambda c: F.when(c != "<urn:page:~null>", F.url_decode(F.regexp_replace(c, "^<(?:urn:page:)?|>$", "")))
    return out.select(bare(F.col("rid")).alias("record_id"), F.col("kind").alias("record_type"), bare(F.col("refers")).alias("refers_to"), "url",
                      F.regexp_replace("stated", "^sha1:", "").alias("stated_digest"), "payload_bytes", "payload_digest")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records with payload_bytes and payload_digest of revisits taken from the response they refer to."""
    full = records.where("record_type = 'response'").select(F.col("record_id").alias("x_id"), F.col("payload_digest").alias("x_digest"), F.col("payload_bytes").alias("x_bytes")).distinct()
    again = records.where("record_type = 'revisit'").join(full, F.expr("refers_to = x_id and stated_digest = x_digest"), "left").withColumns({"payload_bytes": F.col("x_bytes"), "payload_digest": F.col("x_digest")})
    return records.where("record_type = 'response'").unionAll(again.select(*records.columns))


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """Defined cases: a null payload is empty; rows that repeat both id and payload are all responses; an
    empty table gives no rows; other columns are not looked at."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch_path(spark, "warc")
    write_warc(pages, path)
    records = materialize(read_warc(spark, path), "records")
    return resolve_revisits(records).select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP3_SQL = """
with p as (select page_id, coalesce(html, '') html, min(page_id) over (partition by coalesce(html, '')) first from pages),
bits as (select *, cast(cast(unhex(sha1(html)) as bit) as varchar) b from p)
select page_id, cast(strlen(html) as bigint) payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(
    16 * cast(substr(b, 5 * i + 1, 1) as int) + 8 * cast(substr(b, 5 * i + 2, 1) as int) + 4 * cast(substr(b, 5 * i + 3, 1) as int)
    + 2 * cast(substr(b, 5 * i + 4, 1) as int) + cast(substr(b, 5 * i + 5, 1) as int) as int), 1)), '') payload_digest,
  case when page_id = first then 'response' else 'revisit' end record_type, case when page_id <> first then first end refers_to
from bits
"""
