"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust a score.

Base kinds (email, ip, card, phone) keep every match that passes its validator. Extra kinds (iban,
ssn, local_phone, and secrets: key by a known prefix, secret by an assignment) are kept where the validator passes and the score,
raised by context words within CONTEXT characters, reaches THRESHOLD. All of it is built-in SQL functions: a cheap `contains` or
one-character test keeps most texts away from the regular expressions; matches and the pieces
between them are exploded, and a running sum over the pieces of one document gives the positions,
so a document with very many matches stays linear.

Patterns are written so that Java's engine neither recurses nor rescans a run: possessive groups,
and look-behind so that a run is tried from its start only. Both give the same leftmost matches.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Kind, what a text must hold to be searched, pattern.
KINDS = [
    ("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", "0", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", "0", r"[0-9](?:[ -]?[0-9])++"),
    ("phone", "+", r"\+[0-9][ ().0-9-]+[0-9]"),
    ("iban", "0", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
    ("ssn", "0", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("local_phone", "0", r"(?<![0-9+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"),
    ("key", ("AKIA", "ASIA", "gh", "xox", "sk-", "eyJ", "PRIVATE KEY"), r"(?<![A-Za-z0-9_-])(?:A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])|gh[oprsu]_[A-Za-z0-9]{36,255}|xox[abprs]-[A-Za-z0-9-]{10,255}|sk-[A-Za-z0-9_-]{20,255}|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)|-----BEGIN (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----"),
    ("secret", ("=", ":"), r"(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|(?:api|access|secret|private)[_-]?key)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?[A-Za-z0-9+/_.~-]{8,}+"),
]
BASE = ["email", "ip", "card", "phone"]
#: Score of a validated match, and context words that raise it by BOOST.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "local_phone": 0.4, "key": 0.9, "secret": 0.6}
WORDS = {
    "email": "e-?mail|mail|contact|correo|courriel",
    "ip": "ip|address|host|server|adresse",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|t[ée]l[ée]phone|tel[ée]fono",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|taxpayer",
    "local_phone": "phone|tel|call|mobile|fax|telefon|t[ée]l[ée]phone|tel[ée]fono",
    "key": "key|secret|token|aws|auth|login",
    "secret": "user|login|auth|account|key|secret",
}
BOOST = 0.3
THRESHOLD = 0.6
CONTEXT = 40


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn checksum."""
    back = F.reverse(digits)

    def add(acc, i):
        v = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if an IBAN (no blanks, upper case) passes its mod-97 checksum."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))

    def add(acc, ch):
        v = F.ascii(ch)
        return F.when(v >= 65, acc * 100 + v - 55).otherwise(acc * 10 + v - 48) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda x: x != ""), F.lit(0), add) == 1


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    octet = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (
        F.when(kind == "ip", match.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
        .when(kind == "card", F.when(n.between(14, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(10, 15))
        .when(kind == "iban", mod97(F.replace(match, F.lit(" "), F.lit(""))))
        .when(kind == "ssn", ~match.rlike("^(?:000|666|9)|-00-|-0000$"))
        .when(kind == "secret", match.rlike("[:=][ \\t]*[\"']?(?=[^ ]*[0-9])(?=[^ ]*[A-Za-z])"))
        .otherwise(True)
    )


def _placed(kind: str):
    """From a match and its number: the match, the length of the gap before it and the text nearby."""

    def one(x, i):
        before, after = F.get(f"p_{kind}", i), F.get(f"p_{kind}", i + 1)
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(before).alias("gap"), x.alias("match"),
                        F.concat(F.right(before, F.lit(CONTEXT)), F.lit(" "), F.left(after, F.lit(CONTEXT))).alias("near"))

    return one


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, kind, start, end, match, score): the kept spans, positions in code points, end
    exclusive; each input row also gives one row with a null kind. uid tells rows that repeat an id apart.

    Defined cases: a null text is empty; rows that repeat an id, or have a null id, are documents of
    their own; an empty table gives no rows; other columns are not looked at. An extra span that overlaps
    a base match of the same document is dropped.
    """
    text = F.col("text")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", "text", text.rlike("[0-9]").alias("digit"))
    shape = "array<struct<kind:string,i:int,gap:int,match:string,near:string>>"
    parts = [F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit(None).cast("string").alias("match"), F.lit(None).cast("string").alias("near"))).cast(shape)]
    # matches and pieces are columns of their own: inside a lambda they would be searched for again for each match
    cols = {}
    for kind, needs, pattern in KINDS:
        has = F.col("digit") if needs in ("0", "+") else F.lit(True)
        if needs != "0":
            has = has & reduce(or_, [text.contains(x) for x in ((needs,) if isinstance(needs, str) else needs)])
        cols[f"m_{kind}"] = F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        cols[f"p_{kind}"] = F.when(has, F.split(text, pattern))
    rows = rows.select("uid", "doc_id", *[c.alias(n) for n, c in cols.items()])
    parts += [F.coalesce(F.transform(f"m_{kind}", _placed(kind)), F.array().cast(shape)).cast(shape) for kind, _, _ in KINDS]
    spread = rows.select("uid", "doc_id", F.explode(F.concat(*parts)).alias("s")).select("uid", "doc_id", "s.*")
    each = W.partitionBy("uid", "kind").orderBy("i")
    size = F.length("match")
    placed = spread.withColumn("end", F.sum(F.col("gap") + size).over(each)).withColumn("start", F.col("end") - size)
    kind = F.col("kind")
    context = F.lit(False)
    score = F.lit(None).cast("double")
    for k, _, _ in KINDS:
        context = F.when(kind == k, F.lower("near").rlike(rf"(?<!\p{{L}})(?:{WORDS[k]})(?!\p{{L}})")).otherwise(context)
        score = F.when(kind == k, F.lit(SCORES[k])).otherwise(score)
    scored = placed.withColumn("score", F.round(score + F.when(context, BOOST).otherwise(0.0), 2)).where(kind.isNull() | _valid(kind, F.col("match")))
    scored = scored.where(kind.isNull() | kind.isin(BASE) | (F.col("score") >= THRESHOLD))
    order = W.partitionBy("uid").orderBy(F.col("start").asc_nulls_first(), F.when(kind.isin(BASE), 0).otherwise(1))
    base_end = F.when(kind.isin(BASE), F.col("end"))
    base_start = F.when(kind.isin(BASE), F.col("start"))
    before = F.max(base_end).over(order.rowsBetween(W.unboundedPreceding, 0))
    after = F.min(base_start).over(order.rowsBetween(0, W.unboundedFollowing))
    kept = scored.withColumn("over", (before > F.col("start")) | (after < F.col("end"))).where(kind.isNull() | kind.isin(BASE) | ~F.coalesce("over", F.lit(False)))
    return kept.select("uid", "doc_id", "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "match", "score")


def op4_pii(spark, sf_dir: str) -> DataFrame:
    kind = F.col("kind")
    order = F.lit(len(KINDS))
    for i, (k, _, _) in enumerate(KINDS):
        order = F.when(kind == k, i).otherwise(order)
    span = F.struct(F.col("start"), order.alias("o"), F.concat_ws(":", "kind", "start", "end").alias("s"))

    def joined(c):
        return F.array_join(F.transform(F.sort_array(c), lambda x: x["s"]), ",")

    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet")).groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"), *[F.count_if(kind == k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.collect_list(F.when(kind.isin(BASE), span))), 256).alias("base_sha256"), joined(F.collect_list(F.when(kind.isNotNull(), span))).alias("spans"),
        F.count("kind").alias("n_spans"), F.count_if(kind.isin("key", "secret")).alias("n_secret"), F.max("score").alias("top_score"),
    ).drop("uid")
