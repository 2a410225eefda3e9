"""SimHash near-duplicates: 64-bit fingerprints compared bit-sliced, linked within a Hamming radius.

Fingerprints: words of the A-Z-lowered text are runs other than ASCII white space; shingles of three
words (repeats included, joined by one space; the whole sequence if there are fewer words) are hashed
with XXH64, seed 42; a bit of the fingerprint is 1 if it is set in more than half of the hashes.
No words (or a null text) gives fingerprint zero, linked like any other.

Search: two fingerprints within radius r differ in at most r of d blocks, so they agree in some d-r
of them. Each fingerprint is filed once for every choice of d-r blocks; d rises with the number of
distinct fingerprints (every d is exact, it only trades copies for bucket size). Buckets are compared
bit-sliced: bit planes are stored vertically, carry-save counters add one plane to many distances at
once, and rows of a block are abandoned when all their distances exceed the radius. A bucket larger
than HOT is split into sub-blocks whose pairs are dealt to separate tasks. Each comparison emits a
spanning forest of the links it found, never all pairs, so the output stays linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_checked, match_ids, materialize, plain_name
from .graph import connected_components

HOT = 4096  # members of a bucket that one task compares at once
CHUNK = 256  # small buckets are compared together in chunks of about this many
BLOCK_WORDS = 1 << 17  # 64-bit words of each counter held at a time


def simhash64(data: bytes | None) -> int:
    import xxhash

    words = data.lower().split() if data else []  # on bytes, both touch ASCII only
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < 3:
        return h(b" ".join(words), 42)
    n, total = len(words) - 2, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = words[at : at + (1 << 15) + 2]
        hashes = np.array([h(b" ".join(s), 42) for s in zip(part, part[1:], part[2:])], dtype=">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, fp) and the long columns of `carry`: fp is the fingerprint's 64 bits as a signed long."""
    carry = carry or {}
    names = ["id", "fp", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash64(x.as_buffer().to_pybytes() if x.is_valid else None) for x in b.column(1).cast(pa.binary())], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], names=names)

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *[c.alias(k) for k, c in carry.items()])
    return kept.mapInArrow(run, ", ".join(f"{k} long" for k in names))


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit j of all fingerprints, packed into 64-bit words."""
    m = len(fps)
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(m, 8), axis=1)
    padded = np.zeros((64, -(-m // 64) * 64), np.uint8)
    padded[:, :m] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def forest(fps: np.ndarray, radius: int = 3) -> np.ndarray:
    """For each fingerprint the index of its component's first member, linking all pairs within radius."""
    m = len(fps)
    label = np.arange(m)
    if m < 2:
        return label
    plane, bits = planes(fps), radius.bit_length()
    width, full = plane.shape[1], np.uint64(0xFFFFFFFFFFFFFFFF)
    for at in range(0, m, max(1, BLOCK_WORDS // width)):
        rows = np.arange(at, min(m, at + max(1, BLOCK_WORDS // width)))
        done = np.zeros((len(rows), width * 64), np.uint8)  # pairs that don't count: j <= i, and the padding
        done[:, m:] = 1
        done[:, :m] = np.arange(m)[None, :] <= rows[:, None]
        over = np.packbits(done, axis=1, bitorder="little").view(np.uint64)
        count = [np.zeros_like(over) for _ in range(bits)]
        for j in range(64):
            mask = np.where((fps[rows] >> np.uint64(63 - j)) & np.uint64(1), full, np.uint64(0))
            carry = plane[j][None, :] ^ mask[:, None]
            for k in range(bits):
                carry, count[k] = count[k] & carry, count[k] ^ carry
            over |= carry
            if j >= 15 and j % 8 == 7:
                live = ~(over == full).all(axis=1)
                if not live.all():
                    rows, over, count = rows[live], over[live], [c[live] for c in count]
                    if not len(rows):
                        break
        if not len(rows):
            continue
        at_most = _within(count, radius, bits, full) & ~over
        near = np.unpackbits(at_most.view(np.uint8), axis=1, bitorder="little")[:, :m]
        for i, row in zip(rows, near):
            js = np.flatnonzero(row)
            if len(js) and (label[js] != label[i]).any():
                roots = np.unique(np.append(label[js], label[i]))
                label[np.isin(label, roots)] = roots[0]
    return label


def _within(count: list[np.ndarray], radius: int, bits: int, full: np.uint64) -> np.ndarray:
    """Bits of the pairs whose counter is at most radius (all of them when radius fills the counter)."""
    if radius + 1 == 1 << bits:
        return np.full_like(count[0], full)
    ok = np.zeros_like(count[0])
    for v in range(radius + 1):
        same = np.full_like(ok, full)
        for k in range(bits):
            same &= count[k] if v >> k & 1 else ~count[k]
        ok |= same
    return ok


def block_scheme(n: int, radius: int) -> list[tuple[tuple[int, int], ...]]:
    """The (shift, width) blocks of each table for n distinct fingerprints."""
    for d in range(radius + 1, radius + 6):
        ends = [64 * i // d for i in range(d + 1)]
        blocks = [(ends[i], ends[i + 1] - ends[i]) for i in range(d)]
        tables = list(combinations(blocks, d - radius))
        if n <= 64 << min(sum(w for _, w in t) for t in tables):
            break
    return tables


def links(classes: DataFrame, n: int, radius: int = 3) -> DataFrame:
    """(src, dst): edges among the distinct fingerprints of `classes` (column fp) that span all links."""
    if not 1 <= radius <= 31:
        raise ValueError("radius must be from 1 to 31")
    keys = []
    for t, table in enumerate(block_scheme(n, radius)):
        key, at = F.lit(0).cast("long"), 0
        for shift, width in table:
            part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
            key, at = key.bitwiseOR(F.shiftleft(part, at)), at + width
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("k")))
    filed = classes.select("fp", F.explode(F.array(*keys)).alias("b")).select("fp", "b.t", "b.k")
    hot = materialize(filed.groupBy("t", "k").count().where(F.col("count") > HOT), "hot")
    if hot.isEmpty():
        dealt = filed.select("t", "k", F.lit(0).alias("x"), F.lit(0).alias("y"), "fp")
    else:
        sub = join_checked(filed, hot, ["t", "k"], "left", 40).withColumn(
            "n", F.coalesce(F.ceil(F.col("count") / (HOT // 2)).cast("int"), F.lit(1))).withColumn("i", F.expr("cast(pmod(xxhash64(fp), n) as int)"))
        dealt = sub.select("t", "k", "i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"), "fp").select(
            "t", "k", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_n = 0

        def out(fps: np.ndarray):
            u = np.unique(fps.view(np.uint64))
            root = forest(u, radius)
            moved = np.flatnonzero(root != np.arange(len(u)))
            return pa.RecordBatch.from_arrays([pa.array(u[moved].view(np.int64)), pa.array(u[root[moved]].view(np.int64))], names=["src", "dst"])

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
            fps = b.column(4).to_numpy(zero_copy_only=False)
            new = np.zeros(len(fps), bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            first = tuple(c[0] for c in cols)
            new[0] = last is None or first != last
            last = tuple(c[-1] for c in cols)
            start = 0
            for cut in np.flatnonzero(new):
                if held_n + cut - start >= CHUNK:
                    yield out(np.concatenate([*held, fps[start:cut]]))
                    held, held_n, start = [], 0, cut
            held.append(fps[start:].copy())
            held_n += len(fps) - start
        if held_n:
            yield out(np.concatenate(held))

    return (dealt.repartition("t", "k", "x", "y").sortWithinPartitions("t", "k", "x", "y", "fp").mapInArrow(compare, "src long, dst long"))


def components(classes: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, root) of the fingerprints of `classes` (column fp, distinct) that have links; root is the
    component's least fingerprint."""
    edges = materialize(links(classes, classes.count(), radius).distinct(), "links")
    comp = materialize(connected_components(edges).withColumnRenamed("node", "fp"), "comp")
    discard(edges)
    return comp


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """(id, fp, component_id) per input row; component_id is the least id reachable over links.

    Defined cases: a null text counts as no words (fingerprint zero); rows with a null id keep it and
    never name a component unless all its ids are null (then it is null); repeated rows each get their
    row; an empty table gives no rows; other columns are not looked at.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "fp")
    classes = materialize(fps.groupBy("fp").agg(F.min("id").alias("least")), "fpc")
    linked = classes.join(components(classes, radius), "fp")
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = materialize(linked.join(ids, "root").select("fp", "component_id"), "compid")
    named = classes.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return fps.join(named, "fp").select("id", "fp", "component_id")


def op8_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """The documents of `docs`, one row of each group of near-duplicates: the one with the least id (of rows
    that repeat an id, the one least by a hash of its columns). Rows are judged one by one: of a repeated id
    each group keeps its own row, and rows with a null id are kept only where no row of their group has an
    id, again one of each group. All columns come back."""
    key = plain_name(docs, "row")
    rows = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    fps = materialize(fingerprints(rows, id_col, text_col, {"tie": F.xxhash64(*hashed), "row": F.col(key)}), "fp")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tie", "row")).alias("best")
    classes = materialize(fps.groupBy("fp").agg(first), "fpc")
    rooted = classes.join(components(classes, radius), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = materialize(rooted.groupBy("root").agg(F.min("best").alias("best")).select("best.row"), "kept")
    drop = materialize(fps.select("row").join(kept, "row", "left_anti"), "drop")
    out = rows if drop.isEmpty() else match_ids(rows, drop, key)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
