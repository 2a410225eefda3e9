"""Resharding by minimum-cost flow: move the fewest bytes from old shards into new capacities.

A sharded corpus is a folder of block files and a manifest: each file with its shard, rows, bytes and the slot of
its first row (a row's slot is that plus its place in the file). The flow runs between old shards (what they hold)
and new shards (what they should hold); a byte that stays costs nothing, one that moves costs one. Its solution
cuts the block files of an old shard, in their order, into intervals, one per new shard, the one that stays first. Files in an
interval that stays are not touched. Files in one that goes are rewritten under their new shard. Files that straddle a
cut (at most one per transfer) are dealt document by document, largest first, to the interval with the most room left,
so shards come out near equal to within small documents, whatever ids and texts repeat.

Scale: texts are never shuffled. They are written once as block files and the affected ones once more. Blocks
grow with the table so that there are never more than about 2 * MAX_BLOCKS; the plan over them is made on the driver and
the manifest, of bounded size, is broadcast.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_path, discard, join_checked, materialize, plain_name, scratch_path

BLOCK_ROWS = 4096  # rows of a block file, unless the table would have more than MAX_BLOCKS of these
MAX_BLOCKS = 1 << 16
MANIFEST = "file string, shard int, base long, rows long, bytes long"


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """The cheapest flow that sends all supply into capacity; cost(i, j) per unit. Successive shortest
    paths with potentials over the bipartite graph: small, since its nodes are shards."""
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are below the supply")
    left, room = list(supply), list(capacity)
    flow: dict[tuple[int, int], int] = {}
    pot = [0] * (n + m)
    while any(left):
        dist, prev = [float("inf")] * (n + m), [-1] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                dist[i] = 0
                heap.append((0, i))
        heapq.heapify(heap)
        while heap:
            d, v = heapq.heappop(heap)
            if d > dist[v]:
                continue
            if v < n:
                nexts = [(n + j, cost(v, j)) for j in range(m)]
            else:
                nexts = [(i, -cost(i, v - n)) for i in range(n) if flow.get((i, v - n))]
            for u, c in nexts:
                nd = d + c + pot[v] - pot[u]
                if nd < dist[u]:
                    dist[u], prev[u] = nd, v
                    heapq.heappush(heap, (nd, u))
        end = min((j for j in range(m) if room[j]), key=lambda j: dist[n + j] + pot[n + j])
        pot = [p + (d if d < float("inf") else 0) for p, d in zip(pot, dist)]
        path = [n + end]
        while prev[path[-1]] >= 0:
            path.append(prev[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end], *[flow[(path[k + 1], path[k] - n)] for k in range(1, len(path) - 1, 2)] or [left[path[0]]])
        for a, b in zip(path, path[1:]):
            if a < n:
                flow[(a, b - n)] = flow.get((a, b - n), 0) + amount
            else:
                flow[(b, a - n)] -= amount
        left[path[0]] -= amount
        room[end] -= amount
    return {k: v for k, v in flow.items() if v}


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def text_size(text: Column) -> Column:
    """Bytes of the text in UTF-8, plus one."""
    return (F.coalesce(F.octet_length(text.cast("string")), F.lit(0)) + 1).cast("long")


@dataclass(frozen=True)
class Moves:
    """What a resharding did: bytes that the flow moves, bytes of the documents that changed their shard (they differ by
    less than a document for each cut), files that were left alone and files that were rewritten."""

    cost: int
    moved: int
    kept: int
    rewritten: int


def _versions(spark: SparkSession, path: str) -> list[int]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(f.getPath().getName()[1:]) for f in fs.listStatus(hadoop)) if fs.exists(hadoop) else []


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The block files of the corpus as it is now: file, shard, base, rows, bytes; at most about 2 * MAX_BLOCKS rows."""
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/v{_versions(spark, path)[-1]}")


def _files(spark: SparkSession, path: str, paths: list[str] | None = None, schema=None) -> tuple[DataFrame, Column, Column]:
    """Block files (all, or those given), and the columns of a row's file (its path below files/) and its place in it."""
    reader = spark.read.option("recursiveFileLookup", True)
    df = (reader.schema(schema) if schema is not None else reader).parquet(*(paths if paths is not None else [f"{path}/files"]))
    meta = df.metadataColumn("_metadata")
    return df, F.substring_index(meta["file_path"], "/files/", -1), meta["row_index"]


def _blocks(spark: SparkSession, path: str, folder: str, schema) -> list:
    """(path, file, rows, bytes) of each file of a folder, by name: a row per block file."""
    df, name, _ = _files(spark, path, [f"{path}/files/{folder}"], schema)
    meta = df.metadataColumn("_metadata")
    size = F.col(f"`{df.columns[-1]}`")
    return sorted(df.select(name.alias("f"), meta["file_path"].alias("p"), size.alias("s")).groupBy("f", "p").agg(F.count("*").alias("n"), F.sum("s").alias("s")).collect())


def _commit(spark: SparkSession, path: str, version: int, blocks: list[tuple[str, int, int, int]]) -> None:
    """Writes the manifest of (file, shard, rows, bytes): with it the new layout is in force."""
    at: dict[int, int] = {}
    rows = []
    for f, shard, n, size in blocks:
        rows.append((f, shard, at.get(shard, 0), n, size))
        at[shard] = at.get(shard, 0) + n
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v{version}")


def lay_out(docs: DataFrame, path: str, shards: int = 12, text_col: str = "text") -> None:
    """Writes docs as a corpus of block files under path: runs of files, in the order of docs' partitions, are its shards.

    Defined cases: an empty table writes a corpus without rows; nulls, repeated rows and ids, texts of any length and
    columns of any name are written as they are, with one more column, a row's bytes.
    """
    spark = docs.sparkSession
    n = docs.count()
    rows = max(1, min(BLOCK_ROWS, n // (8 * shards)), -(-n // MAX_BLOCKS))
    sized = docs.withColumn(plain_name(docs, "block_bytes"), text_size(F.col(f"`{text_col}`")))
    sized.coalesce(MAX_BLOCKS).write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(f"{path}/files/v0")
    blocks = _blocks(spark, path, "v0", sized.schema)
    _commit(spark, path, 0, [(f, k * shards // len(blocks), n_, s) for k, (f, _, n_, s) in enumerate(blocks)])


def reshard_files(spark: SparkSession, path: str, shards: int = 16, capacities: list[int] | None = None) -> Moves:
    """Gives the corpus under path new shards (of even capacities, unless these are given) and rewrites the block
    files that the flow affects; all others keep their path and content. Old shard i is new shard i where both exist."""
    version = _versions(spark, path)[-1]
    held: dict[int, list] = {}
    for r in sorted(manifest(spark, path).collect(), key=lambda r: (r["shard"], r["base"])):  # bounded: a row per block file
        held.setdefault(r["shard"], []).append(r)
    n_old = max(held, default=-1) + 1
    supply = [sum(r["bytes"] for r in held.get(i, [])) for i in range(n_old)]
    capacity = capacities or even_capacities(sum(supply), shards)
    flow = min_cost_flow(supply, capacity, lambda i, j: int(i != j))
    kept, goes, torn = [], {}, []
    for i, blocks in held.items():
        cuts, at = [], 0
        for j in sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j)):
            cuts.append((at, at + flow[(i, j)], j))
            at += flow[(i, j)]
        at = 0
        for r in blocks:
            parts = [(min(hi, at + r["bytes"]) - max(lo, at), j) for lo, hi, j in cuts if lo < at + r["bytes"] and hi > at]
            at += r["bytes"]
            if len(parts) > 1:
                torn.append((r["file"], i, parts))
            elif parts[0][1] == i:
                kept.append((r["file"], i, r["rows"], r["bytes"]))
            else:
                goes.setdefault(parts[0][1], []).append((r["file"], r["bytes"]))
    where, schema = {}, spark.read.option("recursiveFileLookup", True).parquet(f"{path}/files").schema
    affected = {f for f, *_ in torn} | {f for fs in goes.values() for f, _ in fs}
    if affected:
        df, name, _ = _files(spark, path, None, schema)
        meta = df.metadataColumn("_metadata")
        where = {r["f"]: r["p"] for r in df.select(name.alias("f"), meta["file_path"].alias("p")).distinct().collect() if r["f"] in affected}  # as bounded
    new, moved, gone = [], sum(b for fs in goes.values() for _, b in fs), None
    if affected:
        to = plain_name(spark.createDataFrame([], schema), "new_shard")
        runs = [_files(spark, path, [where[f] for f, _ in fs], schema)[0].withColumn(to, F.lit(j)) for j, fs in sorted(goes.items())]
        if torn:
            rooms = {f: parts for f, _, parts in torn}

            def deal(pdf):
                heap = [[-room, k, j] for k, (room, j) in enumerate(rooms[pdf["f"].iloc[0]])]
                heapq.heapify(heap)
                pdf = pdf.sort_values(["s", "i"], ascending=[False, True])
                out = []
                for s in pdf["s"]:
                    out.append(heap[0][2])
                    heapq.heapreplace(heap, [heap[0][0] + int(s), *heap[0][1:]])
                pdf["k"], pdf["t"] = number[pdf["f"].iloc[0]], out
                return pdf[["k", "i", "s", "t"]]

            number = {f: k for k, (f, *_) in enumerate(torn)}
            df, name, place = _files(spark, path, [where[f] for f, *_ in torn], schema)
            sizes = df.select(name.alias("f"), place.alias("i"), F.col(f"`{df.columns[-1]}`").alias("s"))
            gone = materialize(sizes.groupBy("f").applyInPandas(deal, "k int, i long, s long, t int"), "dealt")  # a group is one block
            was = spark.createDataFrame([(k, i) for k, (_, i, _) in enumerate(torn)], "k int, o int")
            moved += gone.join(F.broadcast(was), "k").where("t <> o").agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0]
            k = F.element_at(F.create_map(*[F.lit(x) for f in number.items() for x in f]), name)  # a torn file for each cut at most
            boxed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), k.alias("k"), place.alias("i"))
            runs.append(join_checked(boxed, gone.drop("s"), ["k", "i"], "inner", 32).select("row.*", F.col("t").alias(to)))
        rows = max(BLOCK_ROWS, -(-sum(r["rows"] for b in held.values() for r in b) // MAX_BLOCKS))
        out = reduce(DataFrame.unionAll, runs).coalesce(MAX_BLOCKS)  # a task of the whole files holds one new shard
        out.write.mode("overwrite").option("maxRecordsPerFile", rows).partitionBy(to).parquet(f"{path}/files/v{version + 1}")
        for f, p, n, size in _blocks(spark, path, f"v{version + 1}", schema):
            new.append((f, int(p.split("/")[-2].split("=")[1]), n, size))
        discard(gone)
    _commit(spark, path, version + 1, [*sorted(kept, key=lambda b: b[1]), *new])
    for f in sorted(affected):
        delete_path(spark, where[f])
    return Moves(sum(v for (i, j), v in flow.items() if i != j), moved, len(kept), len(affected))


def read_shards(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The corpus under path: the columns that were laid out, then slot (from 0 in each shard) and shard; these two are
    named otherwise where the corpus has such columns."""
    df, name, place = _files(spark, path, None, schema)
    cols = df.columns[:-1]
    shard, slot = plain_name(df, "shard"), plain_name(df, "slot")
    boxed = df.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), name.alias("file"), place.alias("place"))
    j = join_checked(boxed, manifest(spark, path).select("file", F.col("shard").alias("to"), "base"), "file", "inner", 128)
    return j.select("row.*", (F.col("base") + F.col("place")).alias(slot), F.col("to").alias(shard))


def reshard(docs: DataFrame, path: str, shards: int = 16, old_shards: int = 12, text_col: str = "text", capacities: list[int] | None = None) -> DataFrame:
    """docs laid out under path in old_shards shards, then resharded; returns them as read_shards() does.

    Defined cases: a null text has size 1; null and repeated ids and repeated rows are documents of their own, placed
    one by one; ties in size go by place; an empty table gives no rows; columns of docs come back unchanged.
    """
    spark = docs.sparkSession
    lay_out(docs, path, old_shards, text_col)
    reshard_files(spark, path, shards, capacities)
    sized = docs.withColumn(plain_name(docs, "block_bytes"), F.lit(0).cast("long"))
    return read_shards(spark, path, sized.schema)


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    out = reshard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), scratch_path(spark, "shards"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", text_size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
                      F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
