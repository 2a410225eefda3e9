"""Vector codes: vectors are cut into parts and each part is replaced by the nearest entry of its codebook, fitted by Yinyang Lloyd.

Components are integers, floor(scale * x), so sums, entries and squared distances are exact and reruns agree. A codebook starts as
that part of the `entries` vectors of smallest id. A round assigns every part to its nearest entry (squared Euclidean distance, ties to
the lower index) and replaces each entry by the floor of its parts' mean; entries that nobody chose stay.

Yinyang: a codebook's entries are put in groups of about ten that lie together. For every row and part the state holds, for each group, a
lower bound on the distance to the group's entries other than the chosen one. After the entries have moved, a bound falls by the
farthest move in its group; the distance to the chosen entry is computed. A group is scanned only if its bound isn't above that distance. Bounds are
rounded down and the distance up, so a group that is left out holds no nearer entry and no equal one; whatever is scanned is compared
in integers. The state is a table, written once a round (codes and half-precision bounds beside the integers, in the smallest type that
holds them all), and so outlives executors; sums go through Spark as one row for each task, part and entry.

Vectors that are null, empty, of another length than most, or hold null or non-finite components take no part, nor do those with an integer
beyond 2**62. Lengths that the number of parts doesn't divide are filled up with zeros. Null ids take part but are after all others where
the codebook starts; rows of equal ids are taken in the order of their components there. Fewer rows than `entries` make a smaller codebook. Errors beyond a
long are null, and so are sums of errors. Rows that repeat are rows of their own; null labels are one label; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_checked, materialize

PARTS, ENTRIES, ROUNDS, SCALE, GROUP = 16, 64, 2, 256, 10
STATE = "id long, label {label}, x binary, codes binary, low binary, met int"
STEP = 2048  # rows that are compared at a time


def usual_length(df: DataFrame, col: str) -> int:
    """The most common length of the vectors, the greater of equals; 0 without any."""
    top = df.where(F.col(col).isNotNull()).groupBy(F.size(col).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return 0 if top is None else top["n"]


def matrix(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions of the vectors of that length without null or non-finite components, and these vectors as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    right = np.asarray(column.value_lengths().fill_null(-1)) == length
    at = np.flatnonzero(right)
    flat = column.take(pa.array(at)).flatten()
    v = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), dtype=np.float64).reshape(len(at), length)
    fine = np.isfinite(v).all(axis=1)
    return at[fine], v[fine]


def integers(v: np.ndarray, scale: int, add: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Which rows fit, and floor(scale * v) + add of those as longs."""
    with np.errstate(over="ignore"):
        x = np.floor(v * scale)
    fits = (np.abs(x) < 2.0**62).all(axis=1)
    return fits, x[fits].astype(np.int64) + add


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a and b, exact: in doubles where all sums are below 2**53, else in Python's integers."""
    most = max([int(np.abs(x).max()) for x in (a, b) if x.size] or [0])
    kind = np.float64 if a.shape[1] * (2 * most) ** 2 < 2**53 else object
    d = a.astype(kind)[:, None, :] - b.astype(kind)[None, :, :]
    return (d * d).sum(axis=2)


def _down(d2: np.ndarray) -> np.ndarray:
    """Half-precision numbers that are surely not above the roots."""
    with np.errstate(over="ignore"):
        r = np.minimum(np.sqrt(d2.astype(np.float64)), 60000).astype(np.float16)
    return np.maximum(np.nextafter(np.nextafter(r, np.float16(0)), np.float16(0)), 0)


def _up(d2) -> np.ndarray:
    return np.sqrt(np.asarray(d2, dtype=object).astype(np.float64)) * (1 + 1e-12)


def groups_of(book: np.ndarray) -> np.ndarray:
    """Each entry's group: a few rounds of k-means over the entries, by themselves. Any grouping gives the same codes."""
    n = max(1, round(len(book) / GROUP))
    b = book.astype(np.float64)
    centres = b[np.linspace(0, len(b) - 1, n).astype(int)]
    for _ in range(5):
        own = ((b[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([b[own == g].mean(axis=0) if (own == g).any() else centres[g] for g in range(n)])
    return own


class Codebook:
    """The entries of every part, their groups and, after the first round, how far each group's farthest entry has moved."""

    def __init__(self, entries: np.ndarray, groups: np.ndarray | None = None, moved: np.ndarray | None = None):
        self.entries = entries  # (parts, entries, width)
        self.groups = np.stack([groups_of(e) for e in entries]) if groups is None else groups
        self.n = 1 + int(self.groups.max())
        self.drift = None
        if moved is not None:
            self.drift = np.stack([[max([_up(d) for d in moved[p][self.groups[p] == g]] or [0.0]) for g in range(self.n)] for p in range(len(entries))])

    def assign(self, x: np.ndarray, codes: np.ndarray | None, low: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """codes, bounds, squared distances (by row and part), and how many entries each row was compared with."""
        rows, parts = len(x), len(self.entries)
        new, bound = np.zeros((rows, parts), np.uint8), np.zeros((rows, parts, self.n), np.float16)
        error, met = np.zeros((rows, parts), object), np.zeros(rows, np.int64)
        for p in range(parts):
            new[:, p], bound[:, p], d2, n = self._part(p, x[:, p], None if codes is None else codes[:, p], None if low is None else low[:, p])
            error[:, p] = d2 if d2.dtype == object else d2.astype(np.int64)
            met += n
        return new, bound, error, met

    def _part(self, p: int, x: np.ndarray, code: np.ndarray | None, low: np.ndarray | None):
        entries, group = self.entries[p], self.groups[p]
        rows = np.arange(len(x))
        if code is None:  # the first round compares with all
            d2 = _distances(x, entries)
            best = d2.argmin(axis=1)
            error = d2[rows, best]
            d2[rows, best] = np.inf
            bound = np.stack([_down(d2[:, group == g].min(axis=1)) if (group == g).any() else np.full(len(x), 60000, np.float16) for g in range(self.n)], axis=1)
            return best, bound, error, np.full(len(x), len(entries))
        own = code.astype(np.int64)
        diff = x.astype(object) - entries[own].astype(object) if self._wide(x, entries) else (x - entries[own]).astype(np.float64)
        mine = (diff * diff).sum(axis=1)  # the distance to the entry chosen before, exactly
        fallen = low.astype(np.float64) - self.drift[p]
        bound = np.maximum(np.nextafter(fallen.astype(np.float16), np.float16(-np.inf)), 0).astype(np.float16)
        best, error, met = own.copy(), mine.copy(), np.ones(len(x), np.int64)
        scan = bound.astype(np.float64) <= _up(mine)[:, None]
        seen = []
        for g in range(self.n):
            members, at = np.flatnonzero(group == g), np.flatnonzero(scan[:, g])
            if not len(members) or not len(at):
                continue
            d2 = _distances(x[at], entries[members])
            met[at] += len(members)
            k = d2.argmin(axis=1)
            near, first = members[k], d2[np.arange(len(at)), k]
            d2[np.arange(len(at)), k] = np.inf
            seen.append((g, at, near, first, d2.min(axis=1)))
            nearer = (first < error[at]) | ((first == error[at]) & (near < best[at]))
            best[at[nearer]], error[at[nearer]] = near[nearer], first[nearer]
        for g, at, near, first, second in seen:  # the nearest of a scanned group that was not chosen
            bound[at, g] = _down(np.where(best[at] == near, second, first))
        left = np.flatnonzero(best != own)
        g = group[own[left]]
        bound[left, g] = np.minimum(bound[left, g], _down(mine[left]))
        return best, bound, error, met

    @staticmethod
    def _wide(x: np.ndarray, entries: np.ndarray) -> bool:
        most = max([int(np.abs(v).max()) for v in (x, entries) if v.size] or [0])
        return x.shape[1] * (2 * most) ** 2 >= 2**53


def _sums(state: DataFrame, parts: int, width: int, kind: str) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """How many parts chose each entry and the sums of their components: one row for each part and entry that was chosen."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple[int, int], int] = {}
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column(0).to_pylist()), kind).reshape(-1, parts, width).astype(np.int64)
            codes = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                entry, start = np.unique(codes[order, p], return_index=True)
                sizes = np.diff([*start, len(order)])
                high, rest = (np.add.reduceat(v, start, axis=0) for v in (x[order, p] >> 24, x[order, p] & 0xFFFFFF))
                for e, n, h, r in zip(entry, sizes, high, rest):
                    key = (p, int(e))
                    count[key] = count.get(key, 0) + int(n)
                    total[key] = total.get(key, 0) + np.concatenate([h, r])
        if count:
            keys = list(count)
            yield pa.RecordBatch.from_pydict({"p": pa.array([k[0] for k in keys], pa.int32()), "e": pa.array([k[1] for k in keys], pa.int32()), "n": [count[k] for k in keys], "s": [total[k].tolist() for k in keys]})

    got = state.select("x", "codes").mapInArrow(each, "p int, e int, n long, s array<long>")
    sums = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(2 * width)]
    return {(r["p"], r["e"]): (r["n"], [(r[f"s{i}"] << 24) + r[f"s{width + i}"] for i in range(width)]) for r in got.groupBy("p", "e").agg(F.sum("n").alias("n"), *sums).collect()}


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, report: dict | None = None) -> tuple[DataFrame, np.ndarray]:
    """Codes (id, label, code as bytes, error) of vectors (id, v array, label), as a written table, and the codebooks (parts, entries, width).
    entries: at most 256. report gets the number of entries that rows were compared with in each pass (`met`) and of rows."""
    spark, label = vectors.sparkSession, vectors.schema["label"].dataType.simpleString()
    vectors = vectors.select("id", "v", "label")
    length = usual_length(vectors, "v")
    width = -(-length // parts)
    state_of = STATE.format(label=label)
    none = spark.createDataFrame([], f"id long, label {label}, code binary, error long"), np.zeros((parts, 0, width), np.int64)
    if not length:
        return none

    def rows(b: pa.RecordBatch):
        at, v = matrix(b.column(1), length)
        fits, x = integers(v, scale)
        at = at[fits]
        return at, np.pad(x, ((0, 0), (0, parts * width - length)))

    def spread(batches):
        for b in batches:
            at, x = rows(b)
            if len(at):
                yield pa.RecordBatch.from_pydict({"n": [len(at)], "most": [int(np.abs(x).max())]})

    n, most = vectors.mapInArrow(spread, "n long, most long").agg(F.sum("n"), F.max("most")).first()
    if not n:
        return none
    kind = next((k for k in ("<i2", "<i4") if most < np.iinfo(k).max), "<i8")
    if report is not None:
        report.update(rows=n, met=[])

    def pack(batches):
        for b in batches:
            at, x = rows(b)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(2).take(pa.array(at)), _binary(x.astype(kind))], names=["id", "label", "x"])

    packed = vectors.mapInArrow(pack, f"id long, label {label}, x binary")
    first = packed.mapInArrow(_sort_keys(kind, parts * width), "id long, key array<long>").orderBy(F.col("id").asc_nulls_last(), "key").limit(entries).collect()
    book = Codebook(np.stack([np.array(r["key"], np.int64).reshape(parts, width) for r in first], axis=1))
    state = None
    for r in range(rounds + 1):
        last = r == rounds
        sent, fresh = book, r == 0  # entries of all parts: parts * entries * width longs

        def run(batches, sent=sent, fresh=fresh, last=last):
            for b in batches:
                for s in range(0, b.num_rows, STEP):
                    c = b.slice(s, STEP)
                    x = np.frombuffer(b"".join(c.column(2).to_pylist()), kind).reshape(-1, parts, width).astype(np.int64)
                    codes = low = None
                    if not fresh:
                        codes = np.frombuffer(b"".join(c.column(3).to_pylist()), np.uint8).reshape(-1, parts)
                        low = np.frombuffer(b"".join(c.column(4).to_pylist()), np.float16).reshape(-1, parts, sent.n)
                    codes, low, error, met = sent.assign(x, codes, low)
                    if last:
                        whole = [e if e < 2**63 else None for e in map(int, error.sum(axis=1))]
                        yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), _binary(codes), pa.array(whole, pa.int64()), pa.array(met.astype(np.int32))], names=["id", "label", "code", "error", "met"])
                    else:
                        yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), c.column(2), _binary(codes), _binary(low), pa.array(met.astype(np.int32))], names=["id", "label", "x", "codes", "low", "met"])

        before = state
        state = materialize((packed if fresh else before).mapInArrow(run, f"id long, label {label}, code binary, error long, met int" if last else state_of), f"codes{r}")
        if report is not None:
            report["met"].append(state.agg(F.sum("met")).first()[0])
        discard(before)
        if not last:
            sums, old = _sums(state, parts, width, kind), book.entries
            new = old.copy()
            for (p, e), (count, total) in sums.items():
                new[p, e] = [t // count for t in total]
            moved = ((new.astype(object) - old.astype(object)) ** 2).sum(axis=2)
            book = Codebook(new, book.groups, moved)
    return state.select("id", "label", "code", "error"), book.entries


def _binary(a: np.ndarray) -> pa.Array:
    """The rows of a as binary values."""
    n = len(a)
    data = np.ascontiguousarray(a)
    size = data[:1].nbytes if n else 0
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int64) * size).astype(np.int32)), pa.py_buffer(data)])


def _sort_keys(kind: str, width: int):
    def keys(batches):
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column(2).to_pylist()), kind).reshape(-1, width).astype(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), flat], names=["id", "key"])

    return keys


def book_digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: 16 parts, 64 entries, two rounds; error by row and by label, digest of the codebooks. See compress()
    for nulls, ties, repeats and empty tables."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    codes, book = compress(e)
    by_label = codes.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    out = join_checked(codes, by_label, F.col("label").eqNullSafe(F.col("of")), "inner", 24)
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(book_digest(book)).alias("codebooks_sha256"))
