"""Whitening: principal components of a covariance that loses nothing to cancellation.

Entries become integers, floor(scale * c) + offset. The fit list is each distinct vector once. Its sums are exact. The covariance is
accumulated in double-double: vectors are centred (an exact integer difference, then the mean's fraction as a double-double); a block of
centred vectors is cut into slices of so few bits that the products of two slices, summed over the block, are exact in doubles (an
error-free transformation of the outer products, done by matrix products); each exact sum is added to the high part by two-sum,
whose error goes to the low part. Every task emits its high and low parts, one row for each row of the matrix, and these are merged by
the same two-sums, first in PARTIAL groups of tasks, then over the groups.

The eigenvectors come from LAPACK's divide and conquer on the tridiagonal form (numpy's eigh is syevd) of the high part, and are then
refined against both parts with double-double products (the iteration of Ogita and Aishima), so that small eigenvalues beside very large ones
are right too (those far below are solved again among themselves). Signs: the entry of greatest magnitude is positive.

Whitened values are the centred vector's projection over the root of the eigenvalue. Their own covariance over the fit list is measured, centred and
accumulated in the same way; its greatest departure from the identity stands in every row.

Vectors that are null, empty, of another length than most, or hold null or non-finite entries take no part, nor do those with an integer
beyond 2**62. Components beyond the rank (eigenvalues below RANK times the sum of all) have null whitened values and stay out of the measured
identity. Ids may be null or repeat: each row has its own result. A deviation beyond a long is null. An empty table gives an empty one.
On the driver: the matrix of the components, length squared, and nothing that grows with rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .pq import _binary, integers, matrix, usual_length

SCALE, OFFSET, KEEP = 64, 1_000_000, 16
BLOCK = 1024
BITS = 21  # of a slice: 2 * BITS + log2(BLOCK) <= 53, less the sign
SLICES = 5
PARTIAL = 64
RANK = 2.0**-90
FAR = 2.0**-20
STEP = 4096


def two_sum(a, b):
    """a + b rounded, and what rounding lost."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(a: tuple, b: tuple) -> tuple:
    """The sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    return two_sum(s, e + (a[1] + b[1]))


def double_double(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longs as double-doubles, exactly."""
    high = x.astype(np.float64)
    back = np.where(np.abs(high) < 2.0**63, high, 0).astype(np.int64)
    return high, np.where(np.abs(high) < 2.0**63, x - back, 0).astype(np.float64)


def slices(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Matrices that add up to high + low (to SLICES * BITS bits of the greatest entry), each a multiple of its own unit by integers of BITS bits."""
    top = float(np.abs(high).max()) if high.size else 0.0
    if not top:
        return []
    unit, out = 2.0 ** (int(np.ceil(np.log2(top))) + 1 - BITS), []
    for _ in range(SLICES):
        grid = 1.5 * 2.0**52 * unit
        part = (high + grid) - grid
        out.append(part)
        high, low = two_sum(high - part, low)
        unit *= 2.0**-BITS
    return out


def product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """a.T @ b of double-double matrices of at most BLOCK rows: exact products of slices, added from small to large."""
    left, right = slices(*a), slices(*b)
    out = (np.zeros((a[0].shape[1], b[0].shape[1])), np.zeros((a[0].shape[1], b[0].shape[1])))
    for i, j in sorted(((i, j) for i in range(len(left)) for j in range(len(right)) if i + j < SLICES), key=sum, reverse=True):
        out = add(out, (left[i].T @ right[j], 0.0))
    return out


class Centre:
    """The mean of a fit list as integers and double-double fractions."""

    def __init__(self, sums: list[int], n: int):
        self.n, self.sums = n, sums
        self.whole = np.array([round(Fraction(s, n)) for s in sums], np.int64)
        rest = [Fraction(s, n) - int(w) for s, w in zip(sums, self.whole)]
        self.high = np.array([float(r) for r in rest])
        self.low = np.array([float(r - Fraction(float(r))) for r in rest])

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high, low = double_double(x - self.whole)
        return add((high, low), (-self.high, -self.low))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S)^2 of every row, in integers."""
        most = (int(np.abs(x).max()) if x.size else 0) * self.n + max(map(abs, self.sums), default=0)
        if most < 2**62:
            d = x * self.n - np.array(self.sums, np.int64)
            greatest = int(np.abs(d).max()) if d.size else 0
        if most >= 2**62 or greatest * greatest * x.shape[1] >= 2**63:
            d = x.astype(object) * self.n - np.array(self.sums, object)
        return [int(v) if v < 2**63 else None for v in (d * d).sum(axis=1)]


def gathered(rows: DataFrame, task_of, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum over all tasks of double-double matrices. task_of: a mapInArrow function that yields rows (i, task, high, low)."""

    def merged(key: tuple[pa.Scalar, ...], batch: pa.Table) -> pa.Table:
        order = np.argsort(batch["task"].to_numpy())
        high, low = (np.stack(batch[c].to_pylist())[order] for c in ("high", "low"))
        total = (np.zeros(high.shape[1]), np.zeros(high.shape[1]))
        for h, t in zip(high, low):
            total = add(total, (h, t))
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([key[-1].as_py() if len(key) > 1 else 0], pa.int64()), "high": [total[0].tolist()], "low": [total[1].tolist()]})

    form = "i int, task long, high array<double>, low array<double>"
    each = rows.mapInArrow(task_of, form).withColumn("group", F.col("task") % PARTIAL)
    some = each.groupBy("i", "group").applyInArrow(merged, form)
    out = np.zeros((2, height, width))
    for r in some.groupBy("i").applyInArrow(merged, form).collect():
        out[0, r["i"]], out[1, r["i"]] = r["high"], r["low"]
    return out[0], out[1]


def summed(of_block, height: int, width: int):
    """A mapInArrow function: the sum of of_block(vectors) over a task's blocks of vectors, as rows (i, task, high, low)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = (np.zeros((height, width)), np.zeros((height, width))), False
        for b in batches:
            x = longs(b.column(0))
            for s in range(0, len(x), BLOCK):
                total, seen = add(total, of_block(x[s : s + BLOCK])), True
        if seen:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(height), pa.int32()), "task": pa.array([task] * height, pa.int64()), "high": total[0].tolist(), "low": total[1].tolist()})

    return run


def outer(d: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return product(d, d)


def column_sums(d: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return product((np.ones((len(d[0]), 1)), np.zeros((len(d[0]), 1))), d)


def longs(column: pa.Array) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), "<i8").reshape(len(data), -1) if data else np.zeros((0, 0), np.int64)


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows and the sums of each position, in integers of any size: high and low halves are summed apart."""

    def each(batches):
        n, high, low = 0, 0, 0
        for b in batches:
            if b.num_rows:
                x = longs(b.column(0))
                n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            size = len(high)
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(size), pa.int32()), "n": pa.array([n] * size, pa.int64()), "high": high, "low": low})

    got = fit.mapInArrow(each, "i int, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    rows = sorted(got.collect(), key=lambda r: r["i"])
    return (rows[0]["n"], [(r["high"] << 32) + r["low"] for r in rows]) if rows else (0, [])


def eigen(high: np.ndarray, low: np.ndarray, rounds: int = 3, floor: float = 0.0) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Eigenvalues, falling, and eigenvectors (columns, double-double) of a symmetric double-double matrix.

    Eigenvectors of eigenvalues far below the greatest come out of the first solution mixed with each other: once they are parted
    from the others, the matrix is projected on them and solved again at its own scale. floor: below it eigenvalues are noise."""
    size = len(high)
    scale = 2.0 ** -int(np.ceil(np.log2(np.abs(high).max()))) if high.any() else 1.0
    a = (high * scale, low * scale)
    _, v = np.linalg.eigh(a[0])
    x = (v[:, ::-1].copy(), np.zeros((size, size)))
    values = np.zeros(size)
    for _ in range(rounds):
        x, values, s = _refined(a, x)
    if size > 1 and 0 < values[0] and (few := int((values >= FAR * values[0]).sum())) < size and floor < values[few:].max() / scale:
        r, below = _refined(a, x)[2], slice(few, size)
        rest, turn = eigen(r[0][below, below], r[1][below, below], rounds, max(floor, RANK * float(values[0]) / scale) * scale)
        turned = blocked(tuple(m[:, below].T.copy() for m in x), turn)
        x = tuple(np.hstack([m[:, :few], t]) for m, t in zip(x, turned))
        values = np.concatenate([values[:few], rest])
    order = np.argsort(-values, kind="stable")
    x = tuple(m[:, order] for m in x)
    sign = np.where(x[0][np.abs(x[0]).argmax(axis=0), np.arange(size)] < 0, -1.0, 1.0)
    return values[order] / scale, (x[0] * sign, x[1] * sign)


def _refined(a: tuple, x: tuple) -> tuple:
    """Better eigenvectors, the eigenvalues by the given ones, and the matrix projected on the given ones."""
    size = len(a[0])
    eye = np.eye(size)
    s = blocked(x, blocked(a, x))
    r = np.add(*add((eye, np.zeros_like(eye)), tuple(-m for m in blocked(x, x))))
    values = (np.diag(s[0]) + np.diag(s[1])) / (1 - np.diag(r))
    off = (s[0] + s[1]) * (1 - eye)
    gap = values[None, :] - values[:, None]
    # pairs whose eigenvalues differ by no more than what is unknown, or that would turn far, are only made orthogonal
    unknown = 2 * (np.linalg.norm(off, 2) + np.linalg.norm(a[0], 2) * np.linalg.norm(r, 2))
    with np.errstate(divide="ignore", invalid="ignore"):
        e = (off + values[None, :] * r) / gap
        e = np.where((np.abs(gap) > unknown) & (np.abs(e) < 2.0**-12), e, r / 2)
    e[np.arange(size), np.arange(size)] = np.diag(r) / 2
    return add(x, blocked(tuple(m.T.copy() for m in x), (e, np.zeros_like(e)))), values, s


def blocked(a: tuple, b: tuple) -> tuple:
    """product() of any number of rows."""
    out = (np.zeros((a[0].shape[1], b[0].shape[1])),) * 2
    for s in range(0, len(a[0]), BLOCK):
        out = add(out, product((a[0][s : s + BLOCK], a[1][s : s + BLOCK]), (b[0][s : s + BLOCK], b[1][s : s + BLOCK])))
    return out


class Whitening:
    """What a fit gives: the centre, the kept components and their shares, and the measured departure from the identity."""

    def __init__(self, centre: Centre, values: np.ndarray, vectors: tuple[np.ndarray, np.ndarray], keep: int):
        self.centre, total = centre, float(values.sum())
        keep = min(keep, len(values))
        self.values, self.vectors = values[:keep], tuple(m[:, :keep].copy() for m in vectors)
        self.explained = [float(v) / total if total > 0 else 0.0 for v in self.values]
        self.alive = np.array([total > 0 and v > RANK * total for v in self.values], bool)
        self.root = np.sqrt(np.where(self.alive, self.values, 1.0))
        self.identity_error = 0.0

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whitened values of integer vectors, as double-doubles; columns beyond the rank hold no meaning."""
        high, low = self.centre(x)
        main, rest = blocked((high.T.copy(), low.T.copy()), self.vectors)
        return two_sum(main / self.root, rest / self.root)


def fit(packed: DataFrame, keep: int = KEEP) -> Whitening | None:
    """Fits on the distinct vectors x (binary, longs) of a table; None if there is none."""
    distinct = materialize(packed.select("x").distinct(), "fit")
    n, sums = exact_sums(distinct)
    if not n:
        discard(distinct)
        return None
    size, centre = len(sums), Centre(sums, n)
    high, low = gathered(distinct, summed(lambda x: outer(centre(x)), size, size), size, size)
    values, vectors = eigen(high, low)
    w = Whitening(centre, values / n, vectors, keep)
    alive, k = np.flatnonzero(w.alive), len(w.alive)
    if len(alive):
        # the whitened values' own means first, then their covariance about them
        mean = tuple(-m / n for m in gathered(distinct, summed(lambda x: column_sums(w.project(x)), 1, k), 1, k))
        high, low = gathered(distinct, summed(lambda x: outer(add(w.project(x), mean)), k, k), k, k)
        w.identity_error = float(np.abs((high / n - np.eye(k))[np.ix_(alive, alive)]).max())
    discard(distinct)
    return w


def pack(vectors: DataFrame, length: int, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(id, x as binary longs) of the valid rows of (id, v)."""

    def run(batches):
        for b in batches:
            at, v = matrix(b.column(1), length)
            fits, x = integers(v, scale, offset)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[fits])), _binary(x)], names=["id", "x"])

    return vectors.select("id", "v").mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, x binary")


def whiten(vectors: DataFrame, keep: int = KEEP, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error of vectors (id, v array)."""
    kind = vectors.schema["id"].dataType.simpleString()
    form = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    length = usual_length(vectors, "v")
    packed = pack(vectors, length, scale, offset) if length else None
    w = fit(packed, keep) if length else None
    if w is None:
        return vectors.sparkSession.createDataFrame([], form)

    def run(batches):
        k = len(w.alive)
        for b in batches:
            for s in range(0, b.num_rows, STEP):
                ids, x = b.column(0).slice(s, STEP), longs(b.column(1).slice(s, STEP))
                values = np.concatenate([w.project(x[t : t + BLOCK])[0] for t in range(0, len(x), BLOCK)])
                dead, each, m = np.tile(~w.alive, len(x)), pa.array(np.repeat(np.arange(len(x)), k)), len(x) * k
                yield pa.RecordBatch.from_arrays([
                    ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(m, w.centre.n, np.int64)),
                    pa.array(w.centre.deviations(x), pa.int64()).take(each), pa.array(values.ravel(), mask=dead), pa.array(np.tile(w.explained, len(x))), pa.array(np.full(m, w.identity_error)),
                ], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return packed.mapInArrow(run, form)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of all embeddings. See the module's docstring for nulls, ties, repeats and empty tables."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return whiten(e).withColumnRenamed("id", "vec_id")
