"""Language model with interpolated modified Kneser-Ney smoothing, trigrams by default.

Counting: tasks hash the words of their texts (XXH64), sort and count trigrams u v w in bounded runs and emit one row of
packed arrays per bucket; a bucket takes some leading bits of v's hash and some of w's, so neither a hot context nor a hot
word lands in one task. Reducers merge a bucket, which holds all of a bigram's trigrams and so gives bigram counts and
distinct left contexts as well, and write it as sorted hash arrays. What is kept per word, per context v and per context u v is
summed from packed partial counts, in groups cut by further bits. Words themselves are counted map-side and summed by
their whole hash.

Scoring: workers memory-map the arrays and look up a batch's sorted hashes by binary search; only the pages they touch are
read. Where the shared folder is not a mounted file system, files are written and read whole through pyarrow's file systems, and a
worker holds at most HELD bytes of them.

Model (the start of a text is two context tokens of its own, the end is a token):
  p3(w|u v) = (c(u,v,w) - D3(c)) / c(u,v) + g3(u,v) p2(w|v)     over trigrams with c at least `cutoff`
  p2(w|v)   = (m(v,w) - D2(m)) / m(v) + g2(v) p1(w)
  p1(w)     = (m(w) - D1(m)) / M + h / (V + 1)
with c counts, m(v,w) and m(w) the distinct left contexts (of start bigrams their counts, as nothing stands before), m(v) and
M sums of these; D the three discounts of a level from its counts of counts; g and h the weights that make each level sum
to one. Unknown words get h / (V + 1). Rarer trigrams than `cutoff` are left to the bigram level (their mass is in g3): with
the default of 2 the model's trigrams are those that occur again. Order two is p2 with counts in place of m.
"""

from __future__ import annotations

import io
import json
import os
import zlib
from collections import Counter, OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, scratch_path

RUN = 1 << 21  # trigrams that a task sorts at once
BATCH = 1 << 19  # tokens scored at once
BUCKET_BYTES = 12 << 20  # bytes of text per bucket
CACHE = 1 << 20  # words whose hashes, or counts, a task remembers
MAPS = 4096  # files that a worker keeps mapped; a process may have some 65,000 maps
HELD = 256 << 20  # bytes of files that a worker holds where they can't be mapped
EXTRA = 4  # further bits that cut the groups of words and contexts
START, END = b" start", b" end"  # no word holds a blank


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Places(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def tokens(text: bytes | None) -> list[bytes]:
    """Words of the A-Z-lowered text (on bytes, lower() and split() touch ASCII only)."""
    return text.lower().split() if text else []


@dataclass(frozen=True)
class Layout:
    """How hashes make groups and keys: hi bits of the context v and lo bits of the word w make a bucket; the 32 bits after
    these are their keys in it. Words and contexts have groups of their own, cut by a few more bits."""

    hi: int
    lo: int

    def bucket(self, hv: np.ndarray, hw: np.ndarray) -> np.ndarray:
        return (_top(hv, self.hi) << np.int64(self.lo)) | _top(hw, self.lo)

    def key(self, hv: np.ndarray, hw: np.ndarray) -> np.ndarray:
        return (self.context_key(hv) << np.uint64(32)) | self.word_key(hw)

    @property
    def context_bits(self) -> int:
        return self.hi + EXTRA

    @property
    def word_bits(self) -> int:
        return self.lo + EXTRA

    def context_key(self, hv):
        return (hv >> np.uint64(32 - self.hi)) & np.uint64(0xFFFFFFFF)

    def word_key(self, hw):
        return (hw >> np.uint64(32 - self.lo)) & np.uint64(0xFFFFFFFF)

    def pair_group(self, hv: np.ndarray, hu: np.ndarray) -> np.ndarray:
        """Group of a context u v."""
        return (_top(hv, self.hi) << np.int64(EXTRA)) | _top(hu, EXTRA)

    def pair_key(self, hv: np.ndarray, hu: np.ndarray) -> np.ndarray:
        return (self.context_key(hv) << np.uint64(32)) | (hu >> np.uint64(32))


def _top(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _next(key32: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits of 32-bit keys."""
    return (key32.astype(np.int64) >> np.int64(32 - bits)) if bits else np.zeros(len(key32), np.int64)


def _pack(a: np.ndarray, dtype) -> bytes:
    return zlib.compress(np.ascontiguousarray(a, dtype).tobytes(), 1)


def _unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), dtype)


def _code(a: np.ndarray) -> bytes:
    """32-bit numbers as a dictionary, the commonest first, and byte planes of the places in it."""
    words, at, n = np.unique(a.astype(np.uint32), return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    place = np.empty(len(words), np.uint32)
    place[order] = np.arange(len(words))
    planes = place[at].view(np.uint8).reshape(-1, 4)
    wide = 1 if len(words) <= 1 << 8 else 2 if len(words) <= 1 << 16 else 4
    coded = [zlib.compress(planes[:, i].tobytes(), 1) for i in range(wide)]
    sizes = np.array([len(words), wide, *map(len, coded)], np.uint32)
    return sizes.tobytes() + words[order].tobytes() + b"".join(coded)


def _decode(b: bytes) -> np.ndarray:
    v, wide = np.frombuffer(b, np.uint32, 2).tolist()
    sizes = np.frombuffer(b, np.uint32, wide, 8).tolist()
    words, pos = np.frombuffer(b, np.uint32, v, 8 + 4 * wide), 8 + 4 * wide + 4 * v
    place = 0
    for i, n in enumerate(sizes):
        plane = np.frombuffer(zlib.decompress(b[pos : pos + n]), np.uint8)
        place, pos = place + (plane.astype(np.uint32) << np.uint32(8 * i)), pos + n
    return words[place]


def _merge(keys: list[np.ndarray], *values: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys and the sums of their values."""
    k = np.concatenate(keys)
    order = np.argsort(k, kind="stable")
    k = k[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
    return (k[first], *[np.add.reduceat(np.concatenate(v)[order].astype(np.int64), first) if len(k) else np.zeros(0, np.int64) for v in values])


def _by_group(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(group, kind="stable")
    g = group[order]
    cuts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else []
    for s, e in zip(cuts, [*cuts[1:], len(g)]):
        yield int(g[s]), order[s:e]


class Store:
    """Files of named arrays in a folder that all workers reach: mapped where it is mounted, else read whole."""

    def __init__(self, path: str, mounted: bool | None = None):
        url = urlparse(path)
        self.path, self.mounted = path, url.scheme in ("", "file") if mounted is None else mounted
        if self.mounted:
            self.root = url.path
            os.makedirs(self.root, exist_ok=True)
        else:
            self._fs()  # fails here, not in tasks, for a scheme that pyarrow can't open

    def _fs(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        return system, root

    def save(self, name: str, **arrays: np.ndarray) -> None:
        """Writes a file under its final name in one step, so a task may run twice."""
        parts, head, at = [], {}, 0
        for k, a in arrays.items():
            raw = np.ascontiguousarray(a).tobytes()
            head[k] = (str(a.dtype), list(a.shape), at)
            at += len(raw) + -len(raw) % 8
            parts.append(raw + b"\0" * (-len(raw) % 8))
        text = json.dumps(head).encode()
        text += b" " * (-len(text) % 8)
        blob = len(text).to_bytes(8, "little") + text + b"".join(parts)
        if self.mounted:
            mine = f"{self.root}/{name}.{os.getpid()}.{os.urandom(4).hex()}"
            with open(mine, "wb") as f:
                f.write(blob)
            os.replace(mine, f"{self.root}/{name}")
        else:
            system, root = self._fs()
            with system.open_output_stream(f"{root}/{name}") as f:
                f.write(blob)

    def load(self, name: str) -> tuple[dict[str, np.ndarray], int] | None:
        """The arrays of a file, and the bytes they hold in memory; None if there is none."""
        try:
            if self.mounted:
                buf = np.memmap(f"{self.root}/{name}", np.uint8, "r")
            else:
                system, root = self._fs()
                with system.open_input_file(f"{root}/{name}") as f:
                    buf = np.frombuffer(f.read(), np.uint8)
        except FileNotFoundError:
            return None
        n = int.from_bytes(buf[:8].tobytes(), "little")
        head = json.loads(io.BytesIO(buf[8 : 8 + n].tobytes()).read())
        out = {}
        for k, (dtype, shape, at) in head.items():
            size = int(np.prod(shape)) * np.dtype(dtype).itemsize
            out[k] = buf[8 + n + at : 8 + n + at + size].view(dtype).reshape(shape)
        return out, 0 if self.mounted else len(buf)


def _capped(a: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Counts as bytes, and those of 255 or more apart."""
    big = np.flatnonzero(a >= 255)
    return {name: np.minimum(a, 255).astype(np.uint8), name + "x": np.stack([big.astype(np.uint64), a[big].astype(np.uint64)])}


@dataclass(frozen=True)
class Model:
    store: Store
    layout: Layout
    order: int
    cutoff: int
    n: int  # training tokens
    v: int  # distinct training tokens
    texts: int
    d3: tuple[float, float, float]  # discounts of trigrams that occur once, twice, more often
    d2: tuple[float, float, float]
    d1: tuple[float, float, float]
    contexts: int  # sum of distinct left contexts over words: M
    spare: float  # h of the module's formula
    files: dict[str, np.ndarray]  # by kind, the numbers of the files that were written


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts from counts of counts; 0.5, 1, 1.5 where these are too few to tell."""
    if min(n1, n2, n3) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return tuple(min(max(x, 0.05), top) for x, top in zip(d, (0.95, 1.95, 2.95)))  # type: ignore[return-value]


def _count_words(text: DataFrame) -> DataFrame:
    """(h, c): each word's hash and count, summed in tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held: Counter = Counter()

        def flush():
            h = np.array([xxhash.xxh64_intdigest(w) for w in held], np.uint64).view(np.int64)
            out = pa.RecordBatch.from_arrays([pa.array(h), pa.array(list(held.values()), pa.int64())], names=["h", "c"])
            held.clear()
            return out

        for batch in batches:
            for x in batch.column(0):
                held.update(tokens(x.as_py()))
                held[END] += 1
                if len(held) > CACHE:
                    yield flush()
        if held:
            yield flush()

    return text.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def train(docs: DataFrame, text_col: str = "text", path: str | None = None, order: int = 3, cutoff: int = 2, mounted: bool | None = None) -> Model:
    """Counts the documents' n-grams and writes the model's arrays under path.

    Defined cases: null and empty texts are texts whose one token is the end; repeated rows count each; texts of any
    length are counted in pieces; an empty table gives a model by which every token is unknown; other columns are not looked at.
    """
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    store = Store(path or scratch_path(spark, "lm"), mounted)
    text = docs.select(F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    size = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(24, max(2, (size // BUCKET_BYTES).bit_length()))
    layout = Layout((bits + 1) // 2, bits // 2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        held: list[np.ndarray] = []  # pieces of texts, each after its two context tokens
        n = 0

        def flush():
            hu, hv, hw = (np.concatenate([h[i : len(h) - 2 + i] for h in held]) for i in range(3))
            out = []
            key, u = layout.key(hv, hw), (hu >> np.uint64(32)).astype(np.uint32)
            for g, at in _by_group(layout.bucket(hv, hw)):
                pair, place = np.unique(key[at], return_inverse=True)
                z, c = np.unique((place.astype(np.uint64) << np.uint64(32)) | u[at], return_counts=True)
                k, x = pair[z >> np.uint64(32)], z & np.uint64(0xFFFFFFFF)
                out.append((g, _code(k >> np.uint64(32)), _code(k & np.uint64(0xFFFFFFFF)), _code(x), _pack(c, np.uint32)))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 4))], names=["g", "v", "w", "u", "c"])

        for batch in batches:
            for x in batch.column(0):
                words = tokens(x.as_py())
                last = np.full(2, hashes[START], np.uint64)
                for at in range(0, len(words) + 1, RUN):
                    part = words[at : at + RUN]
                    if len(part) < RUN:
                        part.append(END)
                    h = np.concatenate([last, np.fromiter(map(hashes.__getitem__, part), np.uint64, len(part))])
                    held.append(h)
                    last = h[-2:]
                    n += len(part)
                    if n >= RUN:
                        yield flush()
                        held, n = [], 0
        if n:
            yield flush()

    runs = text.mapInArrow(count, "g int, v binary, w binary, u binary, c binary")
    start = np.array([Hashes()[START]], np.uint64)
    start_key, start_group = int(layout.context_key(start)[0]), int(_top(start, layout.hi)[0])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["g"].iloc[0])
        k = np.concatenate([(_decode(v).astype(np.uint64) << np.uint64(32)) | _decode(w) for v, w in zip(pdf["v"], pdf["w"])])
        u = np.concatenate([_decode(x) for x in pdf["u"]])
        c = np.concatenate([_unpack(x, np.uint32) for x in pdf["c"]]).astype(np.int64)
        by = np.lexsort((u, k))
        k, u, c = k[by], u[by], c[by]
        first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (u[1:] != u[:-1])]))
        k, u, c = k[first], u[first], np.add.reduceat(c, first)
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        pair, n = k[first], np.add.reduceat(c, first)
        v32, w32 = (pair >> np.uint64(32)).astype(np.uint32), (pair & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        left = np.diff(np.append(first, len(k)))  # distinct left contexts
        value = n if order == 2 else np.where((v32 == start_key) & (g >> layout.lo == start_group), n, left)
        kept = np.flatnonzero(c >= cutoff) if order == 3 else np.zeros(0, int)
        place = np.repeat(np.arange(len(pair), dtype=np.uint64), left)
        # a trigram's key is its bigram's place in the bucket and u
        store.save(f"b{g}", k=pair, **_capped(n, "c"), **_capped(value, "m"), t=(place[kept] << np.uint64(32)) | u[kept], **_capped(c[kept], "n"))
        out = [("n", g, ",".join(str(x) for x in [*[(c == i).sum() for i in (1, 2, 3, 4)], *[(value == i).sum() for i in (1, 2, 3, 4)]]).encode(), b"", b"")]
        hi, lo = np.int64(g >> layout.lo), np.int64(g & ((1 << layout.lo) - 1))
        for part, at in _by_group((hi << np.int64(EXTRA)) | _next(v32, EXTRA)):
            x, total, n1, n2, n3 = _merge([v32[at]], [value[at]], [value[at] == 1], [value[at] == 2], [value[at] > 2])
            out.append(("u", part, _pack(x, np.uint32), _pack(total, np.uint64), _pack(np.stack([n1, n2, n3]), np.uint64)))
        for part, at in _by_group((lo << np.int64(EXTRA)) | _next(w32, EXTRA)):
            x, m = np.unique(w32[at], return_counts=True)
            out.append(("m", part, _pack(x, np.uint32), _pack(m, np.uint64), b""))
        if len(kept):
            key, x, c = (k[kept] & ~np.uint64(0xFFFFFFFF)) | u[kept], u[kept], c[kept]
            for part, at in _by_group((hi << np.int64(EXTRA)) | _next(x, EXTRA)):
                y, total, n1, n2, n3 = _merge([key[at]], [c[at]], [c[at] == 1], [c[at] == 2], [c[at] > 2])
                out.append(("s", part, y.tobytes(), _pack(total, np.uint64), _pack(np.stack([n1, n2, n3]), np.uint64)))
        return pd.DataFrame(out, columns=["kind", "g", "a", "b", "c"])

    # tasks in proportion to buckets, whatever the session's number of shuffle partitions
    merged = materialize(runs.repartition(max(4, 1 << bits >> 1), "g").groupBy("g").applyInPandas(merge, "kind string, g int, a binary, b binary, c binary"), "counts")
    eight = merged.where("kind = 'n'").select(F.split(F.col("a").cast("string"), ",").cast("array<long>").alias("a"))
    eight = eight.agg(*[F.coalesce(F.sum(F.col("a")[i]), F.lit(0)).alias(f"n{i}") for i in range(8)]).first()
    d3, d2 = discounts(*eight[:4]), discounts(*eight[4:])

    def finish(key, pdf: pd.DataFrame) -> pd.DataFrame:
        kind, g = key[0], int(key[1])
        keys = [_unpack(a, np.uint32) if kind == "u" else np.frombuffer(a, np.uint64) for a in pdf["a"]]
        cols = [_unpack(c, np.uint64).reshape(3, -1) for c in pdf["c"]]
        k, total, n1, n2, n3 = _merge(keys, [_unpack(b, np.uint64) for b in pdf["b"]], *[[c[i] for c in cols] for i in range(3)])
        mass = np.stack([n1, n2, n3], axis=1) @ np.array(d2 if kind == "u" else d3)
        # of a context v its total and the weight of the level below, of a context u v what its trigrams take
        store.save(f"{kind}{g}", k=k, **({"n": total.astype(np.uint64), "x": mass / total} if kind == "u" else {"x": total - mass}))
        return pd.DataFrame({"kind": [kind], "g": [g]})

    done = materialize(merged.where("kind in ('u', 's')").groupBy("kind", "g").applyInPandas(finish, "kind string, g int"), "done")

    def finish_words(key, words: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        g = int(key[0])
        w, c = words["h"].to_numpy(np.int64).view(np.uint64), words["c"].to_numpy(np.uint64)
        by = np.argsort(w)
        w, c = w[by], c[by]
        k, m = _merge([_unpack(a, np.uint32) for a in marks["a"]] or [np.zeros(0, np.uint32)], [_unpack(b, np.uint64) for b in marks["b"]] or [np.zeros(0, np.uint64)])
        mine = layout.word_key(w).astype(np.uint32)
        at = np.minimum(np.searchsorted(k, mine), max(len(k) - 1, 0))
        m = np.where(k[at] == mine, m[at], 0) if len(k) else np.zeros(len(w), np.int64)
        store.save(f"w{g}", k=w, c=c, m=m.astype(np.uint64))
        return pd.DataFrame([(g, int(c.sum()), len(w), *[int((m == i).sum()) for i in (1, 2, 3, 4)], int(m.sum()))], columns=["g", "n", "v", "m1", "m2", "m3", "m4", "m"])

    names = ("n", "v", "m1", "m2", "m3", "m4", "m")
    vocabulary = _count_words(text).withColumn("g", F.shiftrightunsigned("h", 64 - layout.word_bits).cast("int"))
    both = vocabulary.groupBy("g").cogroup(merged.where("kind = 'm'").select("g", "a", "b").groupBy("g"))
    sums = materialize(both.applyInPandas(finish_words, ", ".join(f"{c} long" for c in ("g", *names))), "sums")
    s = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    # the numbers of the files that tasks wrote, as many as there are buckets
    written = [merged.where("kind = 'n'").select(F.lit("b").alias("kind"), "g"), done, sums.select(F.lit("w").alias("kind"), F.col("g").cast("int"))]
    files = {r["kind"]: np.sort(np.array(r["g"], np.int64)) for t in written for r in t.groupBy("kind").agg(F.collect_set("g").alias("g")).collect()}
    for t in (merged, done, sums):
        discard(t)
    d1 = discounts(s["m1"], s["m2"], s["m3"], s["m4"])
    more = s["v"] - s["m1"] - s["m2"]
    spare = (d1[0] * s["m1"] + d1[1] * s["m2"] + d1[2] * more) / s["m"] if s["m"] else 1.0
    model = Model(store, layout, order, cutoff, s["n"], s["v"], 0, d3, d2, d1, s["m"], spare, files)
    end = Reader(model).words(np.array([Hashes()[END]], np.uint64))[0]
    return Model(store, layout, order, cutoff, s["n"], s["v"], int(end[0]), d3, d2, d1, s["m"], spare, files)


class Reader:
    """Lookups of a model."""

    def __init__(self, model: Model):
        self.m, self.files, self.held = model, OrderedDict(), 0

    def _file(self, name: str) -> dict[str, np.ndarray]:
        if name in self.files:
            self.files.move_to_end(name)
        else:
            self.files[name] = self._load(name)
            self.held += self.files[name][1]
            while (self.held > HELD or len(self.files) > MAPS) and len(self.files) > 1:
                self.held -= self.files.popitem(last=False)[1][1]
        return self.files[name][0]

    def _load(self, name: str) -> tuple[dict[str, np.ndarray], int]:
        """A file's arrays; none for a bucket that nothing fell into. A file that training wrote and that can't be found is an error."""
        there = self.m.files.get(name[0])
        at = np.searchsorted(there, int(name[1:])) if there is not None else 0
        if there is None or at == len(there) or there[at] != int(name[1:]):
            return {}, 0
        got = self.m.store.load(name)
        if got is None:
            raise FileNotFoundError(f"file {name} of the language model is not in {self.m.store.root}: lost, or the folder is not mounted on this worker")
        return got

    @staticmethod
    def _find(k: np.ndarray | None, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are in a sorted array, and their places there. Keys are looked up in order."""
        if k is None or not len(k) or not len(keys):
            return np.zeros(0, int), np.zeros(0, int)
        order = np.argsort(keys)
        at = np.minimum(np.searchsorted(k, keys[order].astype(k.dtype)), len(k) - 1)
        ok = k[at] == keys[order]
        return order[ok], at[ok]

    @staticmethod
    def _counts(f: dict[str, np.ndarray], name: str, pos: np.ndarray) -> np.ndarray:
        c = np.asarray(f[name][pos]).astype(float)
        top = c == 255
        if top.any():
            x = f[name + "x"]
            c[top] = x[1][np.searchsorted(x[0], pos[top].astype(np.uint64))]
        return c

    def words(self, hw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(training count, p1) of each word hash."""
        c, m = np.zeros(len(hw)), np.zeros(len(hw))
        for g, at in _by_group(_top(hw, self.m.layout.word_bits)):
            f = self._file(f"w{g}")
            hit, pos = self._find(f.get("k"), hw[at])
            if len(hit):
                c[at[hit]], m[at[hit]] = f["c"][pos], f["m"][pos]
        d = np.array([0.0, *self.m.d1])[np.minimum(m, 3).astype(int)]
        return c, np.where(m > 0, (m - d) / max(self.m.contexts, 1), 0.0) + self.m.spare / (self.m.v + 1)

    def contexts(self, hv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(m(v), g2) of each word hash as a context; 0 and 1 for contexts never seen."""
        n, x = np.zeros(len(hv)), np.ones(len(hv))
        key = self.m.layout.context_key(hv)
        for g, at in _by_group(_top(hv, self.m.layout.context_bits)):
            f = self._file(f"u{g}")
            hit, pos = self._find(f.get("k"), key[at])
            if len(hit):
                n[at[hit]], x[at[hit]] = f["n"][pos], f["x"][pos]
        return n, x

    def grams(self, hu: np.ndarray, hv: np.ndarray, hw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(c(v,w), m(v,w), c(u,v,w) where kept) of each trigram."""
        c, m, t = np.zeros(len(hv)), np.zeros(len(hv)), np.zeros(len(hv))
        key = self.m.layout.key(hv, hw)
        for g, at in _by_group(self.m.layout.bucket(hv, hw)):
            f = self._file(f"b{g}")
            hit, pos = self._find(f.get("k"), key[at])
            if not len(hit):
                continue
            at = at[hit]
            c[at], m[at] = self._counts(f, "c", pos), self._counts(f, "m", pos)
            third, place = self._find(f["t"], (pos.astype(np.uint64) << np.uint64(32)) | (hu[at] >> np.uint64(32)))
            if len(third):
                t[at[third]] = self._counts(f, "n", place)
        return c, m, t

    def taken(self, hu: np.ndarray, hv: np.ndarray) -> np.ndarray:
        """What the trigrams of each context u v take of its count."""
        out = np.zeros(len(hv))
        key = self.m.layout.pair_key(hv, hu)
        for g, at in _by_group(self.m.layout.pair_group(hv, hu)):
            f = self._file(f"s{g}")
            hit, pos = self._find(f.get("k"), key[at])
            if len(hit):
                out[at[hit]] = f["x"][pos]
        return out

    def log10(self, words: list[bytes], seq: list[np.ndarray], hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the tokens of pieces (places in `words`, the first of which is START; two context tokens lead each
        piece): (log10 p, known, base log10)."""
        h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        c1, p1 = self.words(h)
        n2, g2 = self.contexts(h)
        x = np.concatenate(seq)
        ends = np.cumsum([len(s) for s in seq])
        first = np.zeros(len(x), bool)
        first[[0, *ends[:-1]]] = True
        second = np.roll(first, 1)
        v, w = x[:-1], x[1:]  # bigrams, those across pieces too, which nothing reads
        u = np.concatenate([[0], x[:-2]])
        c, m, t = self.grams(h[u], h[v], h[w])
        at = np.flatnonzero(~first & ~second) - 1  # the bigram of each token
        u, v, w = u[at], v[at], w[at]
        value = c[at] if self.m.order == 2 else m[at]
        d = np.array([0.0, *self.m.d2])[np.minimum(value, 3).astype(int)]
        p = np.where(n2[v] > 0, (value - d) / np.maximum(n2[v], 1) + g2[v] * p1[w], p1[w])
        if self.m.order == 3:
            n = np.where((u == 0) & (v == 0), self.m.texts, c[at - 1])
            d = np.array([0.0, *self.m.d3])[np.minimum(t[at], 3).astype(int)]
            mass = np.zeros(len(at))
            may = n >= self.m.cutoff
            mass[may] = self.taken(h[u[may]], h[v[may]])
            p = np.where(n > 0, (t[at] - d + (n - mass) * p) / np.maximum(n, 1), p)
        base = np.log10((c1 + 0.5) / (self.m.n + 0.5 * (self.m.v + 1)))
        return np.log10(p), c1[w] > 0, base[w]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) per input row; score is log10 of the text's probability.

    Defined cases: a null text is empty (its one token is the end); rows that repeat are scored each; ids may be
    null; an empty table gives no rows; other columns are not looked at; texts of any length are scored in pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, hashes = Reader(model), Hashes()
        for batch in batches:
            n = batch.num_rows
            total, known, base, score_ = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            ids = Places({START: 0})
            seq: list[np.ndarray] = []
            doc: list[int] = []
            held = 0

            def flush():
                rows = np.repeat(doc, [len(s) - 2 for s in seq])
                lp, kn, bs = reader.log10(list(ids), seq, hashes)
                for out, x in ((score_, lp), (base, bs), (known, kn), (total, np.ones(len(rows)))):
                    out += np.bincount(rows, weights=x, minlength=n).astype(out.dtype)

            for i, x in enumerate(batch.column(1)):
                words = tokens(x.as_py())
                last = [START, START]
                for at in range(0, len(words) + 1, BATCH):
                    part = words[at : at + BATCH]
                    if len(part) < BATCH:
                        part.append(END)
                    part = last + part
                    seq.append(np.fromiter(map(ids.__getitem__, part), np.int64, len(part)))
                    doc.append(i)
                    held += len(part) - 2
                    last = part[-2:]
                    if held >= BATCH:
                        flush()
                        ids, seq, doc, held = Places({START: 0}), [], [], 0
            if held:
                flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(known), pa.array(base), pa.array(score_)], names=["id", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double")


def held_out(id_col):
    """True for a fifth of the ids, by their checksum; a null id is in training."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
