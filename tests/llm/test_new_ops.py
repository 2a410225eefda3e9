"""Whitening, byte-pair encoding and vector codes against plain versions."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkloom.llm import bpe, pq, registry, whiten

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["'", "'s", "'re", "'r", "ve", "l", " ", "1", "́", "e", "Σ", "İ", "한", "ᄒ", "ᅡ", "ᆫ", "Ᲊ", "\U00013461", "<|endoftext|>", "<|start", "\x1c", "\x85", " ", "😀", "é", "՘", "\n"]


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(bpe.read_file(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def hard_texts(merges, n):
    rnd, names = random.Random(5), [x.replace("</w>", "") for x in merges.names[512:20000]]
    for k in range(n):
        if k % 4 == 0:
            yield "".join(rnd.choice("abehrtinSlo") for _ in range(rnd.randrange(1, 5000)))
        elif k % 4 == 1:
            yield "".join(x for x in rnd.choices(names, k=rnd.randrange(1, 600)) if x.isalpha())
        elif k % 4 == 2:
            yield "".join(rnd.choice(ODD) for _ in range(rnd.randrange(1, 400)))
        else:
            yield rnd.choice("a-h!l'") * rnd.randrange(1, 4000)


def test_encoding_equals_the_library_whatever_the_chunks(merges, library):
    rnd, whole = random.Random(6), bpe.Encoder(merges)
    for text in hard_texts(merges, 80):
        want = library.encode(text, add_special_tokens=False).ids
        small = bpe.Encoder(merges, chunk=rnd.choice([7, 16, 50, 300]), block=merges.lookahead + rnd.choice([1, 40]))
        assert [i for b in whole.encode(text) for i in b] == want
        assert [i for b in small.encode(text) for i in b] == want
        d = bpe.Decoder(merges)
        assert "".join(d.push([i]) for i in want) + d.close() == library.decode(want, skip_special_tokens=False)


def test_transducer_keeps_a_bounded_tail_and_never_takes_a_token_back(merges):
    t, letters = bpe.Transducer(merges, block=1000), random.Random(7)
    out = []
    for _ in range(300):
        out += t.push("".join(letters.choice("thernsaoi") for _ in range(100)).encode())
        assert len(t.kept) <= 1000 + merges.lookahead + max(merges.size)
    assert len(out) > 1000 and merges.lookahead < 1000


def toy(rules):
    import json

    alphabet = bpe.byte_alphabet()
    words = alphabet + [c + "</w>" for c in alphabet] + [u + v for u, v in rules]
    step = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    split = [{"type": "Split", "pattern": {"Regex": bpe.PIECES}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    return json.dumps({"model": {"type": "BPE", "end_of_word_suffix": "</w>", "vocab": {w: i for i, w in enumerate(words)}, "merges": [list(r) for r in rules]}, "normalizer": {"type": "Sequence", "normalizers": step}, "pre_tokenizer": {"pretokenizers": split}, "decoder": None, "added_tokens": []})


def test_lookahead_follows_chains_of_rules():
    assert bpe.Merges(toy([])).lookahead == 0
    assert bpe.Merges(toy([("a", "b")])).lookahead == 1
    # a c after xab makes bc, so that ab is not made and x takes the a
    m = bpe.Merges(toy([("b", "c"), ("a", "b"), ("x", "a")]))
    assert m.lookahead == 3
    # through the left spine: abcd begins with a, bcd with b, cd with c
    spine = bpe.Merges(toy([("c", "d"), ("b", "c"), ("b", "cd"), ("a", "bcd"), ("y", "abcd")]))
    assert spine.lookahead == 4
    with pytest.raises(ValueError):
        bpe.Merges(toy([("ab", "c"), ("a", "b")]))


def test_stable_tokens_stay_in_every_continuation():
    rules = [("a", "a"), ("b", "a"), ("aa", "b"), ("a", "b"), ("ba", "aab"), ("aab", "ba")]
    m, rnd = bpe.Merges(toy(rules)), random.Random(8)
    for _ in range(3000):
        text = bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 40)))
        cut = rnd.randrange(len(text))
        full, part = (m.merge([m.inner[b] for b in t]) for t in (text, text[:cut]))
        at = 0
        for k, token in enumerate(part):
            at += m.size[token]
            if at <= cut - m.lookahead:
                assert full[k] == token


def test_encode_and_decode_columns(spark, merges, library):
    texts = ["Hello there, you're the 12th ☃!", None, "", "naïve café " * 3, "<|startoftext|> x"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "k int, text string, d int")
    rows = bpe.decode(bpe.decode(bpe.encode(df, PATH), PATH), PATH, out="plain", how="text").orderBy("k").collect()
    for t, r in zip(texts, rows):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False) and r["d"] == 7
    assert rows[0]["plain"] == "hello there , you 're the 1 2 th ☃! " and rows[3]["plain"] == "naïve café " * 3
    assert rows[4]["plain"] == "<|startoftext|>x "
    # a sign whose bytes lie in several tokens comes out once its last byte is there
    d, ids = bpe.Decoder(merges, "text"), library.encode("𒀀", add_special_tokens=False).ids
    parts = [d.push([i]) for i in ids]
    assert len(ids) > 1 and parts[0] == "" and "".join(parts) + d.close() == "𒀀 "


def vectors(seed=3, size=10, rows=400):
    rng = np.random.default_rng(seed)
    v = [(int(i), [float(np.float32(x)) for x in rng.normal(size=size) * np.linspace(0.2, 3, size)], int(i) % 5 if i % 7 else None) for i in rng.permutation(rows)]
    v += [(1000 + i, v[3][1], 2) for i in range(60)]  # a very common vector
    v += [(5, v[9][1], None), (5, v[8][1], 3), (None, v[7][1], 1), (None, v[7][1], 1)]
    bad = [(2000, None, 1), (2001, [float("nan")] * size, 1), (2002, [1.0] * (size - 1) + [None], 1), (2003, [float("inf")] + [0.0] * (size - 1), None), (2004, [], 1), (2005, [1.0] * (size + 1), 1)]
    return v, bad


def folder_of(spark, tmp_path, rows, schema="vec_id long, embedding array<double>, label int"):
    spark.createDataFrame(rows, schema).withColumns({"x": F.lit(1), "v": F.lit(2), "id": F.lit(3), "code": F.lit(4), "n": F.lit(5)}).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def brute_codes(v, parts=16, entries=64, rounds=2, scale=256):
    size = len(v[0][1])
    width = -(-size // parts)
    ints = [[int(np.floor(np.float64(x) * scale)) for x in e] + [0] * (width * parts - size) for _, e, _ in v]
    order = sorted(range(len(v)), key=lambda i: (v[i][0] is None, v[i][0] or 0, ints[i]))[:entries]
    cut = lambda x, p: x[p * width : (p + 1) * width]
    book = [[cut(ints[i], p) for i in order] for p in range(parts)]
    near = lambda x, b: min((sum((a - c) ** 2 for a, c in zip(x, e)), k) for k, e in enumerate(b))
    for r in range(rounds + 1):
        got = [[near(cut(x, p), book[p]) for p in range(parts)] for x in ints]
        if r < rounds:
            for p in range(parts):
                for k in range(len(book[p])):
                    mine = [cut(x, p) for x, g in zip(ints, got) if g[p][1] == k]
                    if mine:
                        book[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    return got, book


@pytest.mark.parametrize("size,factor", [(64, 1.0), (10, 1.0), (16, 1e6)])
def test_op13_equals_brute_force(spark, tmp_path, size, factor):
    v, bad = vectors(size=size)
    v = [(i, [x * factor for x in e], label) for i, e, label in v]
    folder = folder_of(spark, tmp_path, v + bad)
    got, book = brute_codes(v)
    errors = [sum(d for d, _ in g) for g in got]
    label = Counter()
    for (_, _, k), e in zip(v, errors):
        label[k] += e
    digest = hashlib.sha256(",".join(str(c) for b in book for e in b for c in e).encode()).hexdigest()
    want = Counter((i, "".join(f"{k:02x}" for _, k in g), e, label[k], digest) for (i, _, k), g, e in zip(v, got, errors))
    if factor == 1.0:
        assert want == Counter(map(tuple, registry.queries()["op13_vector_codes"](spark, folder).collect()))
    else:  # here sums of errors go beyond a long
        rows = pq.op13_vector_codes(spark, folder).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
        assert Counter((a, b, c, e) for a, b, c, _, e in rows) == Counter((a, b, c, e) for a, b, c, _, e in want.elements())


def test_yinyang_leaves_out_most_entries(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32)) * 3
    rows = [(i, [float(x) for x in centres[i % 40] + rng.normal(size=32) * 0.05], 0) for i in range(4000)]
    report = {}
    codes, book = pq.compress(spark.createDataFrame(rows, "id long, v array<double>, label int"), report=report)
    assert report["rows"] == 4000 and report["met"][0] == 4000 * 16 * 64
    assert report["met"][1] < 0.5 * report["met"][0] and report["met"][2] < 0.35 * report["met"][0]


def test_vector_operators_on_empty_and_single_rows(spark, tmp_path):
    for k, rows in enumerate(([], [(1, None, 1)], [(1, [], 1)])):
        folder = folder_of(spark, tmp_path / f"{k}", rows)
        for name, columns in (("op11_whitening", 7), ("op13_vector_codes", 5)):
            df = registry.queries()[name](spark, folder)
            assert df.count() == 0 and len(df.columns) == columns
    folder = folder_of(spark, tmp_path / "one", [(4, [0.5, -0.25], None)])
    assert [tuple(r)[:4] for r in registry.queries()["op13_vector_codes"](spark, folder).collect()] == [(4, "00" * 16, 0, 0)]
    got = registry.queries()["op11_whitening"](spark, folder).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(c, 1, 0, None, 0.0, 0.0) for c in (1, 2)]


@pytest.mark.parametrize("size,factors", [(20, None), (6, None), (6, (1e4, 1e2, 10.0, 1.0, 0.3, 0.1))])
def test_op11_equals_brute_force(spark, tmp_path, size, factors):
    v, bad = vectors(size=size)
    if factors:
        v = [(i, [x * f for x, f in zip(e, factors)], k) for i, e, k in v]
    folder = folder_of(spark, tmp_path, v + bad)
    got = registry.queries()["op11_whitening"](spark, folder).collect()
    ints = {i: tuple(int(np.floor(64 * np.float64(x))) + 1000000 for x in e) for i, (_, e, _) in enumerate(v)}
    fit = sorted(set(ints.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    keep = min(16, size)
    assert len(got) == keep * len(v) and {r["n"] for r in got} == {n}
    assert Counter((r["vec_id"], r["deviation"]) for r in got) == Counter({k: keep * c for k, c in Counter((i, sum((n * a - s) ** 2 for a, s in zip(ints[j], sums))) for j, (i, _, _) in enumerate(v)).items()})
    # an exact covariance, of which the components must be eigenvectors
    mean = [Fraction(s, n) for s in sums]
    d = [[a - m for a, m in zip(x, mean)] for x in fit]
    cov = [[sum(r[a] * r[b] for r in d) / n for b in range(size)] for a in range(size)]
    trace = sum(cov[a][a] for a in range(size))
    explained = {r["component"]: r["explained"] for r in got}
    assert list(sorted(explained.values(), reverse=True)) == [explained[c] for c in range(1, keep + 1)]
    assert all(r["identity_error"] < 1e-9 for r in got)
    w = {}
    for r in got:
        w.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], set()).add(r["whitened"])
    by_fit = {}
    for j, (i, _, _) in enumerate(v):
        by_fit[ints[j]] = w[i, sum((n * a - s) ** 2 for a, s in zip(ints[j], sums))]
    z = np.array([[next(iter(by_fit[x][c])) for c in range(1, keep + 1)] for x in fit])
    assert np.allclose(z.T @ z / n, np.eye(keep), atol=1e-9) and np.allclose(z.mean(axis=0), 0, atol=1e-9)
    if keep == size:  # whitened rows determine the components: V = sum over components of (e v) v^T with e v = D^T z sqrt(e) / n
        dd = np.array([[float(x) for x in r] for r in d])
        load = dd.T @ z / n  # v * sqrt(e)
        assert np.allclose(load @ load.T, np.array([[float(x) for x in r] for r in cov]), rtol=1e-7, atol=1e-9 * float(trace))
        for c in range(keep):
            assert abs((load[:, c] ** 2).sum() / float(trace) / explained[c + 1] - 1) < 1e-6


def test_eigenvalues_far_below_the_greatest_are_right():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(8, 8)))
    scale = [10.0 ** -k for k in (0, 2, 4, 6, 9, 12, 15, 18)]
    exact = [[sum(Fraction(float(q[a, k])) * Fraction(scale[k]) * Fraction(float(q[b, k])) for k in range(8)) for b in range(8)] for a in range(8)]
    high = np.array([[float(x) for x in r] for r in exact])
    low = np.array([[float(x - Fraction(float(x))) for x in r] for r in exact])
    values, (vh, vl) = whiten.eigen(high, low)
    # q is orthogonal to about 1e-16 only, which moves the eigenvalues of the exact matrix by that share
    assert np.allclose(values / scale, 1, rtol=1e-9)
    assert np.allclose(np.abs(np.sum(vh * q, axis=0)), 1, atol=1e-9)


def test_sums_of_outer_products_lose_nothing():
    rng = np.random.default_rng(4)
    x = rng.integers(-(2**30), 2**30, size=(3000, 3))
    d = whiten.double_double(x)
    total = (np.zeros((3, 3)), np.zeros((3, 3)))
    for s in range(0, 3000, whiten.BLOCK):
        total = whiten.add(total, whiten.outer(tuple(m[s : s + whiten.BLOCK] for m in d)))
    exact = x.astype(object).T @ x.astype(object)
    assert all(int(total[0][a, b]) + int(total[1][a, b]) == exact[a, b] for a in range(3) for b in range(3))


def test_op12_by_rows(spark, tmp_path, merges, library):
    texts = [(i, t) for i, t in enumerate(hard_texts(merges, 40))] + [(900, None), (901, ""), (902, " \n "), (None, "null id"), (3, "repeated id"), (3, "repeated id"), (903, "long " * 30000 + "x" * 90000)]
    spark.createDataFrame(texts, "doc_id long, text string").withColumns({"d": F.lit(1), "n_tokens": F.lit(2)}).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, registry.queries()["op12_bpe"](spark, str(tmp_path)).collect())) == want
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert registry.queries()["op12_bpe"](spark, f"{tmp_path}/none").count() == 0
