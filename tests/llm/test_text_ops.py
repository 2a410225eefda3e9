"""Operators on whole texts against brute force: personal data, decontamination, SimHash, mixing, language model."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.llm import decontaminate, lm, mixing, pii, simhash

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30000))
TEXTS = [
    (1, "Mail ann@a.example.com or bob@b.org. Call +1 (555) 123-4567, visa 4111 1111 1111 1111, host 10.0.0.1 and 300.1.1.1"),
    (2, None), (3, ""), (4, "   \n\t "), (5, "éàü 😀 ann@x.y é +4420 7946 0958 😀"), (6, "9" * 5000 + " 1.2.3.4.5.6.7.8 " + "a" * 3000 + "@"), (7, LONG),
    (8, "a@b.com_c@d.org x@y.z.w. 0000.1.2.3 4111111111111112 4111-1111-1111-1111"), (8, "a@b.com_c@d.org x@y.z.w. 0000.1.2.3 4111111111111112 4111-1111-1111-1111"), (None, "nobody@nowhere.net"),
    (9, "iban GB82 WEST 1234 5698 7654 32 and DE89370400440532013000; bank account GB83 WEST 1234 5698 7654 32"), (10, "phone 555-123-4567 but 555-987-6543" + " x" * 60 + " serial 555-222-3333"),
    (11, "+" * 50 + "1 2" + "." * 200 + "1@1.1"),
]


def table(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"uid": F.lit("x"), "n": F.lit(1), "start": F.lit(2), "len": F.lit(3), "words": F.lit(4), "fp": F.lit(5)}) if extra else df


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (2 if i % 2 else 1)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def base_spans(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        g = re.sub(r"\D", "", m.group())
        if 14 <= len(g) <= 19 and luhn(g):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub(r"\D", "", m.group())) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_pii_equals_brute_force(spark):
    got = defaultdict(list)
    rows = pii.find_pii(table(spark, TEXTS)).collect()
    for r in rows:
        if r["kind"] in pii.BASE:
            got[(r["doc_id"], r["uid"])].append((r["kind"], r["start"], r["end"]))
    by_doc = defaultdict(list)
    for (doc, _), spans in got.items():
        by_doc[doc].append(sorted(spans, key=lambda s: (s[1], pii.BASE.index(s[0]))))
    want = defaultdict(list)
    for doc, t in TEXTS:
        if base_spans(t or ""):
            want[doc].append(base_spans(t))
    assert dict(by_doc) == dict(want)
    assert len({r["uid"] for r in rows}) == len(TEXTS)
    extra = {(r["doc_id"], r["kind"], r["match"]) for r in rows if r["kind"] not in (*pii.BASE, None)}
    assert {k for d, k, _ in extra if d == 9} == {"iban"} and len([1 for d, *_ in extra if d == 9]) == 2
    assert {m for d, k, m in extra if d == 10} == {"555-123-4567"}  # context reaches to the match before


def test_pii_empty(spark):
    assert pii.find_pii(table(spark, [])).count() == 0


BENCH = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "the the the the the the the the the the the"), (3, "short item"), (4, ""), (5, None), (3, "other words É"), (None, "no id item at all"), (6, "short item")]
DOCS = [(1, "x Alpha, BETA gamma delta epsilon zeta eta theta iota kappa lambda y"), (2, "the " * 25), (3, "a short item here; short  item"), (4, None), (5, "?!"), (6, "other words é"), (7, "other words É other"), (8, "no id item at all"), (8, "clean"), (9, LONG + " short item")]


def brute_windows():
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    wins = defaultdict(set)
    for i, t in BENCH:
        w = words(t)
        for s in range(max(1, len(w) - 9)) if w else []:
            wins[tuple(w[s : s + 10])].add(i)
    out = []
    for d, t in DOCS:
        w, hit, items = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                own = wins.get(tuple(w[s : s + n]))
                if own:
                    hit |= set(range(s, s + n))
                    items |= own
        ids = sorted(str(i) for i in items if i is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_decontamination_equals_brute_force(spark, monkeypatch):
    bench = spark.createDataFrame(BENCH, "item_id long, text string").withColumn("count", F.lit(1))
    want = brute_windows()
    assert sorted(map(tuple, decontaminate.contamination(table(spark, DOCS), bench).collect())) == want
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 700)  # several broadcast slices
    assert sorted(map(tuple, decontaminate.contamination(table(spark, DOCS), bench).collect())) == want
    kept = decontaminate.clean_documents(table(spark, DOCS), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6] and kept.columns == table(spark, DOCS).columns


def test_decontamination_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(table(spark, DOCS), bench).collect()
    assert len(got) == len(DOCS) and not any(r["contaminated"] for r in got)
    full = spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontaminate.contamination(table(spark, []), full).count() == 0


def test_decontamination_judges_null_ids_by_text(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = [*DOCS, (None, "a short item"), (None, "clean one"), (None, "clean two"), (None, "clean two"), (None, None)]
    kept = decontaminate.clean_documents(table(spark, docs), bench)
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert Counter(got) == Counter([(4, None), (5, "?!"), (6, "other words é"), *docs[-4:]]) and kept.columns == table(spark, docs).columns


def brute_simhash(t):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    s = [b" ".join(w)] if 0 < len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@given(st.one_of(st.none(), st.text(alphabet="aB é\n\x0b,", max_size=80)))
@settings(max_examples=150, deadline=None)
def test_fingerprint(t):
    assert simhash.simhash64(None if t is None else t.encode()) == brute_simhash(t)


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_bit_sliced_forest_equals_brute_force(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    rows = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False))) for b in base for _ in range(6)]
    f = np.unique(np.array(rows, np.uint64))
    root = list(range(len(f)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f) <= radius):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    assert simhash.forest(f, radius).tolist() == [find(i) for i in range(len(f))]


def test_near_duplicates(spark, monkeypatch):
    body = " ".join(f"token{i}" for i in range(400))
    docs = [(10, body), (3, body), (7, body + " tail"), (20, None), (21, ""), (22, " \n"), (30, "one two"), (31, "ONE two"), (None, body), (40, LONG), (3, body)]
    monkeypatch.setattr(simhash, "HOT", 2)  # every bucket is split
    got = simhash.near_duplicates(table(spark, docs)).collect()
    assert len(got) == len(docs)
    f = {d: brute_simhash(t) for d, t in docs}
    assert all(np.uint64(r["fp"] & (2**64 - 1)) == np.uint64(f[r["id"]]) for r in got)
    near = lambda a, b: bin(f[a] ^ f[b]).count("1") <= 3
    comp = {r["id"]: r["component_id"] for r in got}
    assert comp[10] == comp[3] == comp[None] == 3 and comp[20] == comp[21] == comp[22] == 20 and comp[30] == comp[31] == 30 and comp[40] == 40
    assert comp[7] == (3 if near(7, 3) else 7)
    kept = simhash.keep_one(table(spark, docs))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c in comp.values()}) and kept.columns == table(spark, docs).columns
    assert simhash.near_duplicates(table(spark, [])).count() == 0 and simhash.keep_one(table(spark, [])).count() == 0


def test_keep_one_judges_rows_not_ids(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    docs = [(1, text("a")), (None, text("a")), (None, text("b")), (None, text("c")), (None, text("c")), (2, text("d")), (2, text("e")), (2, text("e")), (3, text("d")), (None, None)]
    got = [(r["doc_id"], r["text"]) for r in simhash.keep_one(table(spark, docs)).collect()]
    want = [(1, text("a")), (None, text("b")), (None, text("c")), (2, text("d")), (2, text("e")), (None, None)]
    assert Counter(got) == Counter(want)
    maps = table(spark, docs).withColumn("tags", F.create_map(F.lit("k"), F.lit(1)))
    assert simhash.keep_one(maps).count() == len(want)


def want_targets(rows):
    size, order = Counter(), sorted({r[2] for r in rows if r[2] is not None}) + [None] * any(r[2] is None for r in rows)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, want = 1.5 * sum(size.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 2 * size[s] <= weight[s] * level}
        if not full:
            want |= {s: weight[s] * level for s in free}
            break
        want |= {s: 2 * size[s] for s in full}
        left, free = left - sum(2 * size[s] for s in full), free - full
    return want


def test_mixing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(1, 60)), None if i % 9 == 0 else f"s{i % 7 % 5}") for i in range(900)] + [(1000, None, "s0"), (1001, "", "tiny"), (1002, " ", None), (5, "w " * 10, "s1"), (5, "w " * 10, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"s": F.lit(0), "cut": F.lit(0), "target": F.lit(0), "extra": F.lit(1), "key": F.lit("k"), "h": F.lit(2)})
    want, taken, by_weight = want_targets(rows), Counter(), defaultdict(lambda: defaultdict(list))
    got = mixing.copies(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        plan = r["mix_plan_"]
        assert plan["target"] == pytest.approx(want[r["source"]]) and plan["source"] == r["source"] and 0 <= r["mix_copies_"] <= 2
        assert r["mix_w_"] == 1 + math.floor(math.log2(1 + r["mix_size_"]))
        taken[r["source"]] += r["mix_size_"] * r["mix_copies_"]
        by_weight[r["source"]][r["mix_w_"]].append((r["mix_size_"], plan["factor"]))
    assert all(abs(taken[s] - want[s]) <= 12 for s in want)
    for s, ws in by_weight.items():  # expected words are the target
        expected = sum(n * (min(2.0, f * w) if f is not None else 2.0) for w, rows_ in ws.items() for n, f in rows_)
        assert expected == pytest.approx(want[s])
    one, two = (sorted(r["doc_id"] or -1 for r in mixing.mix(d).collect()) for d in (docs, docs.repartition(5)))
    assert one == two and mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs.where("false")).count() == 0


def test_mixing_is_pareto_sampling_by_brute_force(spark):
    """Certain copies, ranks by odds over odds and the cut, from the query's own expectations."""
    rng = np.random.default_rng(6)
    rows = [(i, "w " * int(2 ** rng.uniform(0, 9)), f"s{i % 3}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashes = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), "text", "source", F.lit("mix")).alias("h")).collect()}
    per = defaultdict(list)
    for r in mixing.copies(docs).collect():
        per[r["source"]].append(r)
    for rs in per.values():
        ranked, missing = [], rs[0]["mix_plan_"]["target"]
        for r in rs:
            e = min(2.0, r["mix_plan_"]["factor"] * r["mix_w_"]) if r["mix_plan_"]["factor"] is not None else 2.0
            sure, u = math.floor(e + 1e-9), ((hashes[r["doc_id"]] % (1 << 64) >> 11) + 0.5) / (1 << 53)
            p = max(e - sure, 0.0)
            missing -= sure * r["mix_size_"]
            assert r["mix_copies_"] in ((sure, sure + 1) if sure < 2 else (2,))
            if sure < 2:
                ranked.append((u / (1 - u) / (p / (1 - p)) if p else math.inf, r["mix_size_"], r["mix_copies_"] - sure))
        ranked.sort()
        cum, n = 0, 0
        while n < len(ranked) and cum + ranked[n][1] <= missing + 1e-6:
            cum, n = cum + ranked[n][1], n + 1
        assert all(x[2] for x in ranked[:n])
        after = [x for x in ranked[n:] if x[2]]
        assert len(after) <= 1
        best = min((abs(x[1] - (missing - cum)) for x in ranked[n:] if x[1] < 2 * (missing - cum)), default=None)
        assert (best is None) == (not after) and (not after or abs(after[0][1] - (missing - cum)) == best)


def test_mixing_inclusion_frequencies(spark):
    """Over many draws a document is taken as often as its weight says."""
    draws, n = 300, 40
    rows = [(d * n + i, "w w w w", f"s{d:03d}", float(1 + i % 4)) for d in range(draws) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, m double")
    got = mixing.copies(docs, weight_col="m", weights=(1.0,), share=0.4).collect()
    taken, total = Counter(), Counter()
    for r in got:
        assert r["mix_copies_"] <= 1
        taken[r["m"]] += r["mix_copies_"]
        total[r["source"]] += r["mix_copies_"]
    assert set(total.values()) == {16}  # a fixed size in each draw
    for m in (1.0, 2.0, 3.0, 4.0):
        assert taken[m] / (draws * n / 4) == pytest.approx(0.4 * m / 2.5, abs=0.04)


def test_mixing_numbers_heavy_repeats(spark):
    rows = [(i, "w " * 10, "s") for i in range(100)] + [(7000, "v " * 10, "s")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.copies(docs).collect()
    taken = sum(r["mix_size_"] * r["mix_copies_"] for r in got)
    assert len(got) == 500 and abs(taken - 7500) <= 5 and {r["mix_copies_"] for r in got if r["doc_id"] == 7000} == {1, 2}
    one, two = (sorted(r["doc_id"] for r in mixing.mix(d).collect()) for d in (docs, docs.repartition(3)))
    assert one == two


def test_mixing_weights_null_zero_and_held(spark):
    rows = [(i, "w w", "a", w) for i, w in enumerate([None, float("nan"), -3.0, 0.0, 1.0, 1e9, 1e9, 2.0])] + [(9, None, None, 1.0), (10, "", "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, m double")
    got = {r["doc_id"]: r["mix_copies_"] for r in mixing.copies(docs, weight_col="m").collect()}
    assert got[2] == got[3] == 0 and got[5] == got[6] == 2 and sum(2 * got[i] for i in range(8)) == 24


def brute_model(seqs, order, cutoff):
    """p(u, v, w), the vocabulary's counts and the model's sums, from dictionaries."""
    uni, bi, tri = Counter(), Counter(), Counter()
    for x in seqs:
        y = [b" start", b" start", *x]
        uni.update(x)
        bi.update(zip(y[1:], x))
        tri.update(zip(y, y[1:], x))
    left = Counter((v, w) for _, v, w in tri)
    value = bi if order == 2 else {k: bi[k] if k[0] == b" start" else n for k, n in left.items()}
    cont = Counter(w for _, w in bi)
    of = lambda c: lm.discounts(*[sum(x == i for x in c.values()) for i in (1, 2, 3, 4)])
    d3, d2, d1 = of(tri), of(value), of(cont)
    off = lambda d, x: d[min(x, 3) - 1] if x else 0.0
    spare = sum(off(d1, x) for x in cont.values()) / len(bi)
    n2, g2, took, n3 = Counter(), Counter(), Counter(), Counter()
    for (v, _), x in value.items():
        n2[v] += x
        g2[v] += off(d2, x)
    for (u, v, _), x in tri.items():
        n3[u, v] += x
        if x >= cutoff:
            took[u, v] += x - off(d3, x)

    def p(u, v, w):
        p1 = (cont[w] - off(d1, cont[w])) / len(bi) + spare / (len(uni) + 1)
        x = value.get((v, w), 0)
        p2 = (x - off(d2, x) + g2[v] * p1) / n2[v] if n2[v] else p1
        if order == 2 or not n3[u, v]:
            return p2
        x = tri.get((u, v, w), 0)
        return ((x - off(d3, x) if x >= cutoff else 0) + (n3[u, v] - took[u, v]) * p2) / n3[u, v]

    return p, uni, (d3, d2, d1), len(bi)


@pytest.mark.parametrize("order,cutoff,mounted", [(3, 2, None), (3, 1, False), (2, 2, None)])
def test_language_model_equals_brute_force(spark, tmp_path, order, cutoff, mounted):
    docs = [(i, " ".join(f"v{(i * 7 + j * j) % 23}" for j in range(40 + i % 5))) for i in range(60)] + [(100, None), (101, ""), (102, "V1 v1 unseen\x0bword é"), (103, LONG), (None, "v1 v2")]
    docs += [(7, docs[7][1])]
    df = table(spark, docs)
    train = df.where(~lm.held_out(F.col("doc_id")))
    tok = lambda t: (t or "").encode().lower().split() + [b" end"]
    seqs = [tok(t) for i, t in docs if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    p, uni, d, contexts = brute_model(seqs, order, cutoff)
    n, v = sum(uni.values()), len(uni)
    model = lm.train(train, path=f"file://{tmp_path}/lm", order=order, cutoff=cutoff, mounted=mounted)
    assert (model.n, model.v, model.texts, model.contexts) == (n, v, len(seqs), contexts) and (model.d2, model.d1) == d[1:] and (order == 2 or model.d3 == d[0])
    for u, v1 in ((b"v1", b"v2"), (b" start", b" start"), (b" start", b"v7"), (b"zz", b"v3"), (b"v3", b"zz")):
        assert sum(p(u, v1, w) for w in uni) + p(u, v1, b"never") == pytest.approx(1)
    got = defaultdict(list)
    for r in lm.score(df, model).collect():
        got[r["id"]].append(r)
    assert sum(map(len, got.values())) == len(docs)
    for i, t in docs:
        x = tok(t)
        y = [b" start", b" start", *x]
        for r in got[i]:
            assert r["n_tokens"] == len(x) and r["n_known"] == sum(w in uni for w in x)
            assert r["score"] == pytest.approx(sum(math.log10(p(*z)) for z in zip(y, y[1:], x)), abs=1e-6)
            assert r["base_score"] == pytest.approx(sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), abs=1e-6)


def test_language_model_pieces_and_empty(spark, monkeypatch):
    docs = [(1, LONG), (2, "v1 v2"), (3, LONG)]
    model = lm.train(table(spark, docs))
    want = {r["id"]: r["score"] for r in lm.score(table(spark, docs), model).collect()}
    for name, x in (("RUN", 1000), ("BATCH", 1000), ("CACHE", 300), ("BUCKET_BYTES", 1000)):
        monkeypatch.setattr(lm, name, x)
    model = lm.train(table(spark, docs))
    assert {r["id"]: pytest.approx(r["score"]) for r in lm.score(table(spark, docs), model).collect()} == want
    none = lm.train(table(spark, []))
    assert none.n == 0 and lm.score(table(spark, docs), none).count() == 3 and lm.score(table(spark, []), none).count() == 0


def test_language_model_scores_what_occurs_again_apart(spark):
    rng = np.random.default_rng(8)
    docs = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 60) % 500)) for i in range(400)]
    docs += [(1000 + i, docs[i][1]) for i in range(20)]
    got = {r["id"]: r["score"] / r["n_tokens"] for r in lm.score(table(spark, docs), lm.train(table(spark, docs))).collect()}
    twice, once = [got[i] for i in range(20)], [got[i] for i in range(20, 400)]
    assert min(twice) > max(once)


def test_language_model_needs_a_folder_that_workers_reach(spark):
    with pytest.raises(Exception):
        lm.train(table(spark, []), path="nowhere://x/y")
