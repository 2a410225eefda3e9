"""Vectors, archives, quality, shards, chats, and the pipeline."""

import base64
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import ann, chat, common, graph, quality, sharding, warc


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"cid": F.lit(1), "leaf": F.lit(2), "h": F.lit(3)})


def test_ann_recall_and_hot_vector(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 16))
    v = (centers[rng.integers(0, 12, 900)] + 0.6 * rng.normal(size=(900, 16))).astype(np.float32)
    v[::3] = v[0]  # a third of all rows are one vector
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0] * 15 + [None]), (2004, [1.0]), (None, [1.0] * 16), (5, [float(x) for x in v[5]])]
    got = ann.search(vectors(spark, rows), k=5, query="pmod(id, 50) = 0").collect()
    m = v.astype(float)
    norm = np.linalg.norm(m, axis=1)
    hits = 0
    queries = range(0, 900, 50)
    for q in queries:
        s = m @ m[q] / norm / norm[q]
        s[q] = -9
        want = np.lexsort((np.arange(900), -np.round(s, 9)))[:5]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and q not in [r["vec_id"] for r in mine]
        assert all(r["score"] == pytest.approx(s[r["vec_id"]], abs=1e-9) for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(want.tolist()))
    assert {r["query_id"] for r in got} == set(queries) and hits >= 0.9 * 5 * len(queries)


def test_ann_small_and_empty(spark):
    assert ann.search(vectors(spark, [])).count() == 0
    got = ann.search(vectors(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.1])]), k=5).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(1, 1), (2, 2)]
    assert ann.search(vectors(spark, [(0, [1.0, 0.0])])).count() == 0


def test_ann_ties_go_to_smaller_ids(spark):
    v = np.random.default_rng(1).normal(size=8).astype(np.float32)
    rows = [(i, [float(x) for x in v * np.float32(2.0 ** (i - 20))]) for i in range(40)]
    got = ann.search(vectors(spark, rows), k=5, query="id in (0, 3)").collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, i, i) for i in range(1, 6)] + [(3, 1, 0), (3, 2, 1), (3, 3, 2), (3, 4, 4), (3, 5, 5)]
    assert len({r["score"] for r in got}) == 1


def test_ann_leaves_grow_with_the_table(spark, monkeypatch):
    """Branches are fitted in tasks; recall holds and the share of rows compared falls as the table grows."""
    for name, x in (("SAMPLE", 400), ("LEAF_ROWS", 16), ("MIN_LEAVES", 8), ("TOP_LEAVES", 8), ("BLOCK", 64)):
        monkeypatch.setattr(ann, name, x)
    rng = np.random.default_rng(7)
    seen = []
    for n in (600, 3000):
        m = (rng.normal(size=(60, 12))[rng.integers(0, 60, n)] + 0.4 * rng.normal(size=(n, 12))).astype(np.float32)
        did: dict = {}
        got = ann.search(vectors(spark, [(i, [float(x) for x in r]) for i, r in enumerate(m)]), k=5, query="pmod(id, 20) = 0", report=did).collect()
        unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
        hits = 0
        for q in range(0, n, 20):
            s = unit @ unit[q]
            s[q] = -9
            hits += len(set(np.argsort(-s)[:5].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
        assert hits >= 0.9 * 5 * len(range(0, n, 20))
        seen.append(did)
    assert seen[0]["leaves"] >= 20 and seen[1]["leaves"] > 3 * seen[0]["leaves"] and seen[1]["share"] < 0.7 * seen[0]["share"], seen


def brute_warc(rows):
    first = {}
    for i, h in rows:
        if i is not None and (h or "") not in first or i is not None and i < first[h or ""]:
            first[h or ""] = i
    out = []
    for i, h in rows:
        b = (h or "").encode()
        f = first[h or ""]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == f else "revisit", None if i == f else f))
    return sorted(out, key=str)


def test_warc_round_trip_with_magic_inside(spark, tmp_path):
    inner = warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    kinds = ["", None, "x" * 9000, inner, "a" + warc.MAGIC + "b", "é\r\n\r\n" + warc.MAGIC + "Content-Length: 99999\r\n\r\n" + "y" * 300, warc.MAGIC * 4, "\r\n\r\n", inner * 3]
    rows = [(i, kinds[i % 9] if i % 2 else f"{kinds[i % 9] or ''}{i}") for i in range(180)]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumns({"url": F.lit("http://h.test/\r\nx"), "digest": F.lit(1), "payload": F.lit(2)})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for n, size in enumerate(("128m", "3000")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            path = f"file://{tmp_path}/w{n}"
            warc.write_warc(pages, path)
            got = warc.resolve_revisits(warc.read_warc(spark, path)).select(F.col("record_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long")).collect()
            assert sorted(map(tuple, got), key=str) == brute_warc(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_warc_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, html string, url string")
    warc.write_warc(pages, f"file://{tmp_path}/w")
    assert warc.read_warc(spark, f"file://{tmp_path}/w").count() == 0


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (None, 1), (3, 1), (20, 9), (1, 2)], "src long, dst long")
    assert {r["node"]: r["root"] for r in graph.connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 20: 7}
    assert graph.connected_components(e.where("false")).count() == 0
    line = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r["root"] for r in graph.connected_components(line).collect()} == {0}


def test_quality_separates_and_shrinks(spark):
    good, bad = "the calm river flows past green fields and old stone houses ", "WIN!! CASH!! NOW!! CLICK!! "
    rows = [(i, (bad if i % 4 == 0 else good) * (1 + i % 3) + f"id{i}", f"h{i % 5}", "en") for i in range(400)] + [(900, None, None, None), (901, "", "lonely", "x"), (902, good * 400, "h1", None), (3, good, "h3", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({"host": F.lit(1), "path": F.lit(2), "e": F.lit(3), "label": F.lit(4)})
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 400, 2)] + [(5, None, None), (None, 1, 0), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels).collect()
    assert len(got) == len(rows)
    odd = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 2]
    assert all(r["keep"] for r in odd)
    assert not any(r["keep"] for r in got if r["doc_id"] < 400 and r["doc_id"] % 4 == 0)
    assert all(0 <= r["site"] <= 1 for r in got)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id % 4 = 0 and doc_id < 400").count() == 0
    assert quality.score(docs.where("false"), labels).count() == 0
    assert quality.keep_good(docs, labels.where("false")).count() == len(rows)


def test_quality_sites_equal_brute_force(spark):
    """Both levels with each document left out, from the evidence that the query itself returns."""
    rng = np.random.default_rng(9)
    words = "calm river green field old stone WIN!! CASH!! house path".split()
    rows = [(i, " ".join(rng.choice(words, 12)), None if i % 17 == 0 else f"h{i * i % 13}", f"p{i % 3}") for i in range(300)] + [(900, "calm river", "alone", "p"), (901, None, "alone2", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    marks = {i: (int("WIN" not in rows[i][1]), int(i % 8 == 0)) for i in range(0, 300, 3)}
    got = {r["doc_id"]: r for r in quality.score(docs, spark.createDataFrame([(i, *m) for i, m in marks.items()], "doc_id long, quality int, toxic int")).collect()}
    e = {i: float(marks[i][0] * (1 - marks[i][1])) if i in marks else got[i]["evidence"] for i, *_ in rows}
    hosts, paths = {}, {}
    for i, _, h, p in rows:
        hosts.setdefault(h, []).append(e[i])
        paths.setdefault((h, p), []).append(e[i])

    def strength(groups):  # (values, expected mean)
        clip = lambda m: max(min(m, 0.999), 0.001)
        many = [(v, clip(m)) for v, m in groups if len(v) > 1]
        between = max(np.mean([(np.mean(v) - m) ** 2 / (m * (1 - m)) for v, m in many]) - np.mean([1 / len(v) for v, _ in many]), 1e-4)
        return min(max(1 / between - 1, 5.0), 5000.0)

    total, n = sum(e.values()), len(e)
    k1 = strength([(v, total / n) for v in hosts.values()])
    hm = {h: (k1 * total / n + sum(v)) / (k1 + len(v)) for h, v in hosts.items()}
    k2 = strength([(v, hm[h]) for (h, _), v in paths.items()])
    odds = {}
    for i, _, h, p in rows:
        host = (k1 * (total - e[i]) / (n - 1) + sum(hosts[h]) - e[i]) / (k1 + len(hosts[h]) - 1)
        site = (k2 * host + sum(paths[h, p]) - e[i]) / (k2 + len(paths[h, p]) - 1)
        assert got[i]["site"] == pytest.approx(site, abs=1e-4), i
        odds[i] = math.log(got[i]["posterior"] / (1 - got[i]["posterior"])) - math.log(got[i]["evidence"] / (1 - got[i]["evidence"])) - math.log(site / (1 - site)) if 1e-3 < got[i]["posterior"] < 0.999 and 1e-3 < got[i]["evidence"] < 0.999 else None
        assert got[i]["keep"] == (got[i]["posterior"] >= 0.5)
    known = [x for x in odds.values() if x is not None]
    assert len(known) > 20 and max(known) - min(known) < 0.02  # the prior's odds, the same for all


def test_quality_leaves_a_sole_document_out(spark):
    rows = [(i, f"calm river number{i % 7}", f"h{i % 5}", "en") for i in range(60)]
    marks = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    sites = [next(r["site"] for r in quality.score(spark.createDataFrame(rows + [(99, t, "alone", "x")], "doc_id long, text string, source string, lang string"), marks).collect() if r["doc_id"] == 99) for t in ("calm river", "x " * 50)]
    assert sites[0] == sites[1]


def test_quality_takes_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(quality, "PIECE", 64)
    long = "river stone " * 40 + "WIN!! " * 30
    assert {f for f in quality.features(long) if f.startswith("m:")} == {"m:!!"} and {"river", "^rive", "^win"} <= set(quality.features(long))
    assert {x for x in quality.features(long) if x[1] != ":"} == {"river", "stone", "win", *(f"^{w[:n]}" for w in ("river", "stone", "win") for n in (4, 5))}
    assert quality.features(None) == quality.features("")


def test_quality_judges_null_ids_by_row(spark):
    good, bad = "the calm river flows past green fields and old stone houses ", "WIN!! CASH!! NOW!! CLICK!! "
    rows = [(i, (bad if i % 4 == 0 else good) + f"id{i}", f"h{i % 5}", "en") for i in range(400)]
    none = [(None, bad, "h1", "en"), (None, good, "h1", "en"), (None, good, "h1", "en"), (None, good + "more", None, "en")]
    docs = spark.createDataFrame(rows + none, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, labels)
    assert Counter(map(tuple, kept.where("doc_id is null").collect())) == Counter(none[1:])
    assert kept.columns == docs.columns and kept.where("doc_id % 4 = 0").count() == 0 and kept.where("doc_id % 2 = 1").count() == 200


def test_min_cost_flow_moves_the_fewest():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n, m = rng.integers(1, 6, 2)
        have = [int(x) for x in rng.integers(0, 50, n)]
        room = sharding.even_capacities(sum(have), int(m))
        flow = sharding.min_cost_flow(have, room, lambda i, j: int(i != j))
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(n)] == have
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= room[k] for k in range(m))
        assert sum(v for (i, j), v in flow.items() if i != j) == sum(have) - sum(min(a, b) for a, b in zip(have, room))
    with pytest.raises(ValueError):
        sharding.min_cost_flow([5], [4], lambda i, j: 0)


def shard_sizes(rows, text="text", shard="shard", slot="slot"):
    sizes, slots = Counter(), {}
    for r in rows:
        sizes[r[shard]] += len((r[text] or "").encode()) + 1
        slots.setdefault(r[shard], []).append(r[slot])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_reshard(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, "é" * int(rng.integers(0, 200)), "copy") for i in range(700)] + [(None, None, "n"), (5, "dup", None), (5, "dup", None), (6, "", "e"), (7, "z" * 3000, "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").withColumns({"slot": F.lit("mine"), "_metadata": F.lit(1), "block_bytes": F.lit(2), "file": F.lit("f")})
    out = sharding.reshard(docs, f"file://{tmp_path}/s", shards=5, old_shards=3)
    got = out.collect()
    assert out.columns == [*docs.columns, "slot_", "shard_"]
    assert sorted(str(r[:3]) for r in map(tuple, got)) == sorted(str(r) for r in rows)
    sizes = shard_sizes(got, shard="shard_", slot="slot_")
    assert len(sizes) == 5 and max(sizes.values()) - min(sizes.values()) <= 400
    assert sharding.reshard(docs.where("false"), f"file://{tmp_path}/e").count() == 0


def test_reshard_spreads_repeated_rows(spark, tmp_path):
    cases = [[(i, "y" * (i * 37 % 100)) for i in range(600)] * 2 + [(None, "z" * 80)] * 500, [(i, "x" * 99) for i in range(500)] + [(7, "y" * 99)] * 2000]
    for n, rows in enumerate(cases):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
        got = sharding.reshard(docs, f"file://{tmp_path}/s{n}", shards=5 + 11 * n, old_shards=3 + 9 * n).collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
        sizes = shard_sizes(got)
        assert len(sizes) == 5 + 11 * n and max(sizes.values()) - min(sizes.values()) <= 400


def test_reshard_moves_the_fewest_bytes_and_leaves_other_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, "w" * int(rng.integers(0, 300))) for i in range(3000)]
    docs, path = spark.createDataFrame(rows, "doc_id long, text string").repartition(40), f"file://{tmp_path}/c"
    sharding.lay_out(docs, path, 4)

    def files():
        return {r["file"]: (r["shard"], (tmp_path / "c/files" / r["file"]).stat().st_mtime_ns, hashlib.sha1((tmp_path / "c/files" / r["file"]).read_bytes()).digest()) for r in sharding.manifest(spark, path).collect()}

    was = {r["doc_id"]: r["shard"] for r in sharding.read_shards(spark, path).collect()}
    for shards in (6, 3, 3):  # grown, shrunk, and as it is
        before, held = files(), Counter()
        for r in sharding.manifest(spark, path).collect():
            held[r["shard"]] += r["bytes"]
        did = sharding.reshard_files(spark, path, shards)
        after, got = files(), sharding.read_shards(spark, path).collect()
        assert sorted((r["doc_id"], r["text"]) for r in got) == rows
        moved = sum(len(r["text"]) + 1 for r in got if r["shard"] != was[r["doc_id"]])
        total = sum(held.values())
        assert did.cost == total - sum(min(held[j], c) for j, c in enumerate(sharding.even_capacities(total, shards)))
        assert did.moved == moved and abs(moved - did.cost) <= 300 * 9
        same = before.keys() & after.keys()
        assert len(same) == did.kept and len(before) - len(same) == did.rewritten and all(before[f] == after[f] for f in same)
        sizes = shard_sizes(got)
        assert len(sizes) == shards and max(sizes.values()) - min(sizes.values()) <= 1200
        was = {r["doc_id"]: r["shard"] for r in got}
    assert did.rewritten <= 3 and did.cost <= 1200


def test_chat_trees_and_escapes(spark):
    nodes = [(1, 1, None, "user", "a<s>", 0.0), (1, 2, 1, "assistant", "b", 1.0), (1, 3, 1, "assistant", "<|im_end|>\n<\\\\s>", 5.0), (1, 4, 3, None, None, 0.0), (1, 5, 2, "ro\\le\nx", "e", 9.0),
             (2, 1, 2, "user", "x", 0.0), (2, 2, 1, "user", "y", 0.0), (2, 3, 2, "user", "z", 0.0), (3, 7, 99, "user", "", None), (None, 1, None, "user", "n", 0.0)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double").withColumns({"anc": F.lit(0), "path": F.lit(1), "depth": F.lit(2)})
    made = chat.format_paths(chat.best_paths(df, 2))
    got = {(r["tree"], r["path"]): r for r in made.select("tree", "path", "formatted", chat.parse_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("l")).collect()}
    assert set(got) == {(1, 5), (1, 4), (3, 7), (None, 1)}  # a cycle has no root
    assert [(x["role"], x["text"]) for x in got[(1, 4)]["t"]] == [("user", "a<s>"), ("assistant", "<|im_end|>\n<\\\\s>"), ("", "")]
    assert got[(1, 4)]["l"] == "<|im_end|>\n<\\\\s>" and got[(1, 5)]["t"][2]["role"] == "ro\\le\nx"
    assert got[(1, 4)]["formatted"].count("<|im_end|>") == 3
    one = made.where("tree = 1").count()
    assert one == 2 and chat.best_paths(df.where("tree = 1")).select("path").distinct().count() == 1
    assert chat.format_paths(chat.best_paths(df.where("false"))).count() == 0


def test_chat_long_chain(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(300)] + [(2, 0, "user", "b"), (2, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    got = {r["tree"]: r["t"] for r in chat.format_paths(chat.best_paths(chat.chains(turns))).select("tree", chat.parse_turns(F.col("formatted")).alias("t")).collect()}
    assert [x["text"] for x in got[1]] == [f"t{i}" for i in range(300)] and [x["text"] for x in got[2]] == ["a", "b"]


def test_ordinals(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("c",)], "x string")
    assert [r["x"] for r in common.ordinals(df, F.col("x").asc_nulls_last()).orderBy("ordinal").collect()] == ["a", "b", "c", None]


def test_pipeline_against_its_parts(spark, tmp_path):
    import corpus_pipeline
    from linkloom.llm import decontaminate, simhash

    sf = "/root/testdata/sf0.001"
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, docs, sf))
        seen.append((name, docs, out))
        docs = out
    text = {n: [(r["doc_id"], r["text"]) for r in o.select("doc_id", "text").collect()] for n, _, o in seen}
    assert {n: o.columns for n, _, o in seen if n != "sharding"} == {n: seen[0][1].columns for n, *_ in seen if n != "sharding"}
    fps = [simhash.simhash64(t.encode()) for _, t in text["simhash_dedup"]]
    assert all(bin(a ^ b).count("1") > 3 for i, a in enumerate(fps) for b in fps[:i])
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert not any(r["contaminated"] for r in decontaminate.contamination(seen[2][2], bench).collect())
    assert {i for i, _ in text["simhash_dedup"]} - {i for i, _ in text["decontamination"]} == {r["doc_id"] for r in decontaminate.contamination(seen[1][2], bench).where("contaminated").collect()}
    assert Counter(text["mixing"]) == Counter(text["sharding"]) and max(Counter(i for i, _ in text["mixing"]).values()) <= 2
    sizes = Counter()
    for r in seen[4][2].collect():
        sizes[r["shard"]] += len(r["text"].encode()) + 1
    assert sum(zlib.crc32(t.encode()) for _, t in text["mixing"]) == sum(zlib.crc32(t.encode()) for _, t in text["sharding"]) and len(sizes) == 16


def test_quality_rare_words_do_not_hide_toxic_ones(spark):
    """Held out: one toxic word in a text of words that are mostly rare, beside thousands of features of chance."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("aeionrst"), 4))
    rows, marks = [], []
    for i in range(600):
        words = [word() for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            words[int(rng.integers(0, 60))] = ("idiot!", "Scum", "moron")[i // 6 % 3]
        rows.append((i, " ".join(words), f"h{i % 3}", "en"))
        if i >= 300:
            marks.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r["doc_id"]: r["keep"] for r in quality.score(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    clean, toxic = [got[i] for i in range(300) if i % 6], [got[i] for i in range(0, 300, 6)]
    assert sum(clean) >= 0.97 * len(clean)
    assert sum(toxic) <= 0.6 * len(toxic)
