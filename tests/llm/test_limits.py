"""What must not go wrong silently: lost files of a model, more files than maps, windows larger than a broadcast."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkloom.llm import decontaminate, lm


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    words = [f"w{i * i % 97}" for i in range(4000)]
    docs = spark.createDataFrame([(i, " ".join(words[i * 40 : i * 40 + 40])) for i in range(100)], "doc_id long, text string").repartition(3)
    path = str(tmp_path_factory.mktemp("lm"))
    return docs, lm.train(docs, path=path), path


def sums(docs, m):
    return lm.score(docs, m).agg(F.round(F.sum("score"), 6), F.sum("n_known")).first()


def test_a_lost_model_file_is_an_error(spark, model):
    docs, m, path = model
    whole = sums(docs, m)
    assert whole[1] > 4000
    for kind in "bwus":
        name = sorted(f for f in os.listdir(path) if f.startswith(kind))[0]
        os.rename(f"{path}/{name}", f"{path}/{name}.away")
        try:
            with pytest.raises(Exception, match=f"file {name} of the language model"):
                sums(docs, m)
        finally:
            os.rename(f"{path}/{name}.away", f"{path}/{name}")
    assert sums(docs, m) == whole


def test_more_files_than_maps_give_the_same_scores(spark, model, monkeypatch):
    docs, m, path = model
    monkeypatch.setattr(lm, "MAPS", 1)
    reader = lm.Reader(m)
    hashes = lm.Hashes()
    texts = [r["text"] for r in docs.collect()]
    import numpy as np

    h = np.fromiter(map(hashes.__getitem__, {w for t in texts for w in lm.tokens(t.encode())}), np.uint64)
    few = reader.words(h)
    assert len(reader.files) == 1
    monkeypatch.setattr(lm, "MAPS", 4096)
    assert all((a == b).all() for a, b in zip(few, lm.Reader(m).words(h))) and (few[0] > 0).all()


def brute(docs, items):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    out = Counter()
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k, x in items:
            v = words(x)
            for s in range(max(1, len(v) - 9) if v else 0):
                part = v[s : s + 10]
                for at in range(len(w) - len(part) + 1):
                    if w[at : at + len(part)] == part:
                        hit |= {*range(at, at + len(part))}
                        found.add(k)
        out[i, len(w), len(hit), len(found)] += 1
    return out


def test_windows_of_any_size_are_found_and_broadcasts_stay_within_the_limit(spark, monkeypatch):
    long_word = lambda c, n=3000: c * n
    han = [long_word(c) for c in "天地玄黃宇宙洪荒日月盈昃"]
    items = [(1, " ".join(han)), (2, long_word("長", 9000)), (3, "one two three four five six seven eight nine ten eleven"), (4, " ".join(f"short{i}" for i in range(40))), (5, None), (6, han[0] + " end")]
    docs = [(1, "before " + " ".join(han) + " after"), (2, " ".join(han[1:11])), (3, " ".join(han[:9])), (4, long_word("長", 9000)), (5, long_word("長", 8999)), (6, "x one two three four five six seven eight nine TEN y"), (7, " ".join(f"short{i}" for i in range(5, 30))), (8, None), (9, ""), (10, f"{han[0]}, End.")]
    docs += [(1, "before " + " ".join(han) + " after"), (None, han[0] + " end")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"wid_": F.lit(1), "h": F.lit(2), "here_": F.lit(3)})
    b = spark.createDataFrame(items, "item_id long, text string")
    sent = []
    real = F.broadcast

    def measured(df):
        width = sum((F.octet_length(c) for c, kind in df.dtypes if kind == "string"), F.lit(8 * len(df.columns)))
        sent.append(df.agg(F.sum(width)).first()[0] or 0)
        return real(df)

    monkeypatch.setattr(decontaminate.F, "broadcast", measured)
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 4096)
    got = Counter(tuple(r)[:4] for r in decontaminate.contamination(d, b).select("doc_id", "n_words", "n_hit", "n_items").collect())
    assert got == brute(docs, items) and sum(1 for k in got if k[2]) >= 7
    # a slice may exceed its share by a few rows, each of them bounded
    assert len(sent) > 3 and max(sent) <= 4096 + 4 * decontaminate.LONG_BYTES
    clean = decontaminate.clean_documents(d, b)
    assert sorted(r["doc_id"] for r in clean.collect()) == [3, 5, 8, 9] and clean.columns == d.columns
