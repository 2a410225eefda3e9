"""The exact join of angles against brute force."""

import numpy as np
import pytest

from linkloom.operators import keywords as K


def brute(rows, threshold):
    out = {}
    for k, (i, a) in enumerate(rows):
        for j, b in rows[k + 1 :]:
            if len(a) == len(b) and i != j:
                s = round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 4)
                if s >= threshold:
                    out[min(i, j), max(i, j)] = s
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(3)


def test_clustered_vectors_are_compared_within_reach_only(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 24))
    rows = [(i, centres[i % 30] + rng.normal(size=24) * 0.12) for i in range(1500)]
    report = {}
    got = {(r["a"], r["b"]): r["similarity"] for r in K.overlap_pairs(frame(spark, rows), 0.86, block=50, report=report).collect()}
    assert got == brute(rows, 0.86) and len(got) > 20000
    assert report["compared"] < 1500**2 / 2 / 5


@pytest.mark.parametrize("block,pivots", [(1024, 24), (7, 3), (1, 1)])
def test_any_blocks_give_the_same_pairs(spark, block, pivots):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4)) for i in range(60)] + [(100 + i, np.array([1.0, 2.0, 0.5, -1.0]) * (i + 1)) for i in range(15)] + [(200 + i, rng.normal(size=3)) for i in range(20)]
    odd = [(300, None), (301, []), (302, [0.0] * 4), (303, [float("nan"), 1, 1, 1]), (304, [float("inf"), 1, 1, 1])]
    got = [(r["a"], r["b"], r["similarity"]) for r in K.overlap_pairs(frame(spark, rows + odd), 0.7, block=block, pivots=pivots).collect()]
    want = brute(rows, 0.7)
    assert len(got) == len(want) and {(a, b) for a, b, _ in got} == want.keys() and all(abs(want[a, b] - s) <= 1.01e-4 for a, b, s in got)


def test_no_vectors(spark):
    assert K.overlap_pairs(frame(spark, [])).count() == 0 and K.overlap_pairs(frame(spark, [(1, None)])).count() == 0
