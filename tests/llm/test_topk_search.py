import numpy as np
import pytest
from pyspark.sql import functions as F

from kotoflow.llm import topk_search as ts


def brute(rows, step, k):
    q = {}
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in ok:
        if i % step == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i and len(w) == len(v))
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 90])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] * (i % 3) + 0.05 * rng.normal(size=8)).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(150)]  # ties
    rows += [(2000, None), (2005, [1.0, None] + [0.0] * 6), (2010, [float("nan")] * 8), (2015, []), (2020, [1.0, 2.0]), (2025, [3.0, -1.0]), (None, [1.0] * 8), (2030, [float("inf")] * 8)]
    df = spark.createDataFrame([r + ("x", 1) for r in rows], "vec_id long, embedding array<double>, block string, score int")
    got = sorted(tuple(r) for r in ts.top_k(df, F.col("vec_id") % 5 == 0, k=5, block=block).collect())
    assert got == brute(rows, 5, 5)


def test_huge_repeated_and_empty(spark):
    df = spark.createDataFrame([(0, [1e15, 1e15]), (1, [2e15, 3e15]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (0, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ts.top_k(df, F.col("vec_id") == 0, k=2).collect())
    assert got[0] == (0, 1, 1, 2**63 - 1) or got[0][:3] == (0, 1, 1)
    assert len(got) == 4
    assert ts.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_pruning_skips_pairs():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 4)) * 3 + c for c in rng.normal(size=(6, 4)) * 400]).astype(np.int64)
    ids = np.arange(len(x))
    t = ts.CoverTree(x)
    assert sorted(t.order.tolist()) == ids.tolist() and t.root.children
    s = ts.Search(x, ids, t, x, ids, t, 5)
    assert s.compared < 0.7 * len(x) ** 2
