"""Recall of the neighbours over several blocks of codes, and vectors out of the ordinary."""

import numpy as np

from lodestar.llm import aq


def recall(spark, x, every, **how):
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in aq.nearest(spark, df, every=every, k=5, **how).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = range(0, len(x), every)
    hit = 0
    for q in asked:
        s = n @ n[q]
        s[q] = -9
        hit += len(set(np.argsort(-s)[:5].tolist()) & got[q])
    return hit / (5 * len(asked))


def test_recall_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(aq, "BLOCK", 400)
    x = np.random.default_rng(3).normal(size=(6000, 64))
    # few candidates a block: the best of all blocks would be as few
    assert recall(spark, x, 50, candidates=6) >= 0.95


def test_recall_where_candidates_are_a_small_share(spark):
    """60,000 vectors without any structure, of which each query has 128 of a block ranked again (at most 0.9 %)."""
    x = np.random.default_rng(4).normal(size=(60_000, 64))
    assert recall(spark, x, 600) >= 0.9


def test_extreme_sizes_and_mixed_dimensions(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8))
    rows = [(i, (r * 10.0 ** (0, 170, -170, 300, -300)[i % 5]).tolist()) for i, r in enumerate(x)]
    rows += [(100 + i, r[:3].tolist()) for i, r in enumerate(x[:7])] + [(200, [2.0]), (250, [-1.0]), (50, x[3].tolist())]
    got = {}
    for r in aq.nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(got) == [0, 50, 100, 200, 250]
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = sorted([(-float(n[0] @ n[i]), i) for i in range(1, 60)] + [(-float(n[0] @ n[3]), 50)])
    assert [v for v, _ in got[0]] == [i for _, i in s[:5]] and np.allclose([c for _, c in got[0]], [-c for c, _ in s[:5]], atol=1e-12)
    assert len(got[50]) == 10  # two rows of this id, each a query
    assert got[200] == [(250, -1.0)] and got[250] == [(200, -1.0)] and {v for v, _ in got[100]} <= set(range(101, 107))
