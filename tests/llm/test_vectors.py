"""Nearest neighbours against all pairs, with nulls, zeros, ties, repeats, copies and clashing columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import projection_forest as forest

SCHEMA = "vec_id long, embedding array<float>, key string, ids string, leaves string, block string, task string, kind string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *"abcdefg") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, asked, k=5):
    """The `k` nearest of each asked id by cosine in double precision, ties to the smaller id."""
    width = max((len(v) for _, v in rows if v), default=0)
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.zeros(width)
            x[: len(v)] = np.float32(v)
            whole.setdefault(i, []).append(x)
    out = {}
    for i in whole:
        if asked(i):
            near = [(max(float(a @ b / math.sqrt((a @ a) * (b @ b))) for a in whole[i] for b in whole[j]), j) for j in whole if j != i]
            out[i] = sorted(((-s, j) for s, j in near))[:k]
    return out


def clustered(n, width, rng, centres=12):
    middle = rng.normal(size=(centres, width)) * 2
    return (middle[rng.integers(0, centres, n)] + rng.normal(size=(n, width))).astype(np.float32)


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_odd_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [round(float(x), 1) for x in rng.normal(size=4)]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 0.0, 0.0]), (204, [math.nan, 1.0, 0.0, 0.0]), (205, [math.inf, 1.0, 0.0, 0.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    rows += [(300 + i, rows[10][1]) for i in range(20)] + [(rows[10][0], rows[10][1])] + [(400, [1.0]), (410, [0.5, 0.5]), (420, [-0.0, 0.0, 2.0, 0.0])] + [(430, [1.0, 0.0, 0.0, 0.0]), (430, [0.0, 1.0, 0.0, 0.0])]
    want = brute(rows, lambda i: i % 10 == 0)
    got = found(forest.nearest(frame(spark, rows), F.col("vec_id") % 10 == 0, visits=1 << 20))  # all leaves
    assert set(got) == set(want) and {10, 300, 310, 400, 410, 420, 430} <= set(got)
    for i, near in want.items():
        assert [r for r, _, _ in got[i]] == [1, 2, 3, 4, 5]
        assert np.allclose([s for _, _, s in got[i]], [-s for s, _ in near], atol=1e-12), i
        clear = [s for s, _ in near]
        if len({round(s, 9) for s in clear}) == 5:
            assert [j for _, j, _ in got[i]] == [j for _, j in near]
    assert [j for _, j, _ in got[310]] == [10, 300, 301, 302, 303]  # copies tie exactly


def test_few_rows(spark):
    assert forest.nearest(frame(spark, []), F.col("vec_id") % 50 == 0).collect() == []
    assert forest.nearest(frame(spark, [(0, [1.0])]), F.col("vec_id") % 50 == 0).collect() == []
    got = found(forest.nearest(frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-2.0, 0.0])]), F.col("vec_id") % 50 == 0))
    assert [(r, j) for r, j, _ in got[0]] == [(1, 1), (2, 2)] and got[0][1][2] == -1.0


@pytest.mark.parametrize("kind", ["clusters", "noise", "copies"])
def test_recall(spark, monkeypatch, kind):
    rng = np.random.default_rng(3)
    vectors = {"clusters": lambda: clustered(4000, 24, rng), "noise": lambda: rng.normal(size=(3000, 24)), "copies": lambda: np.concatenate([rng.normal(size=(2000, 24)), np.ones((1000, 24)) + rng.normal(size=(1000, 24)) * 1e-4])}[kind]()
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.float32(vectors))]
    monkeypatch.setattr(forest, "ROWS", 50)  # blocks and queries in several parts
    monkeypatch.setattr(forest, "QUERIES", 7)
    monkeypatch.setattr(forest, "STEP", 16)
    got = found(forest.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0))
    want = brute([r for r in rows], lambda i: i % 500 == 0)
    share = np.mean([j in {x for _, x, _ in got[i]} for i, near in want.items() for _, j in near])
    assert share >= 0.9 and len(got) == len(rows) // 50 and all(len(x) == 5 for x in got.values())
    if kind == "copies":
        return
    score = {i: np.array([float(x) for x in v]) for i, v in rows}
    for i in list(got)[:5]:
        assert np.allclose([s for _, _, s in got[i]], [score[i] @ score[j] / np.linalg.norm(score[i]) / np.linalg.norm(score[j]) for _, j, _ in got[i]], atol=1e-12)
        assert got[i] == sorted(got[i], key=lambda x: (-x[2], x[1]))


def test_searches_take_few_leaves_where_there_are_clusters():
    rng = np.random.default_rng(5)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    near, far = forest.fit(unit(clustered(4000, 24, rng, 60) * 1.0), 5), forest.fit(unit(rng.normal(size=(4000, 24))), 5)
    assert near[1] < far[1] / 2


def test_queue_takes_the_cheapest_leaves():
    """Against the costs of all leaves, worked out path by path."""
    rng = np.random.default_rng(7)
    sample = rng.normal(size=(600, 8)).astype(np.float32)
    trees = [forest.grow(sample, 40, rng) for _ in range(3)]
    whole = forest.Forest(trees)
    assert sorted(np.bincount(whole.leaves_of(sample).ravel(), minlength=whole.n_leaves).tolist())[0] > 0

    def costs(q):
        out = {}

        def walk(k, node, cost):
            if node < 0:
                out[int(whole.first[k]) - 1 - node] = cost
                return
            by = float(q @ trees[k].planes[node] - trees[k].offsets[node])
            for side in (0, 1):
                walk(k, int(trees[k].sides[node, side]), cost + (0.0 if (by >= 0) == side else by * by))

        for k, t in enumerate(trees):
            walk(k, t.root, 0.0)
        return out

    for q, taken in zip(sample[:20], whole.search(sample[:20], 12), strict=True):
        want = costs(q)
        assert len(set(taken)) == 12
        assert np.allclose([want[x] for x in taken], sorted(want.values())[:12], atol=1e-4)
        assert {int(x) for x in whole.leaves_of(q[None])[0]} <= set(taken)
