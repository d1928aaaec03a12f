"""Searches against brute force, with ties, nulls and odd vectors."""

import random

import numpy as np
import pytest

from trilith.llm import ann
from trilith.llm.components import connected_components
from trilith.llm.topk import top_k

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def rows():
    g = np.random.default_rng(1)
    v = [[float(x) for x in np.float32(g.standard_normal(32))] for _ in range(700)]
    v[5] = v[4]
    v[10] = list(v[4])
    odd = [None, [], [0.0] * 32, [1.0, None], [NAN] * 32, [INF] * 32, [1.0, 2.0], [3.0, -1.0]]
    return [(i, x) for i, x in enumerate(v + odd)] + [(4, v[4]), (None, v[0])]


@pytest.fixture(scope="module")
def vectors(spark, rows):
    return spark.createDataFrame([(i, x, "old") for i, x in rows], "vec_id long, embedding array<float>, score string")


def valid(x):
    return x is not None and all(c is not None and np.isfinite(c) for c in x)


def test_exact(vectors, rows):
    got = {}
    for r in top_k(vectors, vectors.where("vec_id % 50 = 0 OR vec_id >= 700"), shard=64, query_block=8).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    use = [(i, [int(np.floor(256 * float(c))) for c in x]) for i, x in rows if i is not None and valid(x)]
    for q, x in use:
        if q % 50 == 0 or q >= 700:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in use if i != q and len(y) == len(x))[:5]
            assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)], q


def test_exact_past_doubles(spark):
    big = spark.createDataFrame([(0, [3e7, 1.0]), (1, [3e7, 2.0]), (2, [3e7, 3.0]), (3, [3e37, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in top_k(big, big.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (2, 2**63 - 1), (3, 2**63 - 1)]
    small = spark.createDataFrame([(0, [9e6, 1.0]), (1, [4e6, 2.0]), (2, [4e6, 3.0])], "vec_id long, embedding array<double>")
    a = 256 * 9_000_000 * 256 * 4_000_000
    assert [(r.vec_id, r.score) for r in top_k(small, small.where("vec_id = 0")).orderBy("rank").collect()] == [(2, a + 256 * 768), (1, a + 256 * 512)]


def test_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(none, none).count() == 0 and ann.nearest(ann.index(none), ann.index(none)).count() == 0


def test_approximate_recall_and_scores(vectors, rows):
    indexed = ann.index(vectors)
    got = {}
    for r in ann.nearest(indexed, indexed.where("vec_id % 20 = 0 OR vec_id >= 700"), shard=128).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    use = [(i, np.array(x, float)) for i, x in rows if i is not None and valid(x) and any(x)]
    found = total = 0
    for q, x in use:
        if q % 20 == 0 or q >= 700:
            best = sorted((-float(x @ y), i) for i, y in use if i != q and len(y) == len(x))[:20]
            mine = sorted(got[q])
            assert len(mine) == len(best) and [k for k, _, _ in mine] == list(range(1, len(best) + 1))
            original = {i: y for i, y in use}
            assert all(abs(s - float(x @ original[i])) < 1e-9 for _, i, s in mine)
            found += len({i for _, i in best} & {i for _, i, _ in mine})
            total += len({i for _, i in best})
    assert found >= 0.98 * total


def test_estimates_are_unbiased_and_bounded():
    g = np.random.default_rng(4)
    v, q = g.standard_normal((3000, 64)), g.standard_normal((20, 64))
    about, bound = ann.estimates(q, *ann.encode(v))
    off = about - ann.directions(q)[0] @ v.T
    assert (np.abs(off) <= bound).mean() > 0.97 and abs(off.mean()) < 0.05 * np.abs(off).mean() + 0.05


def test_large_and_small_components(spark):
    g = np.random.default_rng(6)
    v = g.standard_normal((300, 16)) * 10.0 ** g.integers(-140, 140, (300, 1))
    v[:40] = g.standard_normal((40, 16)) * 1e150
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    indexed = ann.index(frame)
    got = {}
    for r in ann.nearest(indexed, indexed.where("vec_id % 20 = 0"), shard=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q in range(0, 300, 20):
        score = v @ v[q]
        best = [i for i in np.lexsort((np.arange(300), -score)) if i != q][:20]
        assert len({i for _, i in got[q]} & set(best)) >= 18, q


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + j) for j in range(1, 80)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(150)] + [(7, 7)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert all(c == top(n) for n, c in got.items()) and set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "x long, y long")).count() == 0
