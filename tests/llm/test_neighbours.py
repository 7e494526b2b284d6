"""Nearest neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import neighbours, queries
from trackloom.llm.neighbours import Codes, NeighbourConfig


def brute(rows, k=10, every=100):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and i is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = {}
    for q, qv in good:
        if q % every == 0:
            d = sorted((float(np.sqrt(((v - qv) ** 2).sum())), i) for i, v in good if i != q)
            out[q] = [(i, s) for s, i in d[:k]]
    return out


def compare(rows, got, least):
    want = brute(rows)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == {q for q, w in want.items() if w}
    hit = total = 0
    exact = {q: dict(brute_scores(rows, q)) for q in by}
    for q, g in by.items():
        g.sort()
        assert [x[0] for x in g] == list(range(1, len(g) + 1))
        assert [(s, i) for _, i, s in g] == sorted((s, i) for _, i, s in g)
        for _, i, s in g:
            assert s == pytest.approx(exact[q][i], rel=1e-12, abs=1e-12)
        assert len(g) == len(want[q])
        hit += len({i for _, i, _ in g} & {i for i, _ in want[q]})
        total += len(g)
    assert hit >= least * total


def brute_scores(rows, q):
    qv = np.array(dict(rows)[q], float)
    return [(i, float(np.sqrt(((np.array(v, float) - qv) ** 2).sum()))) for i, v in rows if v is not None and len(v) == len(qv) and None not in v]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_embeddings(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    compare(rows, queries.op8_anisotropic_neighbours(spark, f"/root/testdata/{sf}").collect(), 0.95)


def test_many_cells_and_copies(spark):
    r = np.random.default_rng(3)
    x = np.concatenate((r.normal(size=(2500, 8)), np.repeat(r.normal(size=(1, 8)), 700, 0), r.normal(size=(800, 8)) * 0.1 + 3)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x[r.permutation(len(x))])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0, NeighbourConfig(per_cell=200, block=150, rerank=60)).collect()
    compare(rows, got, 0.9)


@pytest.mark.parametrize("cfg", [
    NeighbourConfig(per_cell=20, cells=12, split=5, block=40, queries=3, rerank=30),
    NeighbourConfig(per_cell=60, block=25, queries=2, rerank=15),
])
def test_two_levels_and_blocks_of_queries(spark, cfg):
    r = np.random.default_rng(5)
    x = np.concatenate((r.normal(size=(9, 6))[r.integers(0, 9, 1500)] * 4 + r.normal(size=(1500, 6)) * 0.2, np.repeat(r.normal(size=(1, 6)), 800, 0)))
    rows = [(i * 20, [float(c) for c in v]) for i, v in enumerate(x[r.permutation(len(x))])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, cfg).collect()
    compare(rows, got, 0.9)


def test_equal_vectors_have_the_smallest_ids(spark):
    rows = [(i, [1.0, 0.0 if i % 2 else -0.0]) for i in range(300)] + [(1000 + i, [2.0 + i, 0.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0, NeighbourConfig(block=4, queries=1)).collect()
    by = {q: [g.vec_id for g in sorted(got, key=lambda g: g["rank"]) if g.query_id == q] for q in (0, 100, 200, 1000)}
    assert by == {0: list(range(1, 11)), 100: list(range(10)), 200: list(range(10)), 1000: list(range(10))}


def test_repeated_ids(spark):
    near = [(100, [1.0, 1.0 + k / 100]) for k in range(30)]
    rows = [*near, (100, [1.0, 1.0]), *[(7, [1.0, 1.5])] * 4, *[(k, [1.0, 2.0 + k]) for k in range(20, 30)], *[(200, [1.0, 1.5])] * 2]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect()
    # every vector of id 100 has its own list, without any row of id 100
    mine = [g for g in got if g.query_id == 100]
    assert len(mine) == 300 and 100 not in {g.vec_id for g in mine}
    assert sum(g.vec_id == 7 for g in mine) == 120 and sum(g.vec_id == 200 for g in mine) == 60
    other = sorted((g["rank"], g.vec_id) for g in got if g.query_id == 200)
    assert len(other) == 10 and [v for _, v in other[:4]] == [7] * 4 and {v for _, v in other[4:]} == {100}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (5, [0.0, 0.0]), (6, None), (7, [nan, 1.0]), (8, [1.0, None]), (9, [inf, 0.0]), (3, [4.0, 5.0]), (2, [1.0, 2.0]), (200, [1e30, -1e30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect()
    assert [(g.query_id, g["rank"], g.vec_id) for g in sorted(got, key=lambda g: (g.query_id, g["rank"])) if g.query_id == 0] == [(0, 1, 2), (0, 2, 100), (0, 3, 3), (0, 4, 200)]
    assert {g.query_id for g in got} == {0, 100, 200}
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert neighbours.nearest(df.filter("vec_id = 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_anisotropic_codes_keep_parallel_error_small():
    x = np.random.default_rng(1).normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    plain, aware = Codes(x, 1.0, 3), Codes(x, 8.0, 3)
    along = lambda c: float((((x - c.decode(c.encode(x))) * x).sum(1) ** 2).mean())
    assert along(aware) < 0.5 * along(plain)
    code = neighbours.packed(aware.encode(x))
    assert np.allclose(neighbours.table_scan(code, aware.table(x[5])), aware.decode(aware.encode(x)) @ x[5])
