"""Kernels of one group: their arrays are bounded, and tiles change no result."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matchweave.operators import graph, gridfilter, knn, lean, ransac


def peak_mb(work, *arguments) -> float:
    tracemalloc.start()
    try:
        work(*arguments)
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def plain(a, b, k):
    """{(i, j): (rank for i, rank for j)} by sorting whole rows and columns."""
    s, found = a @ b.T, {}
    for n, lists in enumerate((s, s.T)):
        for x, row in enumerate(lists):
            for rank, y in enumerate(np.lexsort((np.arange(len(row)), -row))[:k], 1):
                found.setdefault((y, x) if n else (x, int(y)), [0, 0])[n] = rank
    return {(int(i), int(j)): tuple(v) for (i, j), v in found.items()}


@pytest.mark.parametrize("n, m, k, top", [(100, 130, 5, 2), (100, 130, 5, 1000), (3, 70, 5, 2), (70, 1, 3, 1000), (65, 64, 1, 1)])
def test_ranks_by_tiles(monkeypatch, n, m, k, top):
    """Whole numbers make many ties; of these the first places count, whichever tile they are in."""
    monkeypatch.setattr(knn, "BLOCK", 16)
    monkeypatch.setattr(knn, "WIDTH", 32, raising=False)
    random = np.random.default_rng(n)
    a, b = (random.integers(-top, top + 1, (x, 4)).astype(float) for x in (n, m))
    row, column, value, *ranks = knn._ranks(a, b, k)
    assert {(i, j): (x, y) for i, j, x, y in zip(row.tolist(), column.tolist(), *(r.tolist() for r in ranks), strict=True)} == plain(a, b, k)
    assert np.array_equal(value, (a[row] * b[column]).sum(1))


def test_similarities_that_are_no_numbers_come_first(monkeypatch):
    monkeypatch.setattr(knn, "WIDTH", 2, raising=False)
    b = np.array([[1.0, 0.0], [0.5, 0.0], [np.nan, 0.0], [0.9, 0.0]])
    row, column, value, left, _ = knn._ranks(np.array([[1.0, 0.0]]), b, 2)
    got = {j: (v, n) for j, v, n in zip(column.tolist(), value.tolist(), left.tolist(), strict=True)}
    assert np.isnan(got[2][0]) and got[2][1] == 1 and got[0] == (1.0, 2)


@pytest.mark.parametrize("copies", [False, True])
def test_ranks_hold_tiles_only(copies):
    """A wide side, and one of equal vectors, of which all tie: neither makes an array as large as rows times side."""
    random = np.random.default_rng(1)
    a, b = random.normal(size=(600, 8)), random.normal(size=(12_000, 8))
    if copies:
        a[:], b[:] = a[0], a[0]
    assert peak_mb(knn._ranks, a, b, 5) < 45  # rows of 512 by 12,000 are 47 MB, and were held twice


@pytest.mark.parametrize("copies", [False, True])
def test_tiles_are_small(copies):
    """A tile and what is made of it, for either side, stay within a few MB; so do distances."""
    random = np.random.default_rng(5)
    a, b = random.normal(size=(1200, 8)), random.normal(size=(3000, 8))
    if copies:
        a[:], b[:] = a[0], a[0]
    assert peak_mb(knn._ranks, a, b, 3) < 8  # tiles of 256 by 2,048 took 9 MB, and 14 where all tie
    assert peak_mb(knn._nearest, a[:, :3], b[:, :3]) < 6  # 524,288 cells took 12 MB


def test_sides_are_read_without_a_joined_copy():
    """Arrow is not asked for one table of all batches: 4,000 vectors of 64 are 2 MB."""
    random = np.random.default_rng(4)
    idx, v = random.permutation(4000), random.normal(size=(4000, 64))
    batches = [pa.table({"idx": idx[i : i + 1500], "v": pa.array(list(v[i : i + 1500]))}) for i in (0, 1500, 3000)]
    table, pool, before = pa.concat_tables([*batches, batches[0][:0]]), pa.proxy_memory_pool(pa.default_memory_pool()), pa.default_memory_pool()
    pa.set_memory_pool(pool)
    try:
        got = knn._side(table)
    finally:
        pa.set_memory_pool(before)
    assert pool.max_memory() < 1 << 20
    assert np.array_equal(got[0], np.arange(4000)) and np.array_equal(got[1], v[np.argsort(idx)])


def test_sides_without_another_are_cut(spark):
    """Points of a pair that has one side only, or of no named pair, are dealt in blocks as others are; all come back."""
    point = lambda pair, n, at: [(pair, i, float(i), at, 0.0) for i in range(n)]
    schema = "pair_idx int, idx long, x double, y double, z double"
    left, right = (spark.createDataFrame(rows, schema) for rows in ([*point(0, 90, 0.0), *point(1, 20, 0.0), *point(None, 90, 0.0)], [*point(1, 20, 2.0), *point(None, 90, 3.0), *point(2, 90, 0.0)]))
    for side, mine, pairs in zip(knn.dealt(left, right, "pair_idx", 30), ("bl", "br"), ({0: 1, None: 3}, {2: 1, None: 3}), strict=False):
        found = {r.pair_idx: r for r in side.groupBy("pair_idx").agg(F.countDistinct(mine).alias("blocks"), F.count("*").alias("rows")).collect()}
        for pair, times in pairs.items():
            assert found[pair].blocks == 3 and found[pair].rows == 90 * times
    near = knn.nearest_error(left, right, most=30).collect()
    assert len(near) == 200 and {(r.pair_idx, r.min_error) for r in near} == {(0, float("inf")), (1, 2.0), (None, 3.0)}


def test_nearest_holds_few_cells():
    random = np.random.default_rng(2)
    a, b = random.normal(size=(2000, 3)), random.normal(size=(2000, 3))
    assert peak_mb(knn._nearest, a, b) < 20  # a million cells of three coordinates are 24 MB, and were held twice
    assert np.allclose(knn._nearest(a[:50], b), np.sqrt(((a[:50, None] - b[None]) ** 2).sum(2)).min(1), rtol=1e-12)
    assert np.isinf(knn._nearest(a, b[:0])).all()


@pytest.mark.parametrize("mode", ["hcm_mc", "mcm"])
def test_scores_of_poses_hold_few_cells(mode):
    """Many poses on a large pair: no array of all poses by all edges, and each pose is scored as it is by itself."""
    random, n = np.random.default_rng(3), 20_000
    x = random.normal(size=(n, 4)) / 4
    pdf = pd.DataFrame({"left_idx": np.arange(n) // 2, "right_idx": random.integers(0, n // 2, n), **dict(zip(("x1", "y1", "x2", "y2"), x.T, strict=True)), "p": 0.15, "left_c": 120.0, "right_c": 130.0})
    pair = ransac.Pair(pdf, ransac.Options(mode=mode, threshold=0.05))
    r, t = np.linalg.qr(random.normal(size=(600, 3, 3)))[0], random.normal(size=(600, 3))
    assert peak_mb(pair.score, r, t) < 40  # 600 poses by 20,000 edges are 12 MB of booleans, a million cells of two lines 48 MB
    scored = pair.score(r, t)
    assert scored.inliers.sum() > 0
    for i in (0, 7, 599):
        alone = pair.mask(r[i], t[i])[0]
        assert scored.inliers[i] == alone.sum()
        if mode == "mcm":
            assert pair.seed(scored, i).cardinality == pair.one_to_one(alone)


def test_memory_goes_back_after_large_groups(monkeypatch):
    """Of one table, two tables, or a key and a table; also where a group fails."""
    asked = []
    monkeypatch.setattr(lean, "give_back", lambda: asked.append(1))
    assert lean.lean(lambda table: table[0])([7]) == 7 and not asked
    assert lean.lean(lambda table: len(table))([0] * lean.LARGE) == lean.LARGE and len(asked) == 1
    assert lean.lean(lambda key, table: key[0] + table[0])((1,), [2] * lean.LARGE) == 3 and len(asked) == 2
    with pytest.raises(ZeroDivisionError):
        lean.lean(lambda left, right: 1 // 0)([0] * lean.LARGE, [])
    assert len(asked) == 3


def test_degree_cap_of_a_large_pair(spark):
    """A group above the bound of ``lean`` goes through it with the result of a plain program."""
    edges = [(0, i % 37, 100 + i % 41, i) for i in range(1400)]
    left, right, want, open_, limit = {}, {}, [], list(edges), 1
    while open_ and len(want) < 500:
        later = []
        for e in open_:
            if len(want) < 500 and left.get(e[1], 0) < limit and right.get(e[2], 0) < limit:
                left[e[1]], right[e[2]] = left.get(e[1], 0) + 1, right.get(e[2], 0) + 1
                want.append(e)
            else:
                later.append(e)
        open_, limit = later, limit + 1
    found = graph.progressive_degree_cap(spark.createDataFrame(edges, "pair_idx int, left_idx long, right_idx long, ordinal long"), 500)
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_grid_filter_of_a_large_pair(spark):
    """A pair above the bound of ``lean``, matches on a line, goes through the filter whole."""
    n = 2 * lean.LARGE
    edges = spark.range(n).select(F.lit(0).alias("pair_idx"), F.col("id").alias("left_idx"), F.col("id").alias("right_idx"), *((F.col("id") / n).alias(f"{c}{s}") for s in "12" for c in "xy"))
    assert gridfilter.filter_exact(edges, 8, 0.7).count() == n
