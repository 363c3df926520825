"""Operators against hand-made values and brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchweave.functions import geometry as g
from matchweave.functions import text, vector
from matchweave.operators import checks, frontier, graph, gridfilter, knn, metrics, ransac, sampling, scoring, splits
from matchweave.plans import reports


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def vectors(spark, rows):
    return spark.createDataFrame([(0, i, [float(x) for x in v]) for i, v in enumerate(rows)], "pair_idx int, idx long, v array<double>")


# ---------------------------------------------------------------- neighbours
def test_small_mutual_knn(spark):
    l, r = vectors(spark, [[1, 0], [0, 1]]), vectors(spark, [[1, 0], [0.2, 0.98]])
    rows = sorted((x.k, -round(x.similarity, 3), x.left_idx, x.right_idx) for x in knn.mutual_knn(l, r, 2).collect())
    assert [(k, a, b) for k, _, a, b in rows] == [(1, 0, 0), (1, 1, 1), (2, 0, 1), (2, 1, 0)]


@pytest.mark.parametrize(("k", "most"), [(1, 0), (5, 20), (50, 0)])
def test_mutual_knn_equals_the_incremental_loop(spark, k, most):
    rng = np.random.default_rng(42)
    a, b = rng.standard_normal((17, 8)), rng.standard_normal((19, 8))
    b[7] = b[3]  # ties go to the smaller index
    s = a @ b.T
    best = lambda m: [sorted(range(m.shape[1]), key=lambda j, i=i: (-m[i, j], j)) for i in range(m.shape[0])]
    fwd, rev = best(s), best(s.T)
    seen: dict = {}
    for n in range(1, k + 1):
        for i in range(17):
            for j in fwd[i][:n]:
                if i in rev[j][:n]:
                    seen.setdefault((i, j), n)
    want = sorted(((n, -s[e], *e) for e, n in seen.items()))[: most or None]
    got = sorted((x.k, -x.similarity, x.left_idx, x.right_idx) for x in knn.mutual_knn(vectors(spark, a), vectors(spark, b), k, most).collect())
    assert [(n, i, j) for n, _, i, j in got] == [(n, i, j) for n, _, i, j in want]


def test_mutual_knn_with_an_empty_side(spark):
    l = vectors(spark, [[1, 0]])
    assert knn.mutual_knn(l, l.limit(0), 3).count() == 0 and knn.mutual_knn(l.limit(0), l.limit(0), 3).count() == 0


def test_entry_rank_sentinel(spark):
    l, r = vectors(spark, [[1, 0], [0.9, 0.1]]), vectors(spark, [[1, 0]])
    got = {x.left_idx: x.entry_k for x in knn.mutual_entry(l, r, 1).collect()}
    assert got == {0: 1, 1: 2}


def test_compact_ids(spark):
    e = spark.createDataFrame([(0, 2, 1, 0.9, 1), (0, 0, 2, 0.5, 2)], "pair_idx int, left_idx long, right_idx long, similarity double, k int")
    value = sorted((r.left_idx.was, r.left_idx.now, r.right_idx.now, r.k) for r in knn.compact_by_value(e).collect())
    first = sorted((r.left_idx.was, r.left_idx.now, r.right_idx.now) for r in knn.compact_by_appearance(e).collect())
    assert value == [(0, 0, 1, 2), (2, 1, 0, 1)] and first == [(0, 1, 1), (2, 0, 0)]


def test_bilinear(spark):
    points = spark.createDataFrame([(8.0, 8.0), (24.0, 8.0), (0.0, 0.0), (16.0, 16.0)], "x double, y double")
    inside, corners = knn.bilinear_rows(F.col("x"), F.col("y"), 16, 2, 2)
    rows = points.select(inside.alias("inside"), corners.alias("c")).collect()
    assert [r.inside for r in rows] == [True, True, False, True]
    assert [(c.gx, c.gy) for c in rows[1].c if c.weight] == [(1, 0)] and [c.weight for c in rows[3].c] == [0.25] * 4


def test_nearest_error(spark):
    p = lambda rows: spark.createDataFrame(rows, "pair_idx int, idx long, x double, y double, z double")
    got = {r.idx: r.min_error for r in knn.nearest_error(p([(0, 1, 0.0, 0.0, 0.0), (1, 2, 0.0, 0.0, 0.0)]), p([(0, 9, 3.0, 4.0, 0.0), (0, 8, 9.0, 9.0, 9.0)])).collect()}
    assert got == {1: 5.0, 2: math.inf}


# ---------------------------------------------------------------- graphs
def brute_matching(edges):
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
    owner: dict = {}

    def augment(a, seen):
        for b in near[a]:
            if b not in seen:
                seen.add(b)
                if b not in owner or augment(owner[b], seen):
                    owner[b] = a
                    return True
        return False

    return sum(augment(a, set()) for a in near)


def test_matching():
    assert graph.matching([(0, 0), (0, 1), (1, 0), (2, 1), (2, 2)]) == {0: 1, 1: 0, 2: 2}
    rng = random.Random(1)
    for _ in range(500):
        edges = [(a, b) for a in range(rng.randint(0, 9)) for b in range(rng.randint(0, 9)) if rng.random() < 0.28]
        found = graph.matching(edges + edges)
        assert len(found) == brute_matching(edges) == len(set(found.values())) and all(e in edges for e in found.items())
        rng.shuffle(edges)
        assert graph.matching(edges) == found
    chain = [(i, i) for i in range(3000)] + [(i, i + 1) for i in range(3000)]
    assert len(graph.matching(chain)) == 3000


def test_max_matching_by_group(spark):
    e = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 0, 5), (2, 0, 6), (2, 3, 6)], "pair_idx int, left_idx int, right_idx int")
    got = graph.max_matching(e, ["pair_idx"]).groupBy("pair_idx").count().collect()
    assert {r.pair_idx: r["count"] for r in got} == {1: 1, 2: 2}


def test_nested_sizes(spark):
    e = spark.createDataFrame([(0, i, i, 1.0, i) for i in range(1, 6)], "pair_idx int, left_idx long, right_idx long, similarity double, k int")
    got = {r.target_k: r["count"] for r in graph.nested(e, 5).groupBy("target_k").count().collect()}
    assert got == {k: k for k in range(1, 6)}


def test_progressive_degree_cap(spark):
    e = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 2), (0, 1, 1, 3), (0, 1, 0, 4)], "pair_idx int, left_idx int, right_idx int, ordinal int")
    take = lambda n: [r.ordinal for r in graph.progressive_degree_cap(e, n).orderBy("ordinal").collect()]
    assert take(2) == [1, 3] and take(3) == [1, 2, 3] and take(9) == [1, 2, 3, 4]


def test_degree_prior_and_mass(spark):
    e = spark.createDataFrame([(0, 0, 0), (0, 0, 1)], "pair_idx int, left_idx int, right_idx int")
    rows = graph.node_mass(graph.degree_prior(e, 0.3), 0.01).orderBy("right_idx").collect()
    assert [round(r.p, 9) for r in rows] == [0.225, 0.225] and round(rows[0].left_mass, 9) == 0.45 and round(rows[0].left_c, 6) == round(1 / (0.55 * 0.01), 6)
    override = scoring.with_prior(e.withColumn("prob", F.when(F.col("right_idx") == 0, 0.5))).orderBy("right_idx").collect()
    assert [round(r.p, 9) for r in override] == [0.5, 0.225]


# ---------------------------------------------------------------- grid filter
def test_turned_neighbourhoods():
    for turn in range(8):
        n = gridfilter.neighbours(turn)
        assert len(n) == 9 and {x[:2] for x in n} == {x[2:] for x in n} == set(itertools.product((-1, 0, 1), repeat=2))
    # turned by two eighths, the cell above the centre belongs to the cell left of it
    assert {x[:2]: x[2:] for x in gridfilter.neighbours(2)}[(0, -1)] == (-1, 0)


def test_grid_filter_keeps_a_coherent_set(spark):
    rows = [(0, i, i, 0.5 + i / 2000, 0.5 + i / 2000, 0.5 + i / 2000, 0.5 + i / 2000) for i in range(10)]
    rows += [(0, 100 + i, 100 + i, 0.05, 0.05, (i % 5) / 5 + 0.03, (i // 5) / 5 + 0.03) for i in range(20)]  # one left cell, scattered right cells
    e = spark.createDataFrame(rows, "pair_idx int, left_idx long, right_idx long, x1 double, y1 double, x2 double, y2 double")
    kept = sorted(r.left_idx for r in gridfilter.filter_exact(e, 20, 3.0).collect())
    assert kept == list(range(10))
    placed = gridfilter.cells(e, 20)
    bound = gridfilter.inliers(placed, gridfilter.supported_cells(gridfilter.cell_statistics(placed), 20, factor=3.0))
    assert sorted(r.left_idx for r in bound.filter("inlier").collect()) == list(range(10))
    assert gridfilter.filter_exact(e.limit(0), 20).count() == 0 and gridfilter.filter_exact(e, 20, 1e9, with_scale=True, with_rotation=True).count() == 0


def test_bounds(spark):
    e = spark.createDataFrame([(0, 0, 0, 10.0, 0.0, 0.0, 0.0), (0, 1, 1, 48.0, 19.0, 38.0, 1.0)], "pair_idx int, left_idx int, right_idx int, x1 double, y1 double, x2 double, y2 double")
    r = gridfilter.bounds(e, 20).first()
    assert (r.x1_from, r.x1_size, r.y1_from, r.y1_size, r.x2_from, r.x2_size) == (9.0, 41, -1.0, 22, -1.0, 41)


def test_image_areas(spark):
    """Twice the principal point, or as far as the points reach; without a usable size the reach alone."""
    e = spark.createDataFrame([(p, i, i, x, 2.0, 3.0, 0.2) for p in (0, 1, 2) for i, x in enumerate((10.0, 48.9))], "pair_idx int, left_idx int, right_idx int, x1 double, y1 double, x2 double, y2 double")
    cameras = spark.createDataFrame([(0, 320.0, 240.25, 0.1, 1.75), (1, None, 240.0, 1.0, 1.0)], "pair_idx int, cx1 double, cy1 double, cx2 double, cy2 double")
    got = {r.pair_idx: (r.x1_size, r.y1_size, r.x2_size, r.y2_size, r.x1_from) for r in gridfilter.image_areas(e, gridfilter.image_sizes(cameras)).collect()}
    assert got == {0: (640, 481, 4, 4, 0.0), 1: (49, 3, 4, 1, 0.0), 2: (49, 3, 4, 1, 0.0)}
    rows = [(1, i, i, 100.0 + i, 100.0 + i, 110.0 + i, 100.0 + i, 5, 0.9 - i / 100) for i in range(10)]
    many = spark.createDataFrame(rows, "pair_idx int, left_idx int, right_idx int, x1 double, y1 double, x2 double, y2 double, k int, similarity double")
    sizes = gridfilter.image_sizes(spark.createDataFrame([(1, 500.0, 500.0, 500.0, 500.0)], "pair_idx int, cx1 double, cy1 double, cx2 double, cy2 double"))
    assert sorted((r.left_idx, r.right_idx) for r in gridfilter.filter_files(many, sizes=sizes).collect()) == [(i, i) for i in range(10)]


# ---------------------------------------------------------------- geometry
def literal(v):
    return [F.lit(float(x)) for x in v]


def test_rotations(spark):
    half = math.sqrt(0.5)
    r = one(spark, *[x for row in g.rotation(literal([half, 0, 0, half])) for x in row])
    assert np.allclose(r, [0, -1, 0, 1, 0, 0, 0, 0, 1])
    rng = np.random.default_rng(1)
    for _ in range(3):
        q, p = (x / np.linalg.norm(x) for x in rng.standard_normal((2, 4)))
        back = one(spark, *g.canonical(g.quaternion(g.rotation(literal(q)))))
        assert np.allclose(back, q * np.sign(q[0]))
        angle = one(spark, g.rotation_error(literal(q), literal(p)))[0]
        assert math.isclose(angle, 2 * math.degrees(math.acos(min(1, abs(q @ p)))), abs_tol=1e-5)
    for q in ([0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]):  # half turns take the other branches
        assert np.allclose(np.abs(one(spark, *g.quaternion(g.rotation(literal(q))))), q)
    assert one(spark, *g.unit_quaternion(literal([0, 0, 0, 0]))) == [1, 0, 0, 0]


def test_pose_errors(spark):
    t = one(spark, g.translation_error(literal([1, 0, 0]), literal([-2, 0, 0])), g.translation_error(literal([1, 0, 0]), literal([0, 3, 0])), g.translation_error(literal([0, 0, 0]), literal([0, 3, 0])))
    assert t == [0.0, 90.0, None]
    e = one(spark, g.pose_error(F.lit(1.0), F.lit(2.0)), g.pose_error(F.lit(float("nan")), F.lit(3.0)), g.pose_error(F.lit(None).cast("double"), F.lit(3.0)), g.pose_error(F.lit(math.inf), F.lit(3.0)))
    assert e == [2.0, 180.0, 180.0, 180.0]


def test_relative_pose_moves_points(spark):
    rng = np.random.default_rng(5)
    quaternions = [x / np.linalg.norm(x) for x in rng.standard_normal((2, 4))]
    t = rng.standard_normal((2, 3))
    q, s = g.relative_pose(literal(quaternions[0]), literal(t[0]), literal(quaternions[1]), literal(t[1]))
    r12 = np.array(one(spark, *[x for row in g.rotation(q) for x in row])).reshape(3, 3)
    r1, r2 = (np.array(one(spark, *[x for row in g.rotation(literal(p)) for x in row])).reshape(3, 3) for p in quaternions)
    x = rng.standard_normal(3)
    assert np.allclose(r12 @ (r1 @ x + t[0]) + np.array(one(spark, *s)), r2 @ x + t[1])


def test_sampson_and_depth(spark):
    identity = [literal(row) for row in np.eye(3)]
    x = np.array([0.2, -0.1, 4.0])
    y = x + [1, 0, 0]
    point = literal([x[0] / 4, x[1] / 4, y[0] / 4, y[1] / 4])
    assert one(spark, g.sampson(*point, identity, literal([1, 0, 0])), g.in_front(*point, identity, literal([1, 0, 0])), g.in_front(*point, identity, literal([-1, 0, 0]))) == [0.0, True, False]
    off = one(spark, g.sampson(*literal([0, 0, 0, 0.1]), identity, literal([1, 0, 0])), g.sampson(*literal([0, 0, 0, 0]), identity, literal([0, 0, 0])))
    assert math.isclose(off[0], 0.01 / 2) and off[1] == math.inf


def test_image_sizes(spark):
    h, w, s = g.resize(F.lit(480), F.lit(641), 320)
    same = g.resize(F.lit(480), F.lit(640), 0)
    assert one(spark, h, w) == [int(480 * 320 / 641), 320] and one(spark, same[0], same[2]) == [480, 1.0]
    assert one(spark, g.pad(F.lit(28), 14), g.pad(F.lit(29), 14)) == [28, 42]
    assert one(spark, *g.scaled_intrinsics(F.lit(100.0), F.lit(641), F.lit(0.5))) == [50.0, 160]
    assert one(spark, g.angle_bin(F.lit(15.0), (0, 15, 30)), g.angle_bin(F.lit(30.0), (0, 15, 30)), g.sub_bin(F.lit(24.9), F.lit(15.0)), g.inverse_depth(F.lit(0))) == [1, None, 1, None]
    assert one(spark, g.adaptive_iterations(literal([1] * 5), 0.99, 10, 1000), g.adaptive_iterations(literal([0] * 5), 0.99, 10, 1000)) == [10, 1000]


def test_vectors(spark):
    basis = vector.cosine_basis(6, 3)
    assert np.allclose(np.array(basis) @ np.array(basis).T, np.eye(3))
    v = np.random.default_rng(2).standard_normal(6)
    left = v - np.array(basis).T @ (np.array(basis) @ v)
    got = one(spark, vector.project_out(F.array(*literal(v)), basis), vector.normalize(F.array(*literal([0, 0]))), vector.project_out(F.array(*literal(v)), basis, rank=0))
    assert np.allclose(got[0], left / np.linalg.norm(left)) and got[1] == [0.0, 0.0] and np.allclose(got[2], v / np.linalg.norm(v))


def test_text(spark):
    import hashlib

    h = int.from_bytes(hashlib.sha256(b"7:a:3").digest()[:8], "big")
    assert one(spark, text.stable_hash(7, F.lit("a"), F.lit(3)).cast("string"), text.trailing_number(F.lit("d/matching_012.csv")), text.trailing_number(F.lit("none.csv")), text.first_segment(F.lit("obj/x/y")), text.numbered("matching_", F.lit(7)), text.plain_number(F.lit(-0.0)).cast("string"), text.plain_number(F.lit(math.nan))) == [str(h), 12, None, "obj", "matching_007", "0.0", None]


# ---------------------------------------------------------------- metrics
def brute_auc(errors, t):
    x = [0.0, *sorted(errors)]
    y = list(np.linspace(0, 1, len(x)))
    n = int(np.searchsorted(x, t))
    return 100 * np.trapezoid(y[:n] + [y[n - 1]], x[:n] + [t]) / t


def test_auc(spark):
    rng = np.random.default_rng(3)
    sets = [[1.0], [], [5.0], [180.0] * 4, [0.0, 0.0], *(list(rng.uniform(0, 30, n)) for n in (2, 7, 40))]
    rows = [(i, float(e)) for i, errors in enumerate(sets) for e in errors]
    got = {(r.s, r.threshold): r.auc for r in metrics.auc_table(spark.createDataFrame(rows, "s int, err double"), ["s"]).collect()}
    assert got[0, 5.0] == 90.0
    for (s, t), value in got.items():
        assert math.isclose(value, brute_auc(sets[s], t), abs_tol=1e-9)


def test_alignment(spark):
    r = spark.createDataFrame([(12, 2.0, 3.0), (10, 1.0, 4.0)], "pair_idx long, rotation_error_deg double, translation_error_deg double")
    ids = spark.createDataFrame([(10,), (11,), (12,)], "pair_idx long")
    assert [x.err for x in metrics.align(ids, r).orderBy("pair_idx").collect()] == [4.0, 180.0, 3.0]
    placed = spark.createDataFrame([(1, 1.0, 2.0), (2, math.nan, 3.0), (5, 0.0, 0.0)], "ordinal long, rotation_error_deg double, translation_error_deg double")
    assert [x.err for x in metrics.align_by_position(placed, 4).orderBy("ordinal").collect()] == [2.0, 180.0, 180.0, 180.0]


def test_single_seed_deviation(spark):
    t = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "k string, v double")
    got = {r.k: r.std for r in metrics.seed_summary(t, ["k"], "v").collect()}
    assert got == {"a": 0.0, "b": math.sqrt(2)}
    assert {r.k: r.std for r in metrics.seed_summary(t, ["k"], "v", single=None).collect()}["a"] is None


def test_hierarchy_weighs_categories_alike(spark):
    rows = [("b", "easy", 0, d, 1.0) for d in (0, 1)] + [("b", "hard", p, d, 0.0) for p in (1, 2, 3) for d in (0, 1)] + [("n", "x", 0, 0, math.nan)]
    got = {r.bin: r["mean"] for r in metrics.hierarchical_mean(spark.createDataFrame(rows, "bin string, category string, pair int, direction int, v double"), ["bin", "category", "pair", "direction"], "v").collect()}
    assert got == {"b": 0.5, "n": None}


def test_recall(spark):
    errors, entry, least = [[0, 0.03, 0.06, 0.1], [0.03, 0.015, 0.06, 0.1]], [[1, 2, 3, 4], [2, 4, 3, 4]], [0.0, 0.015]
    c = spark.createDataFrame([(0, i, j + 1, entry[i][j], float(errors[i][j])) for i in range(2) for j in range(4)], "pair_idx int, left_idx int, rank_lr int, entry_k int, error double")
    s = spark.createDataFrame([(0, i, least[i]) for i in range(2)], "pair_idx int, left_idx int, min_error double")
    got = {r.k: (r.direct_cdf, r.mutual_cdf) for r in metrics.recall_at_k(c, s, [0.02], [1, 2, 4]).collect()}
    assert got == {1: (0.5, 0.5), 2: (1.0, 0.5), 4: (1.0, 1.0)}
    strict = metrics.recall_at_k(c.withColumn("error", F.lit(0.02)), s.withColumn("min_error", F.lit(0.02)), [0.02], [1]).first()
    assert strict.n_gt == 0 and strict.direct_cdf is None


def test_threshold_mean(spark):
    rows = [("a", 5.0, 1.0), ("a", 10.0, 3.0), ("b", 5.0, 1.0), ("c", 5.0, 1.0), ("c", 10.0, math.nan), ("d", 5.0, 1.0), ("d", 10.0, 1.0), ("d", 20.0, 1.0)]
    got = {r.k: r["mean"] for r in metrics.threshold_mean(spark.createDataFrame(rows, "k string, threshold double, v double"), ["k"], [5.0, 10.0], "v").collect()}
    assert got == {"a": 2.0, "b": None, "c": None, "d": None}


def test_runtime(spark):
    rows = [("a", float(x)) for x in (1, 2, 3, 4)] + [("a", math.inf), ("a", None)]
    r = metrics.runtime(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").first()
    assert (r["mean"], r["median"], round(r.p95, 9), r.covered, r.rows) == (2.5, 2.5, 3.85, 4, 6)


def test_policies_of_a_second_run(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "pair_idx long")
    do = lambda policy, stored=(1, 2), broken=(2,): {r.pair_idx for r in checks.to_do(ids(1, 2, 3), ids(*stored), ["pair_idx"], policy, ids(*broken)).collect()}
    assert (do("skip"), do("overwrite"), do("repair"), do("error", (9,))) == ({3}, {1, 2, 3}, {2, 3}, {1, 2, 3}) and do("validate", (1, 2, 3), (9,)) == set()
    for policy, stored, broken in (("error", (1,), (9,)), ("validate", (1, 2), (9,)), ("validate", (1, 2, 3), (2,))):
        with pytest.raises(checks.CheckFailed):
            do(policy, stored, broken)
    with pytest.raises(ValueError):
        do("again")


def test_plot_inputs_and_denominators(spark):
    rows = [(d, k, 0.5, 5) for d in "ab" for k in (1, 2)]
    count = lambda x: {r.problem: r["count"] for r in checks.plot_inputs(spark.createDataFrame(x, "d string, k int, v double, seeds long"), ["d", "k"], ["v"]).collect()}
    assert set(count(rows).values()) == {0}
    assert count([*rows[:3], rows[0], ("c", 1, float("nan"), 4)]) == {"duplicate": 1, "missing cell": 2, "not finite": 1, "seeds": 1}
    poses = spark.createDataFrame([("x", i) for i in range(2500)] + [("y", 1), ("y", 1), ("z", 3)], "dataset string, pair_idx long")
    first = checks.denominators(poses, spark.createDataFrame([], "dataset string, pairs long, sha256 string"))
    digest = {r.dataset: r.digest for r in first.collect()}
    bound = spark.createDataFrame([("x", 2500, digest["x"]), ("y", 2, digest["y"]), ("z", 1, "0")], "dataset string, pairs long, sha256 string")
    assert {r.dataset: (r.pairs, r.problem) for r in checks.denominators(poses, bound).collect()} == {"x": (2500, None), "y": (2, "an id twice"), "z": (1, "other ids")}


def test_all_skip_reasons(spark):
    """One pair for each reason, as rows of association files."""
    fine = [(i, i, 0.5, 1, None) for i in range(6)]
    files = {1: fine, 2: fine, 3: [(*fine[0][:4], "bad row"), *fine[1:]], 4: [(None, None, 0.5, 1, None)] * 6, 5: [(-1, 0, 0.5, 1, None), *fine], 6: [(i, i, None, 1, None) for i in range(6)], 7: [*fine, (None, 3, 0.5, 1, None)], 8: [*fine, (9, 9, 0.5, None, None)], 9: [*fine[:4], *((20 + i, 20 + i, 0.1, 1, None) for i in range(3))], 10: [(i, 0, 0.5, 1, None) for i in range(9)], 11: fine}
    edges = spark.createDataFrame([(p, *r) for p, rows in files.items() for r in rows], "pair_idx long, left_idx long, right_idx long, similarity double, k int, bad string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "pair_idx long")
    got = {r.pair_idx: r.reason for r in checks.skip_reasons(ids(*range(12)), edges, 5, poses=ids(*(i for i in range(12) if i != 2)), threshold=0.3, proposal_k=2, failed=ids(11)).collect()}
    assert got == {0: "missing_match_file", 1: None, 2: "missing_pose_intrinsics", 3: "invalid_match_csv: bad row", 4: "missing_m2m_metadata", 5: "invalid_feature_ids", 6: "similarity_threshold_requires_similarity", 7: "column_size_mismatch", 8: "proposal_rank_size_mismatch", 9: "not_enough_matches", 10: "proposal_graph_not_enough_o2o", 11: "ransac_failed"}


def test_percentiles_of_many_shapes(spark):
    rng = np.random.default_rng(2)
    groups = {"same": [3.0] * 50, "one": [7.0], "ties": rng.integers(0, 4, 500).astype(float).tolist(), "wide": rng.standard_normal(3000).tolist(), "two": [1.0, 2.0]}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("none", None), ("same", None)]
    got = {(r.k, r.share): r.value for r in metrics.percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", (0.0, 0.5, 0.9, 0.95, 1.0), buckets=16).collect()}
    assert set(got) == {(k, p) for k in groups for p in (0.0, 0.5, 0.9, 0.95, 1.0)}
    assert all(np.isclose(v, np.percentile(groups[k], 100 * p)) for (k, p), v in got.items())


def test_neighbours_in_cells(spark):
    """Cut into many cells, lists, nearest points and summaries are those of whole sides."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((60, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    left = spark.createDataFrame([(p, i, x.tolist()) for p in (0, 1) for i, x in enumerate(v[: 30 + p])], "pair_idx int, idx long, v array<double>")
    right = spark.createDataFrame([(p, i, x.tolist()) for p in (0, 2) for i, x in enumerate(v[30:])], "pair_idx int, idx long, v array<double>")
    rows = lambda d: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.fillna(-1).collect())
    assert rows(knn.ranked_candidates(left, right, 4, most=7)) == rows(knn.ranked_candidates(left, right, 4)) and knn.ranked_candidates(left, right, 4, most=7).count() > 120
    assert rows(knn.similarity_summary(left, right, most=7)) == rows(knn.similarity_join(left, right).groupBy("pair_idx", "left_idx").agg(F.count("*").alias("n"), F.max("similarity").alias("best"), F.avg("similarity").alias("mean")))
    at = lambda d: d.select("pair_idx", "idx", *(F.get("v", F.lit(i)).alias(c) for i, c in enumerate("xyz")))
    near = rows(knn.nearest_error(at(left), at(right), most=7))
    assert near == rows(knn.nearest_error(at(left), at(right))) and sum(math.isinf(e) for _, _, e in near) == 31


def test_content_hash_follows_the_order(spark):
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    t = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b"), (11, "z")], "o int, l string").withColumn("k", F.lit(0))
    whole = metrics.content_hash(t, ["k"], F.floor(F.col("o") / 10), F.col("o"), F.col("l")).first().digest
    assert whole == sha(sha("a\nb\nc") + "\n" + sha("z"))
    assert whole != metrics.content_hash(t.withColumn("o", -F.col("o")), ["k"], F.floor(F.col("o") / 10), F.col("o"), F.col("l")).first().digest


# ---------------------------------------------------------------- curves
def points(spark, rows):
    return spark.createDataFrame(rows, "bin string, layer int, x double, y double")


def test_frontier(spark):
    got = {r.layer: round(r.regret, 6) for r in frontier.frontier(points(spark, [("a", 16, 1.0, 0.8), ("a", 9, 1.0, 0.5), ("a", 3, 0.5, 0.4)]), ["bin"], "x", "y").collect()}
    assert got == {16: 0.0, 9: 30.0, 3: 0.0}
    layers = frontier.select_layer(points(spark, [("a", 16, 1.0, 0.8), ("a", 9, 2.0, 0.7), ("b", 16, 1.0, 0.8), ("b", 9, 2.0, 0.7)]), ["bin"], "layer", "x", "y").collect()
    assert [(r.layer, round(r.mean_regret, 6)) for r in layers] == [(16, 0.0), (9, 10.0)]
    tie = frontier.select_layer(points(spark, [("a", n, 1.0, 0.7) for n in (9, 3, 16)]), ["bin"], "layer", "x", "y").first()
    assert tie.layer == 3


def test_step_lookup(spark):
    p = spark.createDataFrame([("a", 1.0, 10), ("a", 3.0, 30)], "bin string, x double, y int")
    q = spark.createDataFrame([("a", x) for x in (0.5, 1.0, 2.9, 3.0, 9.0)] + [("b", 1.0)], "bin string, x double")
    got = sorted((r.bin, r.x, r.y) for r in frontier.step_lookup(p, q, ["bin"], "x", "y").collect())
    assert got == [("a", 0.5, None), ("a", 1.0, 10), ("a", 2.9, 10), ("a", 3.0, 30), ("a", 9.0, 30), ("b", 1.0, None)]


def test_resample(spark):
    p = points(spark, [("a", 0, 0.0, 0.0), ("a", 0, 10.0, 10.0), ("b", 0, 2.0, 1.0), ("b", 0, 4.0, 3.0), ("b", 0, 8.0, 3.0)])
    got = sorted((r.bin, r.i, r.x, r.y) for r in frontier.resample(p, ["bin"], "x", "y", steps=4).collect())
    want = [(b, i, x, float(np.interp(x, *c))) for b, c in (("a", ([0, 10], [0, 10])), ("b", ([2, 4, 8], [1, 3, 3]))) for i, x in enumerate([2.0, 4.0, 6.0, 8.0])]
    assert got == want


def test_monotone(spark):
    assert frontier.not_monotone(points(spark, [("a", 1, 1.0, 0.5), ("a", 2, 2.0, 0.4), ("a", 3, 3.0, 0.6)]), ["bin"], "x", "y").count() == 1


# ---------------------------------------------------------------- scores
def test_scores(spark):
    edges = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 0.2, 0.0), (0, 0, 1, 0.0, 0.0, 0.2, 0.1), (0, 1, 1, 0.1, 0.1, 0.3, 0.1), (0, 2, 2, 0.0, 0.2, 0.4, 0.2)], "pair_idx int, left_idx int, right_idx int, x1 double, y1 double, x2 double, y2 double")
    edges = scoring.with_prior(edges)
    hyp = spark.createDataFrame([(0, h, 1.0, 0.0, 0.0, 0.0, *t) for h, t in enumerate([(1.0, 0.0, 0.0), (0.0, 1.0, 0.0)])], "pair_idx int, hid int, qw double, qx double, qy double, qz double, tx double, ty double, tz double")
    scored = scoring.residuals(edges, hyp, 0.01)
    inliers = sorted((r.left_idx, r.right_idx) for r in scored.filter("inlier AND hid = 0").collect())
    assert inliers == [(0, 0), (1, 1), (2, 2)]
    rows = {(r.left_idx, r.right_idx): r for r in edges.collect()}
    want = 0.0
    for side in (0, 1):
        for n in (0, 1, 2):
            mine = [e for e in inliers if e[side] == n]
            want -= math.log1p(rows[mine[0]][("left_c", "right_c")[side]] * sum(rows[e].p for e in mine))
    hcm = {r.hid: r.hcm for r in scoring.hcm(scored, edges).collect()}
    assert math.isclose(hcm[0], want) and hcm[1] == 0
    assert {r.hid: r.cardinality for r in scoring.mcm(scored).collect()} == {0: 3, 1: 0}
    assert {r.hid: round(r.msac, 9) for r in scoring.msac(scored, 0.01).collect()} == {0: 0.25, 1: 1.0}
    pool = scoring.pool(scoring.hcm(scored, edges), 1)
    ref = spark.createDataFrame([(0, hcm[0]), (0, hcm[0] - 1), (1, 0.0)], "pair_idx int, hcm double")
    assert sorted((r.pair_idx, r.hcm < hcm[0], r.admitted) for r in scoring.would_enter(ref, pool, 1).collect()) == [(0, False, False), (0, True, True), (1, False, True)]
    assert scoring.rerank(scoring.pool(scoring.hcm(scored, edges), 2), scoring.mcm(scored)).first().hid == 0


def test_ransac_recovers_a_pose(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(-1, 1, (40, 3)) + [0, 0, 4]
    angle = 0.1
    r = np.array([[math.cos(angle), 0, math.sin(angle)], [0, 1, 0], [-math.sin(angle), 0, math.cos(angle)]])
    y = x @ r.T + [0.5, 0.1, 0.0]
    rows = [(1, i, i, *(x[i, :2] / x[i, 2]), *(y[i, :2] / y[i, 2])) for i in range(40)] + [(1, i, 40 + i, *rng.uniform(-0.3, 0.3, 4)) for i in range(15)] + [(2, 0, j, 0.0, 0.0, 0.1, 0.1) for j in range(9)] + [(3, 0, 0, 0.0, 0.0, 0.0, 0.0)] + [(4, -1, j, 0.0, 0.0, 0.0, 0.0) for j in range(9)]
    e = spark.createDataFrame([(p, a, b, *map(float, c)) for p, a, b, *c in rows], "pair_idx long, left_idx long, right_idx long, x1 double, y1 double, x2 double, y2 double")
    got = {r.pair_idx: r for r in ransac.estimate(scoring.with_prior(e), most_iterations=150, threshold=0.002).collect()}
    best = got[1]
    q, t = np.array([best.qw, best.qx, best.qy, best.qz]), np.array([best.tx, best.ty, best.tz])
    assert best.status == "success" and best.cardinality >= 38
    assert abs(q @ [math.cos(angle / 2), 0, math.sin(angle / 2), 0]) > 0.9999 and abs(t @ [0.5, 0.1, 0]) / np.linalg.norm([0.5, 0.1, 0]) > 0.995
    assert {p: got[p].message for p in (2, 3, 4)} == {2: "proposal_graph_not_enough_o2o", 3: "not_enough_matches", 4: "invalid_feature_ids"}
    again = ransac.estimate(scoring.with_prior(e.repartition(5)), most_iterations=150, threshold=0.002).filter("pair_idx = 1").first()
    assert again.qw == best.qw


def turned_pair(pair: int, n: int = 40, wrong: int = 20, seed: int = 6):
    """True edges of a known pose, then wrong ones with k = 2."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (n, 3)) + [0, 0, 4]
    r = np.array([[math.cos(0.1), 0, math.sin(0.1)], [0, 1, 0], [-math.sin(0.1), 0, math.cos(0.1)]])
    y = x @ r.T + [0.5, 0.1, 0.0]
    true = [(pair, i, i, *(x[i, :2] / x[i, 2]), *(y[i, :2] / y[i, 2]), 1) for i in range(n)]
    return [(p, a, b, *map(float, c), k) for p, a, b, *c, k in true + [(pair, i % n, n + i, *rng.uniform(-0.3, 0.3, 4), 2) for i in range(wrong)]]


EDGE = "pair_idx long, left_idx long, right_idx long, x1 double, y1 double, x2 double, y2 double, k int"


@pytest.mark.parametrize("mode", ransac.MODES)
def test_modes_of_the_search(spark, mode):
    e = scoring.with_prior(spark.createDataFrame(turned_pair(1), EDGE))
    best = ransac.estimate(e, mode=mode, most_iterations=200, threshold=0.002).first()
    assert best.status == "success" and best.cardinality >= 38 and best.refinements > 0
    assert abs(np.dot([best.qw, best.qx, best.qy, best.qz], [math.cos(0.05), 0, math.sin(0.05), 0])) > 0.9999
    assert best.iterations <= 200 and best.total_ms >= best.solve_ms > 0 and best.score_ms > 0 and best.refine_ms > 0
    assert (best.pool_size > 0) == (mode == "hcm_mc") == bool(best.trace)


def test_iterations_follow_the_inliers(spark):
    """A pair of inliers alone ends at the least number, one with few of them at the most."""
    rows = turned_pair(1, 40, 0) + turned_pair(2, 12, 60)
    e = scoring.with_prior(spark.createDataFrame(rows, EDGE))
    got = {r.pair_idx: r.iterations for r in ransac.estimate(e, least_iterations=10, most_iterations=120, threshold=0.002).collect()}
    assert got[1] <= 12 and got[2] == 120
    o = ransac.Options(least_iterations=10, most_iterations=1000)
    assert ransac.dynamic_iterations(40, 40, o) == 10 and ransac.dynamic_iterations(4, 40, o) == 1000
    p = math.prod((30 - i) / (40 - i) for i in range(5))
    assert ransac.dynamic_iterations(30, 40, o) == math.ceil(math.log(1 - o.success) / math.log(1 - p))


def test_samples_come_from_the_proposal_graph(spark):
    """Restricted to k = 1 only true edges are drawn, and all edges are scored."""
    rows = turned_pair(1, 20, 60)
    e = scoring.with_prior(spark.createDataFrame(rows, EDGE))
    free, bound = (ransac.estimate(e, least_iterations=30, most_iterations=30, threshold=0.002, proposal_k=k).first() for k in (0, 1))
    assert bound.cardinality >= 19 and bound.n_edges == 80 and bound.hcm <= free.hcm
    few = scoring.with_prior(spark.createDataFrame([(*r[:-1], 1 if i < 4 else 2) for i, r in enumerate(rows)], EDGE))
    assert ransac.estimate(few, least_iterations=9, most_iterations=9, proposal_k=1).first().message == "proposal_graph_not_enough_o2o"
    with pytest.raises(ValueError):
        ransac.Options(proposal_k=1)
    with pytest.raises(ValueError):
        ransac.Options(mode="best")


def test_pool_of_poses():
    unit = lambda angle: (np.array([math.cos(angle / 2), 0, math.sin(angle / 2), 0]), np.array([1.0, 0, 0]))
    assert ransac.similar(unit(0), (-unit(0)[0], -unit(0)[1]), 0.5) and not ransac.similar(unit(0), unit(0.05), 1.0)
    assert not ransac.similar(unit(0), (unit(0)[0], np.array([0, 1.0, 0])), 1.0) and ransac.similar(unit(0), (unit(0)[0], np.zeros(3)), 1.0)
    plain, apart = ransac.Pool(2), ransac.Pool(2, dedup_deg=2.0)
    for pool in (plain, apart):
        for angle, hcm in ((0.0, -5.0), (0.001, -7.0), (0.5, -6.0), (1.0, -6.0), (1.5, -4.0)):
            pool.offer(ransac.Seed(unit(angle), hcm, 10))
    assert sorted(s.hcm for s in plain.entries) == [-7.0, -6.0] and plain.duplicates == 1 and plain.cutoff() == -6.0 and plain.basins() == 2
    assert sorted(s.hcm for s in apart.entries) == [-7.0, -6.0] and apart.duplicates == 1 and apart.attempts == 3
    assert ransac.Pool(3).cutoff() == math.inf


def test_runs_and_sidecars(spark, tmp_path):
    e = scoring.with_prior(spark.createDataFrame(turned_pair(1) + turned_pair(2, seed=9), EDGE))
    once, thrice = (ransac.estimate(e, least_iterations=5, most_iterations=5, threshold=0.002, runs=n, capacity=2) for n in (1, 3))
    by = lambda d: {r.pair_idx: r.model_score for r in d.collect()}
    assert all(by(thrice)[p] <= s for p, s in by(once).items()) and {r.run for r in thrice.collect()} <= {0, 1, 2}
    ransac.write_results(thrice, str(tmp_path), ("mode", "hcm_mc"), ("seed", 0))
    trace = spark.read.parquet(f"{tmp_path}/traces")
    assert {(r.mode, r.seed) for r in trace.collect()} == {("hcm_mc", 0)} and spark.read.parquet(f"{tmp_path}/results").count() == 2
    rows = sorted(trace.filter("pair_idx = 1").collect(), key=lambda r: r.rank)
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1)) and [r.hcm for r in rows] == sorted(r.hcm for r in rows) and len(rows[0].polished_pose) == 7
    asked = spark.createDataFrame([(1, -1e9), (2, 1e9), (3, 0.0)], "pair_idx long, hcm double")
    assert {r.pair_idx: r.admitted for r in ransac.probes(thrice, asked).collect()} == {1: True, 2: False, 3: True}


# ---------------------------------------------------------------- checks and sampling
def test_checks(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a")], "x int, y string")
    assert [tuple(r) for r in checks.duplicates(t, ["x", "y"]).collect()] == [(2, "a", 2)]
    assert [tuple(r) for r in checks.rectangle(t, ["x", "y"]).collect()] == [(2, "b")]
    with pytest.raises(checks.CheckFailed, match="rectangle"):
        checks.require_none(checks.rectangle(t, ["x", "y"]), "rectangle")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "x int")
    assert sorted(tuple(r) for r in checks.unexpected(ids(1, 2), ids(2, 3), ["x"]).collect()) == [(1, "unexpected"), (3, "missing")]
    a = spark.createDataFrame([(1, 0.5), (2, 0.1)], "v int, seconds double")
    assert checks.replay_differences(a, a.withColumn("seconds", F.lit(9.0)), ["seconds"]).count() == 0 and checks.replay_differences(a, a.limit(1), []).count() == 1
    assert checks.frozen(a, {"v": 1}).count() == 1 and checks.uniform(t, ["x"], ["y"]).count() == 1
    r = spark.createDataFrame([("success", 1.0, math.nan, 0.0), ("odd", -1.0, 0.0, 0.0), (None, None, None, None), ("failed", 1.0, None, None)], "status string, running_time_s double, rotation_error_deg double, translation_error_deg double")
    assert tuple(checks.violation_counts(r, checks.result_rules()).first()) == (2, 1, 2)
    bad = checks.isolate(spark.createDataFrame([(1, None), (1, False), (2, False)], "pair_idx int, bad boolean"), F.col("bad"))
    assert sorted((x.pair_idx, x.status) for x in bad.collect()) == [(1, "skipped"), (1, "skipped"), (2, "success")]
    pairs = spark.createDataFrame([(p,) for p in range(5)], "pair_idx int")
    e = spark.createDataFrame([(1, 0, j) for j in range(6)] + [(2, j, j) for j in range(3)] + [(3, -1, j) for j in range(6)] + [(4, j, j) for j in range(6)], "pair_idx int, left_idx int, right_idx int")
    assert {x.pair_idx: x.reason for x in checks.skip_reasons(pairs, e).collect()} == {0: "missing_match_file", 1: "proposal_graph_not_enough_o2o", 2: "not_enough_matches", 3: "invalid_feature_ids", 4: None}


def test_sampling(spark):
    objects = spark.createDataFrame([(f"o{i}",) for i in range(7)], "object string")
    q = sampling.quotas(objects, ["a", "b", "c"], 500).collect()
    assert all(sum(r.quota for r in q if r.bin == b) == 500 for b in "abc") and {r.quota for r in q} == {71, 72}
    sizes = spark.createDataFrame([(f"o{i}", i) for i in range(1, 8)], "object string, size long")
    h = sampling.half_sizes(sizes).collect()
    assert sum(r.half for r in h) == 14 and all(r.half - r.size // 2 in (0, 1) for r in h)
    flips = sampling.balanced_flip(spark.createDataFrame([(i % 2, i) for i in range(11)], "s int, i int"), ["s"], "x", ["i"], bonus=1)
    assert {r.s: r.n for r in flips.filter("flip").groupBy("s").agg(F.count("*").alias("n")).collect()} == {0: 3, 1: 3}
    b = spark.createDataFrame([("o", "b", i, n, n, n + 1) for i, n in enumerate([10, 20, 70])], "object string, bin string, sub_bin long, raw long, left long, right long")
    assert [r.allocated for r in sampling.sub_quotas(b, 10).orderBy("sub_bin").collect()] == [1, 2, 7]
    shuffled = [r.i for r in sampling.ring_shuffle(spark.createDataFrame([(i,) for i in range(20)], "i int"), "s", ["i"]).orderBy("ordinal").collect()]
    assert sorted(shuffled) == list(range(20)) and shuffled != list(range(20))


def unit_by_unit(raw, capacity, target):
    """Sub-bin quotas by dealing one unit after the other."""
    given = [0] * len(raw)
    for _ in range(target):
        free = [i for i in range(len(raw)) if given[i] < capacity[i]]
        given[min(free, key=lambda i: (given[i] * sum(raw) - target * raw[i], i))] += 1
    return given


def test_sub_quotas_against_dealing_one_by_one(spark):
    rng = random.Random(3)
    cases, rows = {}, []
    for o in range(40):
        n = rng.randint(1, 8)
        raw, left, right = ([rng.randint(0, 30) for _ in range(n)] for _ in range(3))
        raw = [max(x) for x in zip(raw, left, right)]
        capacity = [min(x) for x in zip(left, right)]
        cases[f"o{o}"] = raw, capacity, rng.randint(0, sum(capacity))
        rows += [(f"o{o}", "b", i, *x, cases[f"o{o}"][2]) for i, x in enumerate(zip(raw, left, right))]
    df = spark.createDataFrame(rows, "object string, bin string, sub_bin long, raw long, left long, right long, target long")
    got = {}
    for r in sampling.sub_quotas(df, F.col("target")).orderBy("sub_bin").collect():
        got.setdefault(r.object, []).append(r.allocated)
    assert got == {o: unit_by_unit(*c) for o, c in cases.items()}
    with pytest.raises(Exception, match="edges for a quota of 99"):
        sampling.sub_quotas(df.filter("object = 'o1'"), 99).collect()
    assert all(r.allocated == r.capacity for r in sampling.sub_quotas(df.filter("object = 'o1'"), 99, strict=False).collect())


def brute_partition_score(side, edges, quota, about, slack=4):
    """The score of one partition, from its definition; ``side``: images of the first side."""
    from collections import Counter

    others = set(about) - side
    deficit = support = shortfall = imbalance = deviation = 0
    for b, q in quota.items():
        mine = [e for e in edges if e[0] == b]
        first, second = ([e for e in mine if e[2] in s and e[3] in s] for s in (side, others))
        h, k = Counter(e[1] for e in first), Counter(e[1] for e in second)
        support += max(0, q - sum((h & k).values()))
        for n in (len(first), len(second)):
            deficit += max(0, q + slack - n)
            shortfall += max(0, q + slack + 1 - n)
        imbalance += abs(len(first) - len(second)) * 1_000_000 // max(len(mine), 1)
        deviation += sum(abs(4 * len(x) - len(mine)) for x in (first, second)) * 1_000_000 // max(len(mine), 1)
    strata = []
    for pick in (lambda a: a[0], lambda a: a[1:3], lambda a: a[3]):
        h, k = (Counter(pick(about[i]) for i in s) for s in (side, others))
        strata.append(sum(abs(h[v] - k[v]) for v in h | k))
    return deficit + support, support, shortfall, *strata, imbalance, deviation


def test_partition_search(spark):
    rng = random.Random(8)
    about = {i: (rng.choice("ab"), rng.choice([1, 2]), rng.choice([3, 4]), rng.choice("xyz")) for i in range(12)}
    edges = sorted({(rng.choice("pq"), rng.randint(0, 2), *sorted(rng.sample(range(12), 2))) for _ in range(50)})
    quota = {"p": 2, "q": 3}
    e = spark.createDataFrame([("o", *x) for x in edges], "object string, bin string, sub_bin int, low long, high long")
    images = spark.createDataFrame([("o", i, *a) for i, a in about.items()], "object string, image long, split string, height int, width int, camera string")
    found = sampling.partition_search(e, spark.createDataFrame([("o", 6)], "object string, half long"), spark.createDataFrame([("o", b, q) for b, q in quota.items()], "object string, bin string, quota long"), images, trials=300, strict=False).collect()
    side = {r.image for r in found if r.side}
    assert len(found) == 12 and len(side) == 6
    best = tuple(found[0][c] for c in sampling.SCORE)
    assert best == brute_partition_score(side, edges, quota, about)
    assert best <= min(brute_partition_score(set(rng.sample(range(12), 6)), edges, quota, about) for _ in range(60))
    with pytest.raises(Exception, match="best partition has the score"):
        sampling.partition_search(e, spark.createDataFrame([("o", 6)], "object string, half long"), spark.createDataFrame([("o", "p", 99), ("o", "q", 1)], "object string, bin string, quota long"), images, trials=3).collect()


def test_low_degree_edges(spark):
    rows = [("o", f"b{b}", s, i, j) for b in range(2) for s in range(2) for i in range(6) for j in range(6 + s, 12, 2)]
    e = spark.createDataFrame(rows, "object string, bin string, sub_bin int, low long, high long")
    wanted = spark.createDataFrame([("o", f"b{b}", s, 3 - s) for b in range(2) for s in range(2)], "object string, bin string, sub_bin int, target long")
    every = sampling.low_degree_edges(e, wanted, trials=20, every=True).collect()
    for number in {r.candidate for r in every}:
        chosen = [r for r in every if r.candidate == number]
        assert {(b, s): sum(r.bin == f"b{b}" and r.sub_bin == s for r in chosen) for b in range(2) for s in range(2)} == {(b, s): 3 - s for b in range(2) for s in range(2)}
        degree = [sum(x in (r.low, r.high) for r in chosen) for x in range(12)]
        own = [sum(x in (r.low, r.high) and r.bin == f"b{b}" for r in chosen) for x in range(12) for b in range(2)]
        assert (max(own), max(degree), sum(d * d for d in own), sum(d * d for d in degree), degree.count(0)) == tuple(chosen[0][c] for c in sampling._DEGREES)
        assert max(own) <= 4 and max(degree) <= 6 and len({(r.bin, r.sub_bin, r.low, r.high) for r in chosen}) == 10
    best = sampling.low_degree_edges(e, wanted, trials=20).collect()
    assert tuple(best[0][c] for c in sampling._DEGREES) == min(tuple(r[c] for c in sampling._DEGREES) for r in every)
    for bad, message in (({"most": 0}, "no selection within"), ({}, "the quota is")):
        more = wanted if bad else wanted.withColumn("target", F.lit(99).cast("long"))
        with pytest.raises(Exception, match=message):
            sampling.low_degree_edges(e, more, trials=2, **bad).collect()


def test_split_of_a_sound_selection(spark):
    """All promises hold for a small sound split, and each break is found."""
    bins = {"a": (0.0, 10.0)}
    source = spark.createDataFrame([("o", 1, 2, "1"), ("o", 3, 4, "2"), ("o", 11, 12, "1"), ("o", 13, 14, "3")], "object string, image_1 long, image_2 long, distance string")
    rows = [("f", "a", "o", 1, 2, "1"), ("f", "a", "o", 4, 3, "2"), ("g", "a", "o", 11, 12, "1"), ("g", "a", "o", 14, 13, "3")]
    schema = "family string, bin string, object string, image_1 long, image_2 long, distance string"
    sides = spark.createDataFrame([(i, "f" if i < 10 else "g") for i in (1, 2, 3, 4, 11, 12, 13, 14)], "image long, family string")
    quotas, images = spark.createDataFrame([("o", "a", 2)], "object string, bin string, quota long"), sides.selectExpr("image", "'c' AS camera")
    check = lambda r, s=sides: {x.check for x in splits.split_problems(spark.createDataFrame(r, schema), source, s, quotas, images, bins, 2).collect() if x.violations}
    assert check(rows) == set()
    assert check(rows[:3]) == {"pairs of a bin", "quotas", "roles out of balance", "distance histograms differ"}
    assert check([*rows[:3], ("g", "a", "o", 13, 14, "3")]) == {"roles out of balance"}
    assert check([*rows[:3], ("g", "a", "o", 14, 13, "8")]) == {"edges outside the source", "distance histograms differ"}
    assert check([*rows[:3], ("g", "a", "o", 14, 1, "3")]) >= {"edges outside the source", "ends in another family"}
    assert check(rows, sides.unionByName(spark.createDataFrame([(1, "g")], "image long, family string"))) >= {"images in several families"}


def test_partition_queries_take_every_edge(spark, tmp_path):
    """Parts of every id enter."""
    rows = [(p, s) for p in range(1, 41) for s in (p, p + 7)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, "one") for p in range(1, 41)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    want = {(p % 40, s % 40 + 40) for p, s in rows}
    scored = reports.partition_search(spark, str(tmp_path)).collect()
    assert {r.image for r in scored} == {i for e in want for i in e} and sum(r.side for r in scored) == len(scored) // 2
    chosen = reports.low_degree_edges(spark, str(tmp_path)).collect()
    assert {(r.low, r.high) for r in chosen} <= want and len(chosen) == 2
