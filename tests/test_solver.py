"""The five-point solver, refinement and lenses against known scenes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchweave.functions import geometry as g
from matchweave.operators import ransac, relpose, scoring


def scene(rng, n: int, noise: float = 0.0):
    """(rotation, unit translation, points of both images) of n points in front of two cameras."""
    r = relpose._exponential(rng.normal(size=3) * 0.3)
    t = rng.normal(size=3)
    t /= np.linalg.norm(t)
    x = rng.normal(size=(n, 3)) + [0, 0, 6]
    y = x @ r.T + t
    return r, t, x[:, :2] / x[:, 2:] + noise * rng.normal(size=(n, 2)), y[:, :2] / y[:, 2:] + noise * rng.normal(size=(n, 2))


def test_five_points_give_all_essential_matrices():
    rng = np.random.default_rng(1)
    scenes = [scene(rng, 5) for _ in range(300)]
    a, b = (np.stack([s[i] for s in scenes]) for i in (2, 3))
    e, sample = relpose.five_point(a, b)
    true = np.stack([relpose.skew(t) @ r for r, t, *_ in scenes])
    true /= np.linalg.norm(true, axis=(1, 2), keepdims=True)
    near = np.full(300, np.inf)
    np.minimum.at(near, sample, np.minimum(np.abs(e - true[sample]).max((1, 2)), np.abs(e + true[sample]).max((1, 2))))
    assert near.max() < 1e-8
    # every solution is an essential matrix that the five points satisfy, and a sample has an even number of them, ten at most
    x, y = relpose.homogeneous(a[sample]), relpose.homogeneous(b[sample])
    assert np.abs(np.einsum("mpi,mij,mpj->mp", y, e, x)).max() < 1e-8
    assert np.abs(np.linalg.det(e)).max() < 1e-8 and np.abs(2 * e @ e.transpose(0, 2, 1) @ e - np.trace(e @ e.transpose(0, 2, 1), axis1=1, axis2=2)[:, None, None] * e).max() < 1e-8
    count = np.bincount(sample, minlength=300)
    assert count.max() <= 10 and (count % 2 == 0).mean() > 0.98 and count.mean() > 3


def test_poses_of_samples_hold_the_true_one():
    rng = np.random.default_rng(2)
    scenes = [scene(rng, 5) for _ in range(100)]
    r, t, sample = relpose.sample_poses(*(np.stack([s[i] for s in scenes]) for i in (2, 3)))
    off = np.full(100, np.inf)
    np.minimum.at(off, sample, [np.abs(r[i] - scenes[k][0]).max() + np.abs(t[i] - scenes[k][1]).max() for i, k in enumerate(sample)])
    assert off.max() < 1e-7


def test_degenerate_samples_have_no_solution_that_is_wrong():
    same = np.zeros((1, 5, 2))
    e, _ = relpose.five_point(same, same)
    assert np.isfinite(e).all()


@pytest.mark.parametrize("seed", range(5))
def test_refinement_never_raises_the_cost(seed):
    rng = np.random.default_rng(seed)
    r, t, a, b = scene(rng, 80, 1e-3)
    a[:20] = rng.uniform(-0.5, 0.5, (20, 2))
    x, y, weight = relpose.homogeneous(a), relpose.homogeneous(b), rng.uniform(0.5, 2, 80)
    start = relpose._exponential(rng.normal(size=3) * 0.003) @ r, t + 0.01 * rng.normal(size=3)
    start = start[0], start[1] / np.linalg.norm(start[1])
    costs = [relpose.truncated_cost(*start, x, y, weight, 0.02)]
    for steps in (1, 2, 5, 25):
        found = relpose.refine(*start, x, y, weight, 0.02, steps)
        costs.append(relpose.truncated_cost(*found, x, y, weight, 0.02))
    assert all(b <= a for a, b in zip(costs, costs[1:], strict=False)) and costs[-1] <= 1.01 * relpose.truncated_cost(r, t, x, y, weight, 0.02)
    assert abs(np.linalg.norm(found[1]) - 1) < 1e-9 and np.abs(found[0] @ found[0].T - np.eye(3)).max() < 1e-9


def test_refinement_beats_a_linear_refit():
    """Over noisy scenes its rotation is nearer to the truth than that of a least-squares fit of the same points."""
    better = 0
    for seed in range(20):
        rng = np.random.default_rng(100 + seed)
        r, t, a, b = scene(rng, 40, 2e-3)
        x, y = relpose.homogeneous(a), relpose.homogeneous(b)
        rows = np.einsum("ni,nj->nij", y, x).reshape(-1, 9)
        rs, ts = relpose.poses(np.linalg.svd(rows)[2][-1].reshape(1, 3, 3))
        k = max(range(4), key=lambda i: relpose.in_front(rs[0, i], ts[0, i], x, y).sum())
        linear = rs[0, k], ts[0, k]
        found = relpose.refine(*linear, x, y, np.ones(40), 0.05)
        off = lambda p: np.abs(p[0] - r).max() + np.abs(p[1] - t).max()  # noqa: E731, B023
        better += off(found) < off(linear)
    assert better >= 16


def test_samples_take_distinct_ends():
    """Every whole sample has five different lefts and five different rights, all lefts are drawn, and the next free edge is taken."""
    import pandas as pd

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"left_idx": rng.integers(0, 12, 40), "right_idx": rng.integers(0, 9, 40)}).drop_duplicates()
    for c in ("x1", "y1", "x2", "y2", "p", "left_c", "right_c"):
        pdf[c] = 0.1
    pair = ransac.Pair(pdf, ransac.Options())
    edges, whole = pair.draw(np.random.default_rng(0), 500)
    assert whole.all()
    assert all(len(set(pair.left[e])) == len(set(pair.right[e])) == 5 for e in edges)
    assert len(set(pair.left[edges.ravel()])) == len(set(pair.left)) and len(set(edges.ravel().tolist())) > 30
    star = pd.DataFrame({"left_idx": range(8), "right_idx": [0] * 8, **{c: 0.1 for c in ("x1", "y1", "x2", "y2", "p", "left_c", "right_c")}})
    assert not ransac.Pair(star, ransac.Options()).draw(np.random.default_rng(0), 10)[1].any()


def test_planted_poses_are_found(spark):
    """Pairs with half of their edges wrong, in pixels of distorted cameras: all poses come back."""
    rng = np.random.default_rng(4)
    lens = [0.05, -0.02, 0.001, -0.002]
    rows, truth = [], {}
    for pair in range(6):
        r, t, a, b = scene(rng, 60)
        truth[pair] = r, t
        rows += [(pair, i, i, *map(float, (*a[i], *b[i]))) for i in range(60)]
        rows += [(pair, i, 60 + i, *map(float, (*a[i], *rng.uniform(-0.5, 0.5, 2)))) for i in range(60)]
    e = spark.createDataFrame(rows, "pair_idx long, left_idx long, right_idx long, x1 double, y1 double, x2 double, y2 double")
    camera = lambda: (F.lit(500.0), F.lit(520.0), F.lit(320.0), F.lit(240.0), F.array(*map(F.lit, lens)))
    for s in "12":
        e = e.withColumn("p", g.project(F.col(f"x{s}"), F.col(f"y{s}"), *camera())).withColumns({f"x{s}": F.col("p.x"), f"y{s}": F.col("p.y")}).drop("p")
    one = {f"{c}{s}": F.lit(v) for s in "12" for c, v in (("fx", 500.0), ("fy", 520.0), ("cx", 320.0), ("cy", 240.0))}
    cameras = spark.range(6).select(F.col("id").alias("pair_idx"), *(v.alias(k) for k, v in one.items()), *(F.array(*map(F.lit, lens)).alias(f"distortion{s}") for s in "12"))
    found = ransac.estimate(scoring.with_prior(e), cameras=cameras.filter("pair_idx < 5"), threshold=1.0, least_iterations=200, most_iterations=2000).collect()
    assert {r.pair_idx: r.status for r in found} == {p: "success" if p < 5 else "skipped" for p in range(6)} and next(r for r in found if r.pair_idx == 5).message == "no_camera"
    for row in found[:]:
        if row.status == "success":
            r, t = truth[row.pair_idx]
            turn = ransac._matrix(np.array([row.qw, row.qx, row.qy, row.qz]))
            assert math.degrees(math.acos(min(1, (np.trace(turn @ r.T) - 1) / 2))) < 0.3 and np.array([row.tx, row.ty, row.tz]) @ t > 0.999 and row.cardinality >= 58


@pytest.mark.parametrize("lens", [[], [0.2, -0.05, 0.002, -0.003], [0.1, -0.03, 0.001, 0.002, 0.01, 0.05, -0.01, 0.002]])
def test_lenses_round_trip(spark, lens):
    points = spark.range(400).select(((F.col("id") % 20 - 10) / 12.0).alias("x"), (F.floor(F.col("id") / 20) / 12.0 - 0.8).alias("y"), F.array(*map(F.lit, lens)).cast("array<double>").alias("k"))
    camera = lambda: (F.lit(700.0), F.lit(710.0), F.lit(400.0), F.lit(300.0), F.col("k"))
    seen = points.withColumn("s", g.project(F.col("x"), F.col("y"), *camera()))
    back = seen.withColumn("b", g.unproject(F.col("s.x"), F.col("s.y"), *camera()))
    assert back.select(F.max(F.greatest(F.abs(F.col("b.x") - F.col("x")), F.abs(F.col("b.y") - F.col("y"))))).first()[0] < 1e-9
    row = seen.filter("x > 0.5 AND y > 0.5").first()
    k = lens + [0.0] * (8 - len(lens))
    r2 = row.x**2 + row.y**2
    radial = (1 + k[0] * r2 + k[1] * r2**2 + k[4] * r2**3) / (1 + k[5] * r2 + k[6] * r2**2 + k[7] * r2**3)
    assert row.s.x == pytest.approx(700 * (row.x * radial + 2 * k[2] * row.x * row.y + k[3] * (r2 + 2 * row.x**2)) + 400, abs=1e-9)
    odd = points.limit(1).select(g.unproject(F.lit(1.0), F.lit(1.0), *camera()[:4], F.array(F.lit(0.1))).alias("b")).first()
    assert odd.b is None
