"""Descriptors at keypoints, and scans in two levels, on hand-made values and against plain programs."""

import random

import numpy as np
import pytest

from matchweave.operators import frontier, gather, sampling, scan

PATCHES = "image string, gx int, gy int, v array<float>"


def sampled(spark, points, maps, patches, frame="native"):
    p = spark.createDataFrame([("a", i, float(x), float(y)) for i, (x, y) in enumerate(points)], "image string, kp_idx long, x double, y double")
    m = spark.createDataFrame([("a", *maps)], "image string, patch_size int, grid_h int, grid_w int" + ", source_h int, source_w int, resized_h int, resized_w int" * (frame == "resized"))
    return {r.kp_idx: (r.x, r.y, np.array(r.v)) for r in gather.descriptors_at(p, m, spark.createDataFrame(patches, PATCHES), frame).collect()}


def test_patch_centres_and_borders(spark):
    patches = [("a", 0, 0, [1.0, 0.0]), ("a", 1, 0, [0.0, 2.0]), ("a", 0, 1, [1.0, 1.0]), ("a", 1, 1, [2.0, 2.0])]
    got = sampled(spark, [(8, 8), (24, 8), (0, 0), (16, 8), (24, 24), (24.5, 8)], (16, 2, 2), patches)
    assert set(got) == {0, 1, 3, 4}
    np.testing.assert_allclose(got[0][2], [1, 0], atol=1e-12)
    np.testing.assert_allclose(got[1][2], [0, 1], atol=1e-12)
    np.testing.assert_allclose(got[3][2], np.array([0.5, 1.0]) / np.hypot(0.5, 1.0), atol=1e-12)
    np.testing.assert_allclose(got[4][2], np.array([1, 1]) / np.sqrt(2), atol=1e-12)
    assert got[1][:2] == (24.0, 8.0)


def test_resized_frame_keeps_the_source_coordinates(spark):
    patches = [("a", x, y, [3.0, 0.0] if (x, y) == (0, 0) else [0.0, 4.0] if (x, y) == (2, 1) else [0.0, 0.0]) for x in range(3) for y in range(2)]
    got = sampled(spark, [(3.5, 3.5), (19.5, 11.5)], (16, 2, 3, 16, 24, 32, 48), patches, "resized")
    np.testing.assert_allclose([got[0][2], got[1][2]], [[1, 0], [0, 1]], atol=1e-12)
    assert got[0][:2] == (3.5, 3.5) and got[1][:2] == (19.5, 11.5)
    with pytest.raises(Exception, match="differs from the grid"):
        sampled(spark, [(1.0, 1.0)], (16, 2, 3, 16, 24, 31, 48), patches, "resized")


def test_gather_is_that_of_arrays(spark):
    rng = np.random.default_rng(5)
    grid = rng.normal(size=(5, 7, 6)).astype(np.float32)
    points = rng.uniform(0, 60, (200, 2))
    got = sampled(spark, points, (8, 5, 7), [("a", x, y, grid[y, x].tolist()) for y in range(5) for x in range(7)])
    u, v = points[:, 0] / 8 - 0.5, points[:, 1] / 8 - 0.5
    inside = (u >= 0) & (u <= 6) & (v >= 0) & (v <= 4)
    assert set(got) == set(np.flatnonzero(inside).tolist()) and 50 < inside.sum() < 200
    for i in got:
        x, y = int(u[i]), int(v[i])
        a, b = u[i] - x, v[i] - y
        at = lambda j, k: grid[min(k, 4), min(j, 6)].astype(float)
        want = (1 - a) * (1 - b) * at(x, y) + a * (1 - b) * at(x + 1, y) + (1 - a) * b * at(x, y + 1) + a * b * at(x + 1, y + 1)
        np.testing.assert_allclose(got[i][2], want / np.linalg.norm(want), atol=1e-9)


def test_missing_patches_and_sizes_are_errors(spark):
    with pytest.raises(Exception, match="no patch at"):
        sampled(spark, [(12.0, 8.0)], (16, 1, 2), [("a", 0, 0, [1.0])])
    with pytest.raises(Exception, match="must be positive"):
        sampled(spark, [(12.0, 8.0)], (0, 1, 2), [("a", 0, 0, [1.0])])
    with pytest.raises(ValueError, match="frame"):
        sampled(spark, [], (1, 1, 1), [], "scaled")


@pytest.fixture(scope="module")
def curve(spark):
    rng = random.Random(7)
    return [(rng.choice(["a", "b", None]), i, float(rng.randint(0, 60)), rng.random() if rng.random() < 0.9 else None) for i in range(600)]


def test_scans_are_those_of_lists(spark, curve):
    df = spark.createDataFrame(curve, "key string, id long, x double, y double")
    got = {r.id: r.best for r in scan.running_max(df, ["key"], "x", "y", parts=9).collect()}
    want = {i: max((y2 for k2, _, x2, y2 in curve if k2 == k and x2 <= x and y2 is not None), default=None) for k, i, x, _ in curve}
    assert got == want
    got = {r.id: r.last for r in scan.last_known(df, ["key"], ["x", "id"], "y", "last", parts=9).collect()}
    for k, i, x, _ in curve:
        before = [(x2, i2, y2) for k2, i2, x2, y2 in curve if k2 == k and (x2, i2) <= (x, i) and y2 is not None]
        assert got[i] == (max(before)[2] if before else None)
    got = {r.id: (r.next_id, r.next_x) for r in scan.following(df.selectExpr("key", "id", "x"), ["key"], "id", ["id", "x"], parts=9).collect()}
    for k, i, _, _ in curve:
        behind = [(i2, x2) for k2, i2, x2, _ in curve if k2 == k and i2 > i]
        assert got[i] == (min(behind) if behind else (None, None))


def test_scans_never_order_a_whole_key(spark, curve):
    """Each window over rows is also over the number of their range; the others are over one row for each range."""
    df = spark.createDataFrame(curve, "key string, id long, x double, y double")
    plan = frontier.frontier(df, ["key"], "x", "y")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_range" in line for line in windows)


def test_half_of_a_stratum_by_counts(spark):
    """As a plain sort of each stratum selects, nulls and ties of hashes included."""
    rng = random.Random(2)
    rows = [(rng.choice([0, 1, None]), i) for i in range(401)]
    df = spark.createDataFrame(rows, "stratum int, token long")
    for bonus in (0, 1):
        got = {r.token: r.flip for r in sampling.balanced_flip(df, ["stratum"], "s", ["token"], bonus).collect()}
        import hashlib

        for s in (0, 1, None):
            mine = sorted((int.from_bytes(hashlib.sha256(f"s:{t}".encode()).digest()[:8], "big"), t) for k, t in rows if k == s)
            half = len(mine) // 2 + bonus * (len(mine) % 2)
            assert [t for _, t in mine if got[t]] == [t for _, t in mine[:half]]
