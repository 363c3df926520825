"""Dense correspondence on hand-made pairs."""

import math

import numpy as np
from pyspark.sql import functions as F

from matchweave.operators import dense
from matchweave.plans import dense as plan

PAIRS = [(1, "b", "o", "a1", "b1", 10.0), (2, "b", "o", "a2", "b2", 20.0), (3, "b", "p", "a3", "b3", 30.0)]


def frames(spark):
    pairs = spark.createDataFrame(PAIRS, "pair_idx long, bin string, object string, image_a string, image_b string, angle double")
    rng = np.random.default_rng(1)
    patches, cameras, vectors = [], [], []
    for image in (i for p in PAIRS for i in p[3:5]):
        q = rng.standard_normal(4)
        cameras.append((image, *map(float, q), *map(float, rng.standard_normal(3))))
        for n in range(6):
            patches.append((image, n, n % 3 != 2, n != 4, *map(float, rng.standard_normal(3))))
            vectors.append((image, 5, n, rng.standard_normal(8).tolist()))
    return pairs, spark.createDataFrame(patches, "image string, patch_idx long, is_object boolean, has_depth boolean, x double, y double, z double"), spark.createDataFrame(cameras, "image string, qw double, qx double, qy double, qz double, tx double, ty double, tz double"), spark.createDataFrame(vectors, "image string, layer int, patch_idx long, v array<double>")


def turn(q):
    w, x, y, z = np.array(q) / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def test_errors_between_cameras(spark):
    """Points go from the source's camera to the world and on to the destination's."""
    pairs, patches, cameras, vectors = frames(spark)
    pose = {r.image: (turn([r.qw, r.qx, r.qy, r.qz]), np.array([r.tx, r.ty, r.tz])) for r in cameras.collect()}
    at = {(r.image, r.patch_idx): (np.array([r.x, r.y, r.z]), r.is_object, r.has_depth) for r in patches.collect()}
    ends = {(p, d): (a, b) if d == "a_to_b" else (b, a) for p, _, _, a, b, _ in PAIRS for d in dense.DIRECTIONS}
    candidates, minimum, counts = dense.evaluate(pairs, vectors, patches, cameras, 2)

    def error(pair, direction, source, target):
        a, b = ends[pair, direction]
        world = pose[a][0].T @ (at[a, source][0] - pose[a][1])
        return float(np.linalg.norm(pose[b][0] @ world + pose[b][1] - at[b, target][0]))

    rows = candidates.collect()
    for r in rows:
        _, is_object, has_depth = at[ends[r.pair_idx, r.direction][1], r.target]
        want = error(r.pair_idx, r.direction, r.source, r.target) if has_depth else math.inf
        assert (r.is_object, r.has_depth) == (is_object, has_depth) and (math.isclose(r.error, want, rel_tol=1e-9) or r.error == want)
    assert len(rows) == 3 * 2 * 3 * 2  # pairs, directions, object patches with depth, K
    for r in minimum.collect():
        target = ends[r.pair_idx, r.direction][1]
        assert math.isclose(r.min_error, min(error(r.pair_idx, r.direction, r.source, n) for n in range(6) if at[target, n][1] and at[target, n][2]), rel_tol=1e-9)
    strict = dense.candidate_errors(candidates.select("pair_idx", "direction", "source", "target"), dense.sources(pairs, patches, cameras), patches, strict=True).collect()
    assert all((r.error == math.inf) == (not (r.is_object and r.has_depth)) for r in strict)
    assert counts.count() == 3 * 2 and all(r.matches >= 0 for r in counts.collect())


def test_conditional_metrics_need_both_directions(spark):
    pairs = frames(spark)[0]
    row = lambda p, d, n, v: (p, 1, 0, d, 0.1, 1, 4, n, v, v, 0.5, 0.25)
    rows = [row(1, "a_to_b", 2, 0.5), row(1, "b_to_a", 4, 1.0), row(2, "a_to_b", 2, 0.5), row(2, "b_to_a", 0, None), row(3, "a_to_b", 1, 0.25), row(3, "b_to_a", 1, 0.75)]
    directions = spark.createDataFrame(rows, "pair_idx long, layer int, rank int, direction string, threshold double, k int, n_source long, n_gt long, directional_cdf double, mutual_cdf double, directional_recall_all double, mutual_recall_all double")
    by_pair = dense.pair_cdf(directions, pairs)
    assert {r.pair_idx: (r.eligible, r.mutual_cdf, r.mutual_recall_all) for r in by_pair.collect()} == {1: (True, 0.75, 0.25), 2: (False, None, 0.25), 3: (True, 0.5, 0.25)}
    objects = dense.category_cdf(by_pair)
    assert {r.object: (r.pair_count, r.eligible_pairs, r.mutual_cdf) for r in objects.collect()} == {"o": (2, 1, 0.75), "p": (1, 1, 0.5)}
    summary = dense.summary_cdf(objects)
    assert [(r.category_count, r.eligible_categories, r.mutual_cdf) for r in summary.collect()] == [(2, 2, 0.625)]
    assert dense.threshold_mean(summary, [0.1]).first().mutual_cdf == 0.625 and dense.threshold_mean(summary, [0.1, 0.2]).first().mutual_cdf is None


def test_sweep_curves(spark):
    rows = [("b", 1, 0, k, 0.1 * k, 10.0 * k, True) for k in (1, 2, 3)] + [("b", 2, 0, k, 0.5 - 0.1 * k, 10.0, True) for k in (1, 2, 3)] + [("b", 3, 0, 1, 0.1, 1.0, True), ("b", 3, 0, 3, 0.3, 1.0, True)]
    points = spark.createDataFrame(rows, "bin string, layer int, rank int, k int, mutual_cdf double, mean_matches double, complete boolean")
    assert {(r.layer, r.gaps, r.lower) for r in dense.sweep_problems(points, 3).collect()} == {(2, False, True), (3, True, False)}
    gain = {r.layer: r.gain_pp for r in dense.curve_gain(points, 1, 3).collect()}
    assert math.isclose(gain[1], 20.0) and math.isclose(gain[2], -20.0) and math.isclose(gain[3], 20.0)
    twice = points.unionByName(points.filter("layer = 1 AND k = 3"))
    assert dense.curve_gain(twice, 1, 3).filter(F.col("layer") == 1).first().gain_pp is None


def test_reports_rank_once_and_start_no_other_python(spark, monkeypatch):
    """Similarities are computed in one step and distances in another, both stored; what follows has no Python in it, not even for its small tables."""
    written, store = [], plan.staged
    shown = lambda df: df._jdf.queryExecution().toString()
    monkeypatch.setattr(plan, "staged", lambda df, name: (written.append(shown(df)), store(df, name))[1])
    _, directions, counts = plan._directions(spark, "/root/testdata/sf0.001")
    kernels = [text.split("== Physical Plan ==")[1].count("FlatMapCoGroupsInArrow") for text in written]
    after = [shown(df).split("== Physical Plan ==")[1] for df in (directions, counts)]
    assert sum(kernels) == 2 and not any("FlatMapCoGroupsInArrow" in text or "ExistingRDD" in text for text in after)
    assert directions.count() == 720 and counts.count() == 120
