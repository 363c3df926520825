"""Dense correspondence: ranked candidates of patches, their errors in space, and the report tables over them.

Relations, all in long form:

* ``pairs``: pair_idx, bin, object, image_a, image_b, angle
* ``patches``: image, patch_idx, is_object, has_depth, x, y, z (the point in camera coordinates)
* ``cameras``: image, qw, qx, qy, qz, tx, ty, tz (world to camera)
* ``descriptors``: image, layer, patch_idx, v (array<double>)
* ``candidates``: pair_idx, layer, rank, direction, source, target, cosine, cand_rank, entry_k and, once judged, is_object, has_depth, error

Background targets keep the finite error of their point, so that it can be audited; only object targets with depth can be correct.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchweave.functions import geometry as g
from matchweave.functions.geometry import finite
from matchweave.functions.text import first_segment
from matchweave.functions.vector import normalize, residual_prefixes
from matchweave.operators import knn
from matchweave.operators.metrics import finite_mean, percentile_columns

DIRECTIONS = ("a_to_b", "b_to_a")
CONFIG = ("layer", "rank")
#: Metrics of a direction, and those whose denominator is the sources that have a true destination.
METRICS = ("directional_cdf", "mutual_cdf", "directional_recall_all", "mutual_recall_all")
CONDITIONAL = ("directional_cdf", "mutual_cdf")


# ---------------------------------------------------------------- pairs
def check_pairs(pairs: DataFrame, meta: DataFrame, sizes: DataFrame, low: float, high: float) -> DataFrame:
    """Each pair with the columns of its metadata, its object, and ``problem``: why it cannot be evaluated, null if it can.

    pairs: pair_idx, image_1, image_2.  meta: the same and angle, image_1_height, image_1_width, image_2_height,
    image_2_width.  sizes: image, height, width as annotated.  An angle must be in ``[low, high)``.
    """
    about = meta.select("pair_idx", *(F.col(c).alias(f"meta_{c}") for c in ("image_1", "image_2")), "angle", *(f"image_{s}_{c}" for s in "12" for c in ("height", "width")))
    joined = pairs.join(about, "pair_idx", "left")
    for s in "12":
        joined = joined.join(sizes.select(F.col("image").alias(f"image_{s}"), F.col("height").alias(f"_h{s}"), F.col("width").alias(f"_w{s}")), f"image_{s}", "left")
    objects = [first_segment(F.col(f"image_{s}")) for s in "12"]
    wrong_size = reduce(lambda a, b: a | b, (~(F.col(f"image_{s}_height").eqNullSafe(F.col(f"_h{s}")) & F.col(f"image_{s}_width").eqNullSafe(F.col(f"_w{s}"))) for s in "12"))
    copies = pairs.groupBy("pair_idx").agg(F.count("*").alias("_copies"))
    problem = (
        F.when(F.col("_copies") > 1, "duplicate pair")
        .when(F.col("meta_image_1").isNull(), "missing metadata")
        .when((F.col("meta_image_1") != F.col("image_1")) | (F.col("meta_image_2") != F.col("image_2")), "paths disagree")
        .when(~F.coalesce(finite(F.col("angle")) & (F.col("angle") >= low) & (F.col("angle") < high), F.lit(False)), "angle outside the bin")
        .when((objects[0] == "") | (objects[0] != objects[1]), "crosses objects")
        .when(wrong_size, "sizes disagree")
    )
    out = joined.join(copies, "pair_idx").withColumns({"object": objects[0], "problem": problem})
    return out.select("pair_idx", "image_1", "image_2", "object", "angle", "problem")


# ---------------------------------------------------------------- errors in space
def moves(pairs: DataFrame, cameras: DataFrame) -> DataFrame:
    """For both directions of each pair: source and destination image, and the rigid motion from the source's camera to the destination's."""
    ends = F.explode(F.array(*(F.struct(F.lit(d).alias("direction"), F.col(a).alias("source_image"), F.col(b).alias("target_image")) for d, a, b in zip(DIRECTIONS, ("image_a", "image_b"), ("image_b", "image_a"), strict=True)))).alias("e")
    out = pairs.select("pair_idx", ends).select("pair_idx", "e.*")
    names = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")
    for side in ("source", "target"):
        out = out.join(cameras.select(F.col("image").alias(f"{side}_image"), *(F.col(c).alias(f"{side}_{c}") for c in names)), f"{side}_image")
    pose = [[F.col(f"{side}_{c}") for c in names] for side in ("source", "target")]
    q, t = g.relative_pose(g.unit_quaternion(pose[0][:4]), pose[0][4:], g.unit_quaternion(pose[1][:4]), pose[1][4:])
    out = out.withColumns(dict(zip(("mw", "mi", "mj", "mk", "m0", "m1", "m2"), [*q, *t], strict=True)))
    return out.select("pair_idx", "direction", "source_image", "target_image", "mw", "mi", "mj", "mk", "m0", "m1", "m2")


def moved(rows: DataFrame) -> list[Column]:
    """x, y, z of the rows' point after their motion."""
    turned = g.apply(g.rotation([F.col(c) for c in ("mw", "mi", "mj", "mk")]), [F.col(c) for c in "xyz"])
    return [a + F.col(f"m{i}") for i, a in enumerate(turned)]


def sources(pairs: DataFrame, patches: DataFrame, cameras: DataFrame) -> DataFrame:
    """The queries: object patches with depth of each direction's source image, with their point in the destination's camera (px, py, pz)."""
    asked = patches.filter("is_object AND has_depth").select(F.col("image").alias("source_image"), F.col("patch_idx").alias("source"), "x", "y", "z")
    rows = moves(pairs, cameras).join(asked, "source_image")
    return rows.select("pair_idx", "direction", "target_image", "source", *(c.alias(n) for c, n in zip(moved(rows), ("px", "py", "pz"), strict=True)))


def candidate_errors(candidates: DataFrame, queries: DataFrame, patches: DataFrame, strict: bool = False) -> DataFrame:
    """Candidates of the queries (``sources``) with is_object, has_depth and error of their target: infinite without depth, with ``strict`` also on the background."""
    target = patches.select(F.col("image").alias("target_image"), F.col("patch_idx").alias("target"), "is_object", (F.col("has_depth") & finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z"))).alias("has_depth"), "x", "y", "z")
    joined = candidates.join(queries, ["pair_idx", "direction", "source"]).join(target, ["target_image", "target"])
    off = [F.col(f"p{c}") - F.col(c) for c in "xyz"]
    valid = F.col("has_depth") & F.col("is_object") if strict else F.col("has_depth")
    error = F.when(valid, F.sqrt(g.dot3(off, off))).otherwise(F.lit(float("inf")))
    return joined.withColumn("error", error).drop("px", "py", "pz", "x", "y", "z", "target_image")


def minimum_errors(queries: DataFrame, patches: DataFrame) -> DataFrame:
    """(pair_idx, direction, source, min_error): the distance of each query's point to the nearest object patch with depth; infinite if there is none."""
    valid = patches.filter("is_object AND has_depth").select(F.col("image").alias("target_image"), "patch_idx", "x", "y", "z")
    asked = queries.select(F.concat_ws("|", F.col("pair_idx").cast("string"), "direction").alias("key"), F.col("source").alias("idx"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
    ends = queries.select("pair_idx", "direction", "target_image").distinct()
    there = ends.join(valid, "target_image").select(F.concat_ws("|", F.col("pair_idx").cast("string"), "direction").alias("key"), F.col("patch_idx").alias("idx"), "x", "y", "z")
    near = knn.nearest_error(asked, there, "key")
    return queries.select("pair_idx", "direction", "source", F.concat_ws("|", F.col("pair_idx").cast("string"), "direction").alias("key")).join(near.withColumnRenamed("idx", "source"), ["key", "source"]).select("pair_idx", "direction", "source", "min_error")


# ---------------------------------------------------------------- ranking
def ranked(pairs: DataFrame, descriptors: DataFrame, k: int, basis: Sequence[Sequence[float]] = (), ranks: Sequence[int] = (0,)) -> DataFrame:
    """Candidates of all patches of both images of each pair, for each layer and each rank of the removed subspace: (pair_idx, layer, rank,
    left, right, cosine, rank_lr, rank_rl); a rank in a list is null beyond ``k``."""
    flat = descriptors.select("image", "layer", "patch_idx", F.explode(residual_prefixes(F.col("v"), basis, ranks)).alias("r")).select("image", "layer", "patch_idx", "r.rank", normalize(F.col("r.v")).alias("v"))
    key = F.concat_ws("|", *(F.col(c).cast("string") for c in ("pair_idx", "layer", "rank"))).alias("key")
    side = lambda image: pairs.select("pair_idx", F.col(image).alias("image")).join(flat, "image").select(key, F.col("patch_idx").alias("idx"), "v")
    found = knn.ranked_candidates(side("image_a"), side("image_b"), k, "key")
    part = lambda i, kind: F.split_part("key", F.lit("|"), F.lit(i)).cast(kind)
    return found.select(part(1, "long").alias("pair_idx"), part(2, "int").alias("layer"), part(3, "int").alias("rank"), F.col("left_idx").alias("left"), F.col("right_idx").alias("right"), F.col("similarity").alias("cosine"), "rank_lr", "rank_rl")


def evaluate(
    pairs: DataFrame, descriptors: DataFrame, patches: DataFrame, cameras: DataFrame, k: int, basis: Sequence[Sequence[float]] = (), ranks: Sequence[int] = (0,), keep: Callable[[DataFrame], DataFrame] = lambda found: found
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates with errors, minimum errors of the queries, match_counts): everything that the reports need.

    Candidates and counts both read the ranked lists: ``keep`` may store these, so that all similarities are computed once.
    """
    found = keep(ranked(pairs, descriptors, k, basis, ranks))
    entry = F.when(F.col("rank_lr").isNotNull() & F.col("rank_rl").isNotNull(), F.greatest("rank_lr", "rank_rl")).otherwise(k + 1).cast("int")
    turn = lambda d, a, b, r: F.struct(F.lit(d).alias("direction"), F.col(a).alias("source"), F.col(b).alias("target"), F.col(r).alias("cand_rank"))
    both = F.explode(F.array(turn("a_to_b", "left", "right", "rank_lr"), turn("b_to_a", "right", "left", "rank_rl"))).alias("e")
    listed = found.select("pair_idx", *CONFIG, "cosine", entry.alias("entry_k"), both).select("pair_idx", *CONFIG, "e.*", "cosine", "entry_k").filter("cand_rank IS NOT NULL")
    queries = sources(pairs, patches, cameras)
    counts = found.filter("rank_lr IS NOT NULL AND rank_rl IS NOT NULL").withColumn("k", F.greatest("rank_lr", "rank_rl"))
    configs = pairs.select("pair_idx", F.col("image_a").alias("image")).join(descriptors.select("image", "layer").distinct(), "image").select("pair_idx", "layer", F.explode(F.array(*map(F.lit, ranks))).alias("rank"))
    counted = configs.join(counts, ["pair_idx", *CONFIG], "left").groupBy("pair_idx", *CONFIG).agg(*(F.sum(F.coalesce((F.col("k") <= n).cast("long"), F.lit(0))).alias(str(n)) for n in range(1, k + 1)))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("k"), F.col(str(n)).alias("matches")) for n in range(1, k + 1)))).alias("r")
    return candidate_errors(listed, queries, patches), minimum_errors(queries, patches), counted.select("pair_idx", *CONFIG, rows).select("pair_idx", *CONFIG, "r.*")


# ---------------------------------------------------------------- report tables
def direction_cdf(candidates: DataFrame, minimum: DataFrame, configs: DataFrame, thresholds: Sequence[float], k: int) -> DataFrame:
    """Per pair, layer, rank, direction, threshold and K: n_source, n_gt, gt_coverage and the four METRICS (null without a denominator).

    ``configs``: the (layer, rank) that were evaluated, a small table.
    """
    level = F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold")
    at = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("k")
    count = lambda c: F.sum(c.cast("long"))
    asked = minimum.select("pair_idx", "direction", "min_error", level).groupBy("pair_idx", "direction", "threshold").agg(F.count("*").alias("n_source"), count(F.col("min_error") < F.col("threshold")).alias("n_gt"))
    correct = candidates.filter("is_object AND has_depth").select("pair_idx", *CONFIG, "direction", "source", "cand_rank", "entry_k", "error", level).filter("error < threshold")
    first = correct.groupBy("pair_idx", *CONFIG, "direction", "threshold", "source").agg(F.min("cand_rank").alias("direct"), F.min("entry_k").alias("mutual"))
    hits = first.groupBy("pair_idx", *CONFIG, "direction", "threshold").agg(*(count(F.col(c) <= n).alias(f"{c}_{n}") for c in ("direct", "mutual") for n in range(1, k + 1)))
    wide = asked.join(F.broadcast(configs.select(*CONFIG).distinct())).join(hits, ["pair_idx", *CONFIG, "direction", "threshold"], "left")
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("k"), *(F.coalesce(f"{c}_{n}", F.lit(0)).cast("double").alias(c) for c in ("direct", "mutual"))) for n in range(1, k + 1)))).alias("r")
    long = wide.select("pair_idx", *CONFIG, "direction", "threshold", "n_source", "n_gt", rows).select("*", "r.k", "r.direct", "r.mutual")
    share = lambda top, below: F.try_divide(F.col(top), F.col(below).cast("double"))
    metrics = [share(c, below).alias(name) for name, c, below in zip(METRICS, ("direct", "mutual") * 2, ("n_gt", "n_gt", "n_source", "n_source"), strict=True)]
    return long.select("pair_idx", *CONFIG, "direction", "threshold", "k", "n_source", "n_gt", F.try_divide(F.col("n_gt").cast("double"), F.col("n_source").cast("double")).alias("gt_coverage"), *metrics)


def pair_cdf(directions: DataFrame, pairs: DataFrame) -> DataFrame:
    """The mean of both directions.  Conditional metrics are null for a pair without a true destination in one of them; a pair that lacks a direction has ``directions`` below 2."""
    eligible = (F.count("*") == 2) & (F.min("n_gt") > 0)
    mean = {m: finite_mean(F.col(m)) for m in METRICS}
    out = directions.groupBy("pair_idx", *CONFIG, "threshold", "k").agg(
        F.count("*").alias("directions"), eligible.alias("eligible"), *((F.when(eligible, mean[m]) if m in CONDITIONAL else mean[m]).alias(m) for m in METRICS)
    )
    return pairs.select("pair_idx", "bin", "object").join(out, "pair_idx")


def category_cdf(rows: DataFrame) -> DataFrame:
    keys = ["bin", "object", *CONFIG, "threshold", "k"]
    return rows.groupBy(*keys).agg(F.count("*").alias("pair_count"), F.sum(F.col("eligible").cast("long")).alias("eligible_pairs"), *(finite_mean(F.col(m)).alias(m) for m in METRICS))


def summary_cdf(rows: DataFrame) -> DataFrame:
    """Objects count equally, whatever their number of pairs."""
    keys = ["bin", *CONFIG, "threshold", "k"]
    counts = [F.count("*").alias("category_count"), F.sum((F.col("eligible_pairs") > 0).cast("long")).alias("eligible_categories"), F.sum("pair_count").alias("pair_count"), F.sum("eligible_pairs").alias("eligible_pairs")]
    return rows.groupBy(*keys).agg(*counts, *(finite_mean(F.col(m)).alias(m) for m in METRICS))


def threshold_mean(summary: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Each metric's mean over exactly these thresholds; null if one of its values is missing, ``threshold_count`` tells how many rows there are."""
    have = (F.count("*") == len(thresholds)) & (F.array_sort(F.collect_set("threshold")) == F.array(*(F.lit(float(t)) for t in sorted(thresholds))))
    mean = lambda m: F.when(have & (F.count(F.when(finite(F.col(m)), 1)) == F.count("*")), F.avg(m))
    return summary.groupBy("bin", *CONFIG, "k").agg(F.count("*").alias("threshold_count"), *(mean(m).alias(m) for m in METRICS))


def match_count_reports(counts: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per object, per bin): mean matches of an object's pairs; over objects the mean of these, over pairs the median and the 90th percentile."""
    rows = counts.join(pairs.select("pair_idx", "bin", "object"), "pair_idx")
    category = rows.groupBy("bin", "object", *CONFIG, "k").agg(F.count("*").alias("pair_count"), F.avg("matches").alias("mean_matches"))
    keys = ["bin", *CONFIG, "k"]
    per = rows.groupBy(*keys).agg(F.count("*").alias("pair_count")).join(percentile_columns(rows, keys, "matches", {"pair_median": 0.5, "pair_p90": 0.9}), keys, "left")
    macro = category.groupBy("bin", *CONFIG, "k").agg(F.count("*").alias("category_count"), F.avg("mean_matches").alias("macro_mean"))
    return category, per.join(macro, ["bin", *CONFIG, "k"])


def sweep_points(summary: DataFrame, match_summary: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """The points of the sweep: mean matches against mutual recall averaged over thresholds, with their support, for each bin, layer, rank and K."""
    keys = ["bin", *CONFIG, "k"]
    averaged = summary.groupBy(*keys).agg(F.avg("mutual_cdf").alias("mutual_cdf"), F.countDistinct("threshold").alias("threshold_count"), F.min("category_count").alias("objects"), F.min("pair_count").alias("pairs"))
    joined = averaged.join(match_summary.select(*keys, F.col("macro_mean").alias("mean_matches")), keys)
    return joined.withColumn("complete", F.col("threshold_count") == len(thresholds))


def sweep_problems(points: DataFrame, k: int) -> DataFrame:
    """Curves (bin, layer, rank) that lack a K of 1 to ``k``, hold one twice, or fall with K in matches or recall."""
    from pyspark.sql import Window

    order = Window.partitionBy("bin", *CONFIG).orderBy("k")
    falls = lambda c, slack: F.coalesce(F.col(c) - F.lag(c).over(order) < -slack, F.lit(False))
    rows = points.withColumns({"fewer": falls("mean_matches", 0.0), "lower": falls("mutual_cdf", 1e-12)})
    curve = rows.groupBy("bin", *CONFIG).agg((F.array_sort(F.collect_list("k")) != F.sequence(F.lit(1), F.lit(k))).alias("gaps"), F.max("fewer").alias("fewer"), F.max("lower").alias("lower"), (~F.min("complete")).alias("incomplete"))
    return curve.filter("gaps OR fewer OR lower OR incomplete")


def curve_gain(points: DataFrame, first: int = 1, last: int = 5, value: str = "mutual_cdf") -> DataFrame:
    """Per curve the gain of ``value`` from one K to another in percentage points; null unless both have exactly one point."""
    at = lambda k: F.when(F.count(F.when(F.col("k") == k, 1)) == 1, F.max(F.when(F.col("k") == k, F.col(value))))
    return points.groupBy("bin", *CONFIG).agg((100.0 * (at(last) - at(first))).alias("gain_pp"))
