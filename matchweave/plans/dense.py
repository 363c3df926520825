"""Queries of the dense-correspondence study: two descriptor layers and two ranks over the vectors of each label."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchweave.functions.vector import cosine_basis
from matchweave.operators import dense
from matchweave.plans.registry import r6, registered
from matchweave.sources import adapters
from matchweave.sources.staging import staged

K, RANKS, THRESHOLDS = 3, (0, 2), (0.1, 0.2, 0.3)
BASIS = cosine_basis(64, max(RANKS))

# SQL building blocks
_ROT = "1-2*(qy*qy+qz*qz) AS r00, 2*(qx*qy-qw*qz) AS r01, 2*(qx*qz+qw*qy) AS r02, 2*(qx*qy+qw*qz) AS r10, 1-2*(qx*qx+qz*qz) AS r11, 2*(qy*qz-qw*qx) AS r12, 2*(qx*qz-qw*qy) AS r20, 2*(qy*qz+qw*qx) AS r21, 1-2*(qx*qx+qy*qy) AS r22"
_UNIT = ["[" + ", ".join(f"{x!r}::DOUBLE" for x in u) + "]" for u in BASIS]


def _without(v: str, unit: str) -> str:
    return f"list_transform({v}, lambda x, i: x - list_dot_product({v}, {unit}) * ({unit})[i])"


POINTS = f"""pt AS (SELECT label AS pair_idx, vec_id % 2 AS side, vec_id AS idx, [x::DOUBLE for x in embedding] AS v, embedding[1] > -0.05 AS is_object, embedding[2] > -0.1 AS has_depth,
  embedding[3]::DOUBLE AS x, embedding[4]::DOUBLE AS y, embedding[5]::DOUBLE AS z FROM embeddings WHERE label IS NOT NULL),
pr AS (SELECT DISTINCT pair_idx, 'bin' || (pair_idx % 2) AS bin, 'o' || (pair_idx % 3) AS object FROM pt),
cam AS (SELECT pair_idx, {_ROT} FROM (SELECT pair_idx, 1 / n AS qw, 0.1::DOUBLE * (pair_idx % 3) / n AS qx, 0.05::DOUBLE / n AS qy, 0.02::DOUBLE * (pair_idx % 2) / n AS qz
  FROM (SELECT pair_idx, sqrt(1 + power(0.1::DOUBLE * (pair_idx % 3), 2) + 0.0025::DOUBLE + power(0.02::DOUBLE * (pair_idx % 2), 2)) AS n FROM pr))),
query AS (SELECT pair_idx, CASE side WHEN 0 THEN 'a_to_b' ELSE 'b_to_a' END AS direction, side, idx AS source,
  CASE side WHEN 0 THEN r00 * x + r01 * y + r02 * z + 0.02::DOUBLE ELSE r00 * (x - 0.02::DOUBLE) + r10 * y + r20 * (z - 0.01::DOUBLE) END AS px,
  CASE side WHEN 0 THEN r10 * x + r11 * y + r12 * z ELSE r01 * (x - 0.02::DOUBLE) + r11 * y + r21 * (z - 0.01::DOUBLE) END AS py,
  CASE side WHEN 0 THEN r20 * x + r21 * y + r22 * z + 0.01::DOUBLE ELSE r02 * (x - 0.02::DOUBLE) + r12 * y + r22 * (z - 0.01::DOUBLE) END AS pz FROM pt JOIN cam USING (pair_idx) WHERE is_object AND has_depth),
least_error AS (SELECT q.pair_idx, q.direction, q.source, coalesce(sqrt(min(power(px - t.x, 2) + power(py - t.y, 2) + power(pz - t.z, 2))), 'inf'::DOUBLE) AS min_error
  FROM query q LEFT JOIN pt t ON t.pair_idx = q.pair_idx AND t.side <> q.side AND t.is_object AND t.has_depth GROUP BY ALL)"""
CANDIDATES = f"""{POINTS},
flat AS (SELECT pair_idx, side, idx, 1 AS layer, v FROM pt UNION ALL SELECT pair_idx, side, idx, 2, [x * abs(x) for x in v] FROM pt),
deep AS (SELECT pair_idx, side, idx, layer, 0 AS rank, v FROM flat UNION ALL SELECT pair_idx, side, idx, layer, 2, {_without("v", _UNIT[1])} FROM (SELECT * REPLACE ({_without("v", _UNIT[0])} AS v) FROM flat)),
unit AS (SELECT * REPLACE ([x / greatest(sqrt(list_dot_product(v, v)), 1e-12) for x in v] AS v) FROM deep),
sims AS (SELECT l.pair_idx, l.layer, l.rank, l.idx AS a, r.idx AS b, list_dot_product(l.v, r.v) AS cosine FROM unit l JOIN unit r ON l.pair_idx = r.pair_idx AND l.layer = r.layer AND l.rank = r.rank WHERE l.side = 0 AND r.side = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pair_idx, layer, rank, a ORDER BY cosine DESC, b) AS lr, row_number() OVER (PARTITION BY pair_idx, layer, rank, b ORDER BY cosine DESC, a) AS rl FROM sims),
entered AS (SELECT *, CASE WHEN lr <= {K} AND rl <= {K} THEN greatest(lr, rl) ELSE {K + 1} END AS entry_k FROM ranked WHERE lr <= {K} OR rl <= {K}),
listed AS (SELECT pair_idx, layer, rank, 'a_to_b' AS direction, a AS source, b AS target, lr AS cand_rank, entry_k FROM entered WHERE lr <= {K} UNION ALL SELECT pair_idx, layer, rank, 'b_to_a', b, a, rl, entry_k FROM entered WHERE rl <= {K}),
cand AS (SELECT l.*, t.is_object, t.has_depth, CASE WHEN t.has_depth THEN sqrt(power(px - t.x, 2) + power(py - t.y, 2) + power(pz - t.z, 2)) ELSE 'inf'::DOUBLE END AS error
  FROM listed l JOIN query q ON q.pair_idx = l.pair_idx AND q.direction = l.direction AND q.source = l.source JOIN pt t ON t.pair_idx = l.pair_idx AND t.idx = l.target),
cfg AS (SELECT layer, rank FROM (VALUES (1), (2)) a(layer), (VALUES (0), (2)) b(rank)), ks AS (SELECT unnest(range(1, {K + 1})) AS k), t(threshold) AS (VALUES {", ".join(f"({x}::DOUBLE)" for x in THRESHOLDS)})"""
MATCHES = f"""{CANDIDATES},
counts AS (SELECT p.pair_idx, p.bin, p.object, c.layer, c.rank, ks.k, count(e.a) AS matches FROM pr p CROSS JOIN cfg c CROSS JOIN ks LEFT JOIN entered e ON e.pair_idx = p.pair_idx AND e.layer = c.layer AND e.rank = c.rank AND e.entry_k <= ks.k GROUP BY ALL),
per_object AS (SELECT bin, object, layer, rank, k, count(*) AS pair_count, avg(matches) AS mean_matches FROM counts GROUP BY ALL),
match_summary AS (SELECT bin, layer, rank, k, pair_count, pair_median, pair_p90, category_count, macro_mean FROM
  (SELECT bin, layer, rank, k, count(*) AS pair_count, quantile_cont(matches::DOUBLE, 0.5) AS pair_median, quantile_cont(matches::DOUBLE, 0.9) AS pair_p90 FROM counts GROUP BY ALL)
  JOIN (SELECT bin, layer, rank, k, count(*) AS category_count, avg(mean_matches) AS macro_mean FROM per_object GROUP BY ALL) USING (bin, layer, rank, k))"""
DIRECTIONS = f"""{MATCHES},
first AS (SELECT pair_idx, layer, rank, direction, source, threshold, min(cand_rank) AS direct, min(entry_k) AS mutual FROM cand, t WHERE is_object AND has_depth AND error < threshold GROUP BY ALL),
asked AS (SELECT pair_idx, direction, threshold, count(*) AS n_source, count(*) FILTER (min_error < threshold) AS n_gt FROM least_error, t GROUP BY ALL),
hit AS (SELECT a.*, c.layer, c.rank, ks.k, (SELECT count(*) FROM first f WHERE f.pair_idx = a.pair_idx AND f.direction = a.direction AND f.threshold = a.threshold AND f.layer = c.layer AND f.rank = c.rank AND f.direct <= ks.k) AS direct,
  (SELECT count(*) FROM first f WHERE f.pair_idx = a.pair_idx AND f.direction = a.direction AND f.threshold = a.threshold AND f.layer = c.layer AND f.rank = c.rank AND f.mutual <= ks.k) AS mutual FROM asked a, cfg c, ks),
directions AS (SELECT pair_idx, layer, rank, direction, threshold, k, n_source, n_gt, n_gt::DOUBLE / n_source AS gt_coverage, direct::DOUBLE / nullif(n_gt, 0) AS directional_cdf, mutual::DOUBLE / nullif(n_gt, 0) AS mutual_cdf,
  direct::DOUBLE / n_source AS directional_recall_all, mutual::DOUBLE / n_source AS mutual_recall_all FROM hit),
eligible AS (SELECT pair_idx, layer, rank, threshold, k, count(*) AS directions, count(*) = 2 AND min(n_gt) > 0 AS eligible, avg(directional_cdf) AS dc, avg(mutual_cdf) AS mc, avg(directional_recall_all) AS directional_recall_all, avg(mutual_recall_all) AS mutual_recall_all FROM directions GROUP BY ALL),
pairs AS (SELECT p.bin, p.object, e.pair_idx, layer, rank, threshold, k, directions, eligible, CASE WHEN eligible THEN dc END AS directional_cdf, CASE WHEN eligible THEN mc END AS mutual_cdf, directional_recall_all, mutual_recall_all FROM eligible e JOIN pr p USING (pair_idx)),
objects AS (SELECT bin, object, layer, rank, threshold, k, count(*) AS pair_count, count(*) FILTER (eligible) AS eligible_pairs, avg(directional_cdf) AS directional_cdf, avg(mutual_cdf) AS mutual_cdf, avg(directional_recall_all) AS directional_recall_all, avg(mutual_recall_all) AS mutual_recall_all FROM pairs GROUP BY ALL),
summary AS (SELECT bin, layer, rank, threshold, k, count(*) AS category_count, count(*) FILTER (eligible_pairs > 0) AS eligible_categories, sum(pair_count)::BIGINT AS pair_count, sum(eligible_pairs)::BIGINT AS eligible_pairs,
  avg(directional_cdf) AS directional_cdf, avg(mutual_cdf) AS mutual_cdf, avg(directional_recall_all) AS directional_recall_all, avg(mutual_recall_all) AS mutual_recall_all FROM objects GROUP BY ALL),
points AS (SELECT s.bin, s.layer, s.rank, s.k, avg(mutual_cdf) AS mutual_cdf, count(DISTINCT threshold) AS threshold_count, min(s.category_count) AS objects, min(s.pair_count) AS pairs, min(m.macro_mean) AS mean_matches
  FROM summary s JOIN match_summary m ON m.bin = s.bin AND m.layer = s.layer AND m.rank = s.rank AND m.k = s.k GROUP BY ALL)"""
_KEYS = "layer::BIGINT AS layer, rank::BIGINT AS rank, k::BIGINT AS k"
_METRICS = ", ".join(f"round({m}, 6) AS {m}" for m in dense.METRICS)


def study(spark, sf_dir):
    """pairs, descriptors, patches and cameras from the vectors: a label is a pair of images, even ids are patches of the first."""
    e = adapters.keypoints(spark, sf_dir).filter("pair_idx IS NOT NULL").select("pair_idx", "side", "idx", "raw")
    image = F.concat(F.lit("o"), (F.col("pair_idx") % 3).cast("string"), F.lit("/"), F.col("pair_idx").cast("string"), F.when(F.col("side") == 0, "a").otherwise("b"))
    at = lambda i: F.get("raw", F.lit(i))
    patches = e.select(image.alias("image"), F.col("idx").alias("patch_idx"), (at(0) > F.lit(-0.05)).alias("is_object"), (at(1) > F.lit(-0.1)).alias("has_depth"), *(at(2 + i).alias(c) for i, c in enumerate("xyz")))
    squared = F.transform("raw", lambda x: x * F.abs(x))
    layers = F.explode(F.array(F.struct(F.lit(1).alias("layer"), F.col("raw").alias("v")), F.struct(F.lit(2).alias("layer"), squared.alias("v")))).alias("l")
    descriptors = e.select(image.alias("image"), F.col("idx").alias("patch_idx"), layers).select("image", "l.layer", "patch_idx", "l.v")
    labels = e.select("pair_idx").distinct()
    name = lambda s: F.concat(F.lit("o"), (F.col("pair_idx") % 3).cast("string"), F.lit("/"), F.col("pair_idx").cast("string"), F.lit(s))
    pairs = labels.select("pair_idx", F.concat(F.lit("bin"), (F.col("pair_idx") % 2).cast("string")).alias("bin"), F.concat(F.lit("o"), (F.col("pair_idx") % 3).cast("string")).alias("object"), name("a").alias("image_a"), name("b").alias("image_b"))
    still = labels.select(name("a").alias("image"), *(F.lit(v).alias(c) for c, v in zip(("qw", "qx", "qy", "qz", "tx", "ty", "tz"), (1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), strict=True)))
    turned = labels.select(name("b").alias("image"), F.lit(1.0).alias("qw"), (0.1 * (F.col("pair_idx") % 3)).alias("qx"), F.lit(0.05).alias("qy"), (0.02 * (F.col("pair_idx") % 2)).alias("qz"), F.lit(0.02).alias("tx"), F.lit(0.0).alias("ty"), F.lit(0.01).alias("tz"))
    return pairs, descriptors, patches, still.unionByName(turned)


def _evaluated(spark, sf_dir, *stored: str):
    """pairs, candidates, minimum errors and counts; those that are named, and ``ranked`` below candidates and counts, are written once and read by all that follows."""
    pairs, descriptors, patches, cameras = study(spark, sf_dir)
    kept = lambda df, name: staged(df, f"dense-{name}") if name in stored else df
    made = dense.evaluate(pairs, descriptors, patches, cameras, K, BASIS, RANKS, keep=lambda found: kept(found, "ranked"))
    return pairs, *(kept(df, name) for name, df in zip(("candidates", "minimum", "counts"), made, strict=True))


def _directions(spark, sf_dir):
    pairs, candidates, minimum, counts = _evaluated(spark, sf_dir, "ranked", "minimum")
    # made by Spark: a table of Python rows would start Python workers of its own on all executors, which then stay
    configs = spark.range(1, 3).select(F.col("id").cast("int").alias("layer"), F.explode(F.array(*map(F.lit, RANKS))).alias("rank"))
    return pairs, dense.direction_cdf(candidates, minimum, configs, THRESHOLDS, K), counts


def _tables(spark, sf_dir):
    pairs, directions, counts = _directions(spark, sf_dir)
    by_pair = dense.pair_cdf(directions, pairs)
    by_object = dense.category_cdf(by_pair)
    return by_pair, by_object, dense.summary_cdf(by_object), dense.match_count_reports(counts, pairs)


def _longs(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


def _metrics():
    return [r6(m) for m in dense.METRICS]


@registered(f"WITH {POINTS} SELECT pair_idx, direction, source, round(min_error, 6) AS min_error FROM least_error")
def dense_minimum_error(spark, sf_dir):
    pairs, _, patches, cameras = study(spark, sf_dir)
    return dense.minimum_errors(dense.sources(pairs, patches, cameras), patches).select("pair_idx", "direction", "source", r6("min_error"))


@registered(f"WITH {CANDIDATES} SELECT pair_idx, layer::BIGINT AS layer, rank::BIGINT AS rank, direction, source, target, cand_rank, entry_k::BIGINT AS entry_k, is_object, has_depth, round(error, 6) AS error FROM cand")
def dense_candidate_error(spark, sf_dir):
    _, candidates, _, _ = _evaluated(spark, sf_dir)
    return candidates.select("pair_idx", *_longs("layer", "rank"), "direction", "source", "target", *_longs("cand_rank", "entry_k"), "is_object", "has_depth", r6("error"))


@registered(f"WITH {DIRECTIONS} SELECT pair_idx, {_KEYS}, direction, threshold, n_source, n_gt, round(gt_coverage, 6) AS gt_coverage, {_METRICS} FROM directions")
def dense_direction_cdf(spark, sf_dir):
    return _directions(spark, sf_dir)[1].select("pair_idx", *_longs("layer", "rank", "k"), "direction", "threshold", *_longs("n_source", "n_gt"), r6("gt_coverage"), *_metrics())


@registered(f"WITH {DIRECTIONS} SELECT bin, object, pair_idx, {_KEYS}, threshold, directions, eligible, {_METRICS} FROM pairs")
def dense_pair_cdf(spark, sf_dir):
    return _tables(spark, sf_dir)[0].select("bin", "object", "pair_idx", *_longs("layer", "rank", "k"), "threshold", "directions", "eligible", *_metrics())


@registered(f"WITH {DIRECTIONS} SELECT bin, object, {_KEYS}, threshold, pair_count, eligible_pairs, {_METRICS} FROM objects")
def dense_category_cdf(spark, sf_dir):
    return _tables(spark, sf_dir)[1].select("bin", "object", *_longs("layer", "rank", "k"), "threshold", *_longs("pair_count", "eligible_pairs"), *_metrics())


@registered(f"WITH {DIRECTIONS} SELECT bin, {_KEYS}, threshold, category_count, eligible_categories, pair_count, eligible_pairs, {_METRICS} FROM summary")
def dense_summary_cdf(spark, sf_dir):
    return _tables(spark, sf_dir)[2].select("bin", *_longs("layer", "rank", "k"), "threshold", *_longs("category_count", "eligible_categories", "pair_count", "eligible_pairs"), *_metrics())


@registered(
    f"WITH {DIRECTIONS} SELECT bin, {_KEYS}, count(*) AS threshold_count, "
    + ", ".join(f"round(CASE WHEN count(*) = {len(THRESHOLDS)} AND count({m}) = {len(THRESHOLDS)} THEN avg({m}) END, 6) AS {m}" for m in dense.METRICS)
    + " FROM summary GROUP BY bin, layer, rank, k"
)
def dense_threshold_mean(spark, sf_dir):
    return dense.threshold_mean(_tables(spark, sf_dir)[2], THRESHOLDS).select("bin", *_longs("layer", "rank", "k"), "threshold_count", *_metrics())


@registered(f"WITH {MATCHES} SELECT bin, object, {_KEYS}, pair_count, round(mean_matches, 6) AS mean_matches FROM per_object")
def dense_category_matches(spark, sf_dir):
    pairs, _, _, counts = _evaluated(spark, sf_dir, "counts")
    return dense.match_count_reports(counts, pairs)[0].select("bin", "object", *_longs("layer", "rank", "k"), "pair_count", r6("mean_matches"))


@registered(f"WITH {MATCHES} SELECT bin, {_KEYS}, pair_count, category_count, round(pair_median, 6) AS pair_median, round(pair_p90, 6) AS pair_p90, round(macro_mean, 6) AS macro_mean FROM match_summary")
def dense_summary_matches(spark, sf_dir):
    pairs, _, _, counts = _evaluated(spark, sf_dir, "counts")
    return dense.match_count_reports(counts, pairs)[1].select("bin", *_longs("layer", "rank", "k"), "pair_count", "category_count", *(r6(c) for c in ("pair_median", "pair_p90", "macro_mean")))


@registered(f"WITH {DIRECTIONS} SELECT bin, {_KEYS}, round(mutual_cdf, 6) AS mutual_cdf, round(mean_matches, 6) AS mean_matches, threshold_count, objects, pairs FROM points")
def dense_sweep_points(spark, sf_dir):
    _, _, summary, (_, matches) = _tables(spark, sf_dir)
    return dense.sweep_points(summary, matches, THRESHOLDS).select("bin", *_longs("layer", "rank", "k"), r6("mutual_cdf"), r6("mean_matches"), "threshold_count", "objects", "pairs")


@registered(f"WITH {DIRECTIONS} SELECT bin, layer::BIGINT AS layer, rank::BIGINT AS rank, round(100 * (max(mutual_cdf) FILTER (k = {K}) - max(mutual_cdf) FILTER (k = 1)), 6) AS gain_pp FROM points GROUP BY bin, layer, rank")
def dense_curve_gain(spark, sf_dir):
    _, _, summary, (_, matches) = _tables(spark, sf_dir)
    return dense.curve_gain(dense.sweep_points(summary, matches, THRESHOLDS), 1, K).select("bin", *_longs("layer", "rank"), r6("gain_pp"))


@registered(
    """WITH o AS (SELECT o_orderkey AS pair_idx, 'o' || (o_custkey % 5) || '/a' AS image_1, 'o' || (CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END % 5) || '/b' AS image_2,
  (cast(round(o_totalprice * 100) AS BIGINT) % 4500)::DOUBLE / 100 AS angle, CASE WHEN o_orderkey % 13 = 0 THEN 481 ELSE 480 END AS h FROM orders)
SELECT pair_idx, CASE WHEN pair_idx % 11 = 0 THEN 'missing metadata' WHEN pair_idx % 17 = 0 THEN 'paths disagree' WHEN NOT (angle >= 5 AND angle < 40) THEN 'angle outside the bin' WHEN split_part(image_1, '/', 1) <> split_part(image_2, '/', 1) THEN 'crosses objects'
  WHEN h <> 480 THEN 'sizes disagree' END AS problem FROM o"""
)
def dense_pair_problems(spark, sf_dir):
    o = adapters.results(spark, sf_dir)
    first = F.concat(F.lit("o"), (F.col("custkey") % 5).cast("string"), F.lit("/a"))
    second = F.concat(F.lit("o"), ((F.col("custkey") + (F.col("pair_idx") % 7 == 0).cast("int")) % 5).cast("string"), F.lit("/b"))
    pairs = o.select("pair_idx", first.alias("image_1"), second.alias("image_2"))
    meta = o.filter("pair_idx % 11 <> 0").select("pair_idx", F.when(F.col("pair_idx") % 17 == 0, "x/y").otherwise(first).alias("image_1"), second.alias("image_2"), F.col("err").alias("angle"), F.when(F.col("pair_idx") % 13 == 0, 481).otherwise(480).alias("image_1_height"), F.lit(640).alias("image_1_width"), F.lit(480).alias("image_2_height"), F.lit(640).alias("image_2_width"))
    sizes = spark.range(10).select(F.concat(F.lit("o"), (F.col("id") % 5).cast("string"), F.when(F.col("id") < 5, "/a").otherwise("/b")).alias("image"), F.lit(480).alias("height"), F.lit(640).alias("width"))
    return dense.check_pairs(pairs, meta, sizes, 5.0, 40.0).select("pair_idx", "problem")
