"""Queries of the pose studies' smaller tables, of preparation and of provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchweave.functions import geometry as g
from matchweave.functions import text
from matchweave.functions.vector import cosine_basis, normalize, residual_prefixes
from matchweave.operators import checks, gridfilter, knn, metrics, splits
from matchweave.plans.reports import AUC, POSE, RES, _aucs, _poses
from matchweave.plans.registry import r6, registered
from matchweave.sources import adapters, archives, datasets

ORDER = "SELECT o_orderpriority AS dataset, o_custkey % 7 AS subset, (cast(round(o_totalprice * 100) AS BIGINT) % 4500)::DOUBLE / 100 AS err, CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' ELSE (o_orderkey % 100)::VARCHAR END AS iterations FROM orders"


def _orders(spark, sf_dir):
    r = adapters.results(spark, sf_dir)
    return r.select("dataset", (F.col("custkey") % 7).alias("subset"), "err", F.when(F.col("pair_idx") % 9 == 0, "n/a").otherwise((F.col("pair_idx") % 100).cast("string")).alias("iterations"))


@registered(
    f"""WITH r AS ({ORDER}), a AS (SELECT dataset, 100::DOUBLE / (count(*) * 10) * (coalesce(sum(10 - err) FILTER (err < 10), 0) + 0.5::DOUBLE * coalesce(max(err) FILTER (err < 10), 0)) AS auc, count(*) AS pairs FROM r GROUP BY ALL),
m AS (SELECT dataset, subset, avg(TRY_CAST(iterations AS DOUBLE)) AS iterations FROM r GROUP BY ALL), c AS (SELECT dataset, avg(iterations) AS iterations FROM m GROUP BY ALL) SELECT dataset, 10::DOUBLE AS threshold, round(auc, 6) AS auc, pairs, round(iterations, 6) AS iterations FROM a JOIN c USING (dataset)"""
)
def dataset_report(spark, sf_dir):
    """AUC over all pairs of a dataset, cost as the mean of its subsets' means; cells that are no numbers do not count."""
    return metrics.dataset_report(_orders(spark, sf_dir), ["dataset"], "subset", [10.0], ["iterations"]).select("dataset", "threshold", r6("auc"), "pairs", r6("iterations"))


@registered(f"{AUC}, d AS (SELECT a.*, a.auc - b.auc AS delta FROM auc a JOIN auc b ON a.dataset = b.dataset AND a.seed = b.seed AND a.threshold = b.threshold AND b.method = 'F') SELECT dataset, method, threshold, round(avg(auc), 6) AS mean, round(stddev_samp(auc), 6) AS std, round(avg(delta), 6) AS delta_mean, round(min(delta), 6) AS delta_min, round(max(delta), 6) AS delta_max, count(*) AS seeds, arg_min(pairs, seed) AS pairs FROM d GROUP BY dataset, method, threshold")
def nested_k_summary(spark, sf_dir):
    d = metrics.paired_delta(_aucs(spark, sf_dir), ["dataset", "seed", "threshold"], "method", "F", "auc")
    s = metrics.nested_summary(d, ["dataset", "method", "threshold"], "auc", "delta", "pairs")
    return s.select("dataset", "method", "threshold", *(r6(c) for c in ("mean", "std", "delta_mean", "delta_min", "delta_max")), "seeds", "pairs")


@registered(f"{AUC}, s AS (SELECT dataset, threshold, avg(p.auc - b.auc) AS mean, stddev_samp(p.auc - b.auc) AS std, count(*) AS seeds FROM auc p JOIN auc b USING (dataset, seed, threshold) WHERE p.method = 'O' AND b.method = 'F' GROUP BY ALL) SELECT dataset, threshold, round(mean, 6) AS mean, round(std, 6) AS std, seeds FROM s WHERE seeds = 5")
def paired_delta_over_five_seeds(spark, sf_dir):
    d = metrics.pivot_delta(_aucs(spark, sf_dir), ["dataset", "seed", "threshold"], "method", "O", "F", "auc")
    s = metrics.five_seeds(metrics.seed_summary(d, ["dataset", "threshold"], "delta", single=None))
    return s.select("dataset", "threshold", r6("mean"), r6("std"), "seeds")


@registered(f"WITH {RES} SELECT method, max(err) AS err, arg_max(dataset, (err, dataset)) AS dataset FROM res GROUP BY method")
def worst_with_name(spark, sf_dir):
    return metrics.worst(adapters.results(spark, sf_dir), ["method"], "err", "dataset")


@registered(f"WITH {RES} SELECT dataset, count(DISTINCT method) AS methods, count(DISTINCT custkey) AS customers, count(DISTINCT seed) AS seeds FROM res GROUP BY dataset")
def support_counts(spark, sf_dir):
    return metrics.support(adapters.results(spark, sf_dir), ["dataset"], methods="method", customers="custkey", seeds="seed")


@registered(f"{AUC}, w AS (SELECT method, dataset, avg(auc) AS auc FROM auc GROUP BY ALL) SELECT dataset, method, round(auc, 6) AS auc, CASE dataset WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END::BIGINT AS place FROM w")
def datasets_in_order(spark, sf_dir):
    """Tables of each method one after the other, datasets in a given order."""
    table = _aucs(spark, sf_dir).groupBy("method", "dataset").agg(F.avg("auc").alias("auc"))
    parts = [table.filter(F.col("method") == m) for m in "FOP"]
    return metrics.in_dataset_order(parts, ["3-MEDIUM", "1-URGENT"]).select("dataset", "method", r6("auc"), F.col("place").cast("long").alias("place"))


@registered(
    f"""WITH {POSE}, m AS (SELECT a.idx, a.w*b.w+a.x*b.x+a.y*b.y+a.z*b.z AS d, (a.t0*b.t0+a.t1*b.t1+a.t2*b.t2) / (sqrt(a.t0*a.t0+a.t1*a.t1+a.t2*a.t2) * sqrt(b.t0*b.t0+b.t1*b.t1+b.t2*b.t2)) AS c FROM unitq a LEFT JOIN unitq b ON b.idx = a.idx + 3 AND a.idx % 4 <> 0)
SELECT idx, CASE WHEN d IS NULL THEN 180 ELSE round(greatest(degrees(acos(greatest(-1, least(1, 2 * d * d - 1)))), least(degrees(acos(greatest(-1, least(1, c)))), 180 - degrees(acos(greatest(-1, least(1, c)))))), 5) END AS err FROM m"""
)
def errors_against_truth(spark, sf_dir):
    """Poses against those of other ids; a pose without a truth has no error, which counts as failed."""
    p = _poses(spark, sf_dir)
    named = lambda d, shift: d.select((F.col("idx") - shift).alias("pair_idx"), *(F.col(a).alias(b) for a, b in zip([*"wxyz", "t0", "t1", "t2"], ("qw", "qx", "qy", "qz", "tx", "ty", "tz"), strict=True)))
    found = metrics.errors_against_truth(named(p, 0), named(p, 3).filter("pair_idx % 4 <> 0"))
    return found.select(F.col("pair_idx").alias("idx"), (F.round(g.pose_error(F.col("rotation_error_deg"), F.col("translation_error_deg")), 5) + F.lit(0.0)).alias("err"))


@registered(f"WITH {RES} SELECT pair_idx, greatest(err, tr) AS err FROM res")
def strict_errors(spark, sf_dir):
    r = adapters.results(spark, sf_dir)
    return metrics.strict_errors(r, r.select("pair_idx", F.col("err").alias("rotation_error_deg"), F.col("tr").alias("translation_error_deg")))


@registered(
    """WITH want AS (SELECT o_orderkey FROM orders), have AS (SELECT l_orderkey AS pair_idx, l_returnflag, l_extendedprice, l_linenumber FROM lineitem WHERE l_linenumber = 1 OR l_linenumber = 7 UNION ALL SELECT o_orderkey + 10000000, 'N', 1, 1 FROM orders WHERE o_orderkey % 50 = 0)
SELECT 'missing' AS problem, (SELECT count(*) FROM want WHERE o_orderkey NOT IN (SELECT pair_idx FROM have)) AS count UNION ALL SELECT 'unexpected', (SELECT count(DISTINCT pair_idx) FROM have WHERE pair_idx NOT IN (SELECT o_orderkey FROM want))
UNION ALL SELECT 'duplicate', (SELECT count(*) FROM (SELECT 1 FROM have GROUP BY pair_idx HAVING count(*) > 1)) UNION ALL SELECT 'bad_status', (SELECT count(*) FROM have WHERE l_returnflag = 'A') UNION ALL SELECT 'negative_time', (SELECT count(*) FROM have WHERE l_linenumber = 7)
UNION ALL SELECT 'not_finite', (SELECT count(*) FROM have WHERE l_returnflag = 'N' AND pair_idx % 11 = 0)"""
)
def result_completeness(spark, sf_dir):
    """Results against the list of pairs, and the rules that they break."""
    l = adapters.table(spark, sf_dir, "lineitem").filter("l_linenumber IN (1, 7)").select(F.col("l_orderkey").alias("pair_idx"), "l_returnflag", "l_linenumber")
    o = adapters.table(spark, sf_dir, "orders")
    more = o.filter("o_orderkey % 50 = 0").select((F.col("o_orderkey") + 10000000).alias("pair_idx"), F.lit("N").alias("l_returnflag"), F.lit(1).alias("l_linenumber"))
    have = l.unionByName(more)
    status = F.when(F.col("l_returnflag") == "A", "unknown").when(F.col("l_returnflag") == "N", "success").otherwise("failed")
    error = F.when(F.col("pair_idx") % 11 == 0, float("nan")).otherwise(1.0)
    results = have.select("pair_idx", status.alias("status"), F.when(F.col("l_linenumber") == 7, -1.0).otherwise(1.0).alias("running_time_s"), error.alias("rotation_error_deg"), F.lit(2.0).alias("translation_error_deg"))
    return checks.complete(results, o.select(F.col("o_orderkey").alias("pair_idx")), ["pair_idx"])


@registered("WITH p AS (SELECT l_partkey AS pair_idx, l_suppkey AS left_idx, l_orderkey AS right_idx, l_quantity < 5 AS bad FROM lineitem) SELECT pair_idx, count(*) AS rows, count(DISTINCT CASE WHEN NOT bad THEN (left_idx, right_idx) END) AS edges, count(*) FILTER (bad) AS invalid, count(*) FILTER (bad) = 0 AND count(DISTINCT CASE WHEN NOT bad THEN (left_idx, right_idx) END) = count(*) AS valid FROM p GROUP BY pair_idx")
def association_audit(spark, sf_dir):
    from matchweave.sources.readers import association_audit as audit

    l = adapters.table(spark, sf_dir, "lineitem")
    return audit(l.select(F.col("l_partkey").alias("pair_idx"), F.col("l_suppkey").alias("left_idx"), F.col("l_orderkey").alias("right_idx"), F.when(F.col("l_quantity") < 5, "small").alias("bad")))


def _cumulated(rank: int) -> str:
    from matchweave.plans.association import RAW

    sql, now = RAW, "raw"
    for k, u in enumerate(cosine_basis(64, 4)):
        unit = "[" + ", ".join(f"{x!r}::DOUBLE" for x in u) + "]"
        sql += f", c{k + 1} AS (SELECT idx, list_transform(v0, lambda x, i: x - list_dot_product(v0, {unit}) * ({unit})[i]) AS v0 FROM {now})"
        now = f"c{k + 1}"
    parts = " UNION ALL ".join(f"SELECT idx, {r}::BIGINT AS rank, round(v0[1] / sqrt(list_dot_product(v0, v0)), 6) AS first, round(v0[40] / sqrt(list_dot_product(v0, v0)), 6) AS fortieth FROM {'raw' if r == 0 else f'c{r}'}" for r in (0, 1, 4))
    return f"WITH {sql} {parts}"


@registered(_cumulated(4))
def subspace_rank_prefixes(spark, sf_dir):
    """What is left of each vector without the first 0, 1 and 4 directions, each from the one before."""
    k = adapters.keypoints(spark, sf_dir).select("idx", F.explode(residual_prefixes(F.col("raw"), cosine_basis(64, 4), (0, 1, 4))).alias("r")).select("idx", "r.rank", normalize(F.col("r.v")).alias("v"))
    return k.select("idx", F.col("rank").cast("long").alias("rank"), r6(F.get("v", F.lit(0)), "first"), r6(F.get("v", F.lit(39)), "fortieth"))


@registered("SELECT p_partkey, round(CASE WHEN greatest(h, w) <= 1024 THEN 1 ELSE trunc(w * (1024::DOUBLE / greatest(h, w))) / w END, 9) AS sx, round(CASE WHEN greatest(h, w) <= 1024 THEN 1 ELSE trunc(h * (1024::DOUBLE / greatest(h, w))) / h END, 9) AS sy FROM (SELECT p_partkey, (480 + p_size * 37)::DOUBLE AS h, (640 + (p_partkey % 50) * 31)::DOUBLE AS w FROM part)")
def axis_scales(spark, sf_dir):
    p = adapters.table(spark, sf_dir, "part").select("p_partkey", (480 + F.col("p_size") * 37).alias("h"), (640 + (F.col("p_partkey") % 50) * 31).alias("w"))
    x, y = datasets.axis_scales(F.col("h"), F.col("w"), 1024, only_down=True)
    return p.select("p_partkey", F.round(x, 9).alias("sx"), F.round(y, 9).alias("sy"))


@registered("WITH s AS (SELECT p_partkey, 480 + p_size * 37 AS h, 640 + (p_partkey % 50) * 31 AS w FROM part), r AS (SELECT CASE WHEN greatest(h, w) <= 1024 THEN h ELSE trunc(h * (1024::DOUBLE / greatest(h, w))) END::INT AS h, CASE WHEN greatest(h, w) <= 1024 THEN w ELSE trunc(w * (1024::DOUBLE / greatest(h, w))) END::INT AS w FROM s) SELECT DISTINCT ((h + 13) // 14 * 14)::INT AS height, ((w + 13) // 14 * 14)::INT AS width FROM r")
def padded_sizes(spark, sf_dir):
    p = adapters.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"), (480 + F.col("p_size") * 37).cast("int").alias("height"), (640 + (F.col("p_partkey") % 50) * 31).cast("int").alias("width"))
    return datasets.padded_sizes(p.withColumn("image", F.col("image").cast("string")), 1024, 14, only_down=True)


@registered("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'SIMPLE_PINHOLE' WHEN p_size % 4 = 1 THEN 'PINHOLE' WHEN p_size % 4 = 2 THEN 'OPENCV' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'FULL_OPENCV' END END AS model FROM part")
def camera_models(spark, sf_dir):
    p = adapters.table(spark, sf_dir, "part")
    kind = F.col("p_size") % 4
    size = F.when(kind < 2, 0).when(kind == 2, 4).otherwise(F.when(F.col("p_partkey") % 2 == 0, 8).otherwise(5))
    fy = 500.0 + F.when(kind == 1, 0.001).otherwise(1e-8)
    return p.select("p_partkey", datasets.camera_model(F.lit(500.0), fy, F.array_repeat(F.lit(0.1), size)).alias("model"))


@registered("WITH i AS (SELECT p_partkey AS image, 1 + (p_size % 5 * 14 + 13) // 14 AS grid_w, 14 * (p_size % 4) + p_partkey % 14 AS h, 14 * (p_size % 5) + p_partkey % 14 AS w FROM part) SELECT image, (gy * grid_w + gx)::BIGINT AS patch_idx FROM i, generate_series(0, 4) a(gy), generate_series(0, 5) b(gx) WHERE gy < h // 14 AND gx < w // 14")
def complete_patches(spark, sf_dir):
    p = adapters.table(spark, sf_dir, "part")
    size = F.col("p_size")
    grids = p.select(F.col("p_partkey").alias("image"), (1 + F.floor((size % 5 * 14 + 13) / 14)).alias("grid_w"), (14 * (size % 4) + F.col("p_partkey") % 14).alias("resized_h"), (14 * (size % 5) + F.col("p_partkey") % 14).alias("resized_w"))
    return archives.complete_patches(grids, 14).select("image", F.col("patch_idx").cast("long").alias("patch_idx"))


@registered("SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS layer FROM lineitem")
def zero_based_layers(spark, sf_dir):
    l = adapters.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("int").alias("layer"))
    return datasets.zero_based(l, 7).select("l_orderkey", "l_linenumber", F.col("layer").cast("long").alias("layer"))


@registered("SELECT o_orderkey, 'o' || o_custkey AS object, CASE WHEN o_custkey % 4 = 0 THEN (o_custkey / 4)::BIGINT::VARCHAR ELSE (o_custkey / 4::DOUBLE)::VARCHAR END AS label FROM orders")
def objects_and_labels(spark, sf_dir):
    o = adapters.table(spark, sf_dir, "orders")
    a, b = (F.concat(F.lit("o"), F.col("o_custkey").cast("string"), F.lit(s)) for s in ("/a.jpg", "/b.jpg"))
    return o.select("o_orderkey", text.same_object(a, b).alias("object"), text.number_label(F.col("o_custkey") / 4).alias("label"))


@registered("WITH e AS (SELECT l_partkey AS a, l_suppkey AS b, (l_orderkey % 130)::DOUBLE AS d FROM lineitem), k AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, count(*) AS n FROM e GROUP BY ALL) SELECT CASE WHEN a = b THEN 'loop' WHEN NOT (d >= 0 AND d < 120) THEN 'distance out of range' WHEN k.n > 1 THEN 'duplicate edge' END AS problem, count(*) AS n FROM e JOIN k ON k.lo = least(a, b) AND k.hi = greatest(a, b) GROUP BY 1")
def edge_guards(spark, sf_dir):
    l = adapters.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("image_1"), F.col("l_suppkey").alias("image_2"), (F.col("l_orderkey") % 130).cast("string").alias("distance"))
    return splits.guarded_edges(l, 0.0, 120.0).groupBy("problem").agg(F.count("*").alias("n"))


@registered("WITH e AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem), d AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node), w AS (SELECT coalesce(d.n, 0) AS n FROM part LEFT JOIN d ON d.node = p_partkey + 5) SELECT max(n) AS max_degree, count(*) FILTER (n > 0) AS nodes, sum(n * n)::BIGINT AS squares, count(*) FILTER (n = 0) AS unused FROM w")
def degree_summary(spark, sf_dir):
    l = adapters.table(spark, sf_dir, "lineitem")
    return splits.degree_summary(l, adapters.table(spark, sf_dir, "part").select((F.col("p_partkey") + 5).alias("node")), "l_partkey", "l_suppkey")


@registered(
    """WITH e AS (SELECT l_orderkey % 500 AS pair_idx, l_partkey AS left_idx, l_suppkey AS right_idx, l_linenumber AS k, -l_extendedprice::DOUBLE AS similarity, (l_quantity::INT % 40)::DOUBLE AS x, (l_orderkey % 30)::DOUBLE AS y FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY pair_idx ORDER BY k, similarity DESC, left_idx, right_idx, x, y) AS ordinal FROM e), f AS (SELECT DISTINCT pair_idx, left_idx, arg_min(x, ordinal) AS x, arg_min(y, ordinal) AS y FROM o GROUP BY ALL)
SELECT pair_idx, left_idx, x, y, x >= 0 AND y >= 0 AS valid, x <= 29 AND y <= 19 AS inside FROM f"""
)
def first_seen_points(spark, sf_dir):
    """The place that each left point came with first, and whether that is on a frame of 30 x 20 pixels."""
    from pyspark.sql import Window

    l = adapters.table(spark, sf_dir, "lineitem")
    e = l.select((F.col("l_orderkey") % 500).alias("pair_idx"), F.col("l_partkey").alias("left_idx"), F.col("l_suppkey").alias("right_idx"), F.col("l_linenumber").alias("k"), (-F.col("l_extendedprice").cast("double")).alias("similarity"), (F.col("l_quantity").cast("int") % 40).cast("double").alias("x1"), (F.col("l_orderkey") % 30).cast("double").alias("y1")).withColumns({"x2": F.col("x1"), "y2": F.col("y1")})
    e = e.withColumn("ordinal", F.row_number().over(Window.partitionBy("pair_idx").orderBy("k", F.desc("similarity"), "left_idx", "right_idx", "x1", "y1")))
    valid, inside = gridfilter.in_frame(F.col("x"), F.col("y"), F.lit(30), F.lit(20))
    return gridfilter.first_seen(e).select("pair_idx", "left_idx", F.col("x1").alias("x"), F.col("y1").alias("y")).distinct().withColumns({"valid": valid, "inside": inside})


@registered()
def grid_filter_files(spark, sf_dir):
    """The filter as a whole, from pixels to renumbered associations."""
    left, right = adapters.sides(spark, sf_dir)
    at = lambda side, name, n: side.select("pair_idx", F.col("idx").alias(name), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    edges = knn.mutual_knn(left, right, 5).join(at(left, "left_idx", 1), ["pair_idx", "left_idx"]).join(at(right, "right_idx", 2), ["pair_idx", "right_idx"])
    return gridfilter.filter_files(edges, 8, 0.7, with_scale=True, with_rotation=True).select("pair_idx", "left_idx", "right_idx", r6("similarity"), F.col("k").cast("long").alias("k"))
