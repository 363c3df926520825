"""Queries over association graphs: neighbours, nesting, degrees, grid filter, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.functions.vector import as_double, cosine_basis, norm, normalize, project_out
from matchweave.operators import checks, graph, gridfilter, knn, metrics, ransac, scoring
from matchweave.plans.registry import r6, registered
from matchweave.sources import adapters

K, MOST = 5, 200

# SQL building blocks
RAW = "raw AS (SELECT label AS pair_idx, vec_id % 2 AS side, vec_id AS idx, [x::DOUBLE for x in embedding] AS v0 FROM embeddings)"
UNIT = RAW + ", unit AS (SELECT pair_idx, side, idx, v0, [x / greatest(sqrt(list_dot_product(v0, v0)), 1e-12) for x in v0] AS v FROM raw)"
RANKED = (
    UNIT
    + """, sims AS (SELECT l.pair_idx, l.idx AS left_idx, r.idx AS right_idx, list_dot_product(l.v, r.v) AS similarity, l.v0 AS lv0, r.v0 AS rv0 FROM unit l JOIN unit r USING (pair_idx) WHERE l.side = 0 AND r.side = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pair_idx, left_idx ORDER BY similarity DESC, right_idx) AS rank_lr, row_number() OVER (PARTITION BY pair_idx, right_idx ORDER BY similarity DESC, left_idx) AS rank_rl FROM sims)"""
)
EDGES = RANKED + f""", edges AS (SELECT pair_idx, left_idx, right_idx, similarity, greatest(rank_lr, rank_rl) AS k FROM ranked WHERE rank_lr <= {K} AND rank_rl <= {K}),
placed AS (SELECT *, row_number() OVER (PARTITION BY pair_idx ORDER BY k, similarity DESC, left_idx, right_idx) AS place FROM edges)"""
#: Poses that the scores are compared on: quaternion (any length) and translation.
POSES = ((1, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (2, 1.0, 0.05, 0.0, 0.0, 0.0, 1.0, 0.1), (3, 2.0, 0.0, 0.1, 0.04, 0.1, 0.1, 1.0), (4, 1.0, -0.03, 0.06, 0.2, 0.6, 0.8, -0.2))
_ROT = "1-2*(y*y+z*z) AS r00, 2*(x*y-w*z) AS r01, 2*(x*z+w*y) AS r02, 2*(x*y+w*z) AS r10, 1-2*(x*x+z*z) AS r11, 2*(y*z-w*x) AS r12, 2*(x*z-w*y) AS r20, 2*(y*z+w*x) AS r21, 1-2*(x*x+y*y) AS r22"
_ESSENTIAL = ", ".join(f"-tz*r1{j}+ty*r2{j} AS e0{j}, tz*r0{j}-tx*r2{j} AS e1{j}, -ty*r0{j}+tx*r1{j} AS e2{j}" for j in range(3))
GRAPH = (
    RANKED
    + f""", near AS (SELECT pair_idx, left_idx, right_idx, 0.64::DOUBLE * lv0[1] AS x1, 0.64::DOUBLE * lv0[2] AS y1, 0.64::DOUBLE * rv0[1] AS x2, 0.64::DOUBLE * rv0[2] AS y2 FROM ranked WHERE rank_lr <= {K} AND rank_rl <= {K}),
prior AS (SELECT *, 0.5::DOUBLE * (0.3::DOUBLE / count(*) OVER (PARTITION BY pair_idx, left_idx) + 0.3::DOUBLE / count(*) OVER (PARTITION BY pair_idx, right_idx)) AS p FROM near),
mass AS (SELECT *, sum(p) OVER (PARTITION BY pair_idx, left_idx) AS left_mass, sum(p) OVER (PARTITION BY pair_idx, right_idx) AS right_mass FROM prior),
graph AS (SELECT *, 1 / (greatest(1 - left_mass, 1e-9) * 0.01::DOUBLE) AS left_c, 1 / (greatest(1 - right_mass, 1e-9) * 0.01::DOUBLE) AS right_c FROM mass),
pose(hid, w, x, y, z, tx, ty, tz) AS (VALUES {", ".join("(" + ", ".join(f"{v}::DOUBLE" if i else str(v) for i, v in enumerate(p)) + ")" for p in POSES)}),
hyp AS (SELECT hid, tx, ty, tz, {_ROT} FROM (SELECT hid, w/n AS w, x/n AS x, y/n AS y, z/n AS z, tx, ty, tz FROM (SELECT *, sqrt(w*w+x*x+y*y+z*z) AS n FROM pose))),
lines AS (SELECT g.*, h.*, e00*x1+e01*y1+e02 AS l0, e10*x1+e11*y1+e12 AS l1, e20*x1+e21*y1+e22 AS l2, e00*x2+e10*y2+e20 AS b0, e01*x2+e11*y2+e21 AS b1, r00*x1+r01*y1+r02 AS a0, r10*x1+r11*y1+r12 AS a1, r20*x1+r21*y1+r22 AS a2 FROM graph g, (SELECT *, {_ESSENTIAL} FROM hyp) h),
rays AS (SELECT *, a0*a0+a1*a1+a2*a2 AS aa, a0*x2+a1*y2+a2 AS ab, x2*x2+y2*y2+1 AS bb, a0*tx+a1*ty+a2*tz AS at_, x2*tx+y2*ty+tz AS bt, l0*l0+l1*l1+b0*b0+b1*b1 AS below FROM lines),
scored AS (SELECT *, r2 < 0.0001::DOUBLE AND coalesce((ab*bt-bb*at_) / nullif(aa*bb-ab*ab, 0) > 0.01 AND (aa*bt-ab*at_) / nullif(aa*bb-ab*ab, 0) > 0.01, false) AS inlier FROM
  (SELECT *, CASE WHEN below > 1e-12 THEN (x2*l0+y2*l1+l2) * (x2*l0+y2*l1+l2) / below ELSE 'inf'::DOUBLE END AS r2 FROM rays)),
hcm AS (SELECT pair_idx, hid, 0 - sum(ln(1 + c * m)) AS hcm FROM (
  SELECT pair_idx, hid, left_idx AS n, 0 AS s, sum(CASE WHEN inlier THEN p ELSE 0 END) AS m, min(left_c) AS c FROM scored GROUP BY ALL
  UNION ALL SELECT pair_idx, hid, right_idx, 1, sum(CASE WHEN inlier THEN p ELSE 0 END), min(right_c) FROM scored GROUP BY ALL) GROUP BY pair_idx, hid)"""
)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.mutual_knn(*adapters.sides(spark, sf_dir), K)


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The association graph of all vectors with calibrated coordinates."""
    left, right = adapters.sides(spark, sf_dir)
    at = lambda side, name, n: side.select("pair_idx", F.col("idx").alias(name), F.col("cx").alias(f"x{n}"), F.col("cy").alias(f"y{n}"))
    return knn.mutual_knn(left, right, K).join(at(left, "left_idx", 1), ["pair_idx", "left_idx"]).join(at(right, "right_idx", 2), ["pair_idx", "right_idx"])


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges with prior and weights, and their residuals under the constant hypotheses."""
    edges = scoring.with_prior(_graph(spark, sf_dir))
    return edges, scoring.residuals(edges, adapters.hypotheses(edges, POSES), 0.01)


@registered(f"WITH {EDGES} SELECT pair_idx, left_idx, right_idx, round(similarity, 6) AS similarity, k FROM edges")
def mutual_knn_progressive(spark, sf_dir):
    return _edges(spark, sf_dir).select("pair_idx", "left_idx", "right_idx", r6("similarity"), F.col("k").cast("long").alias("k"))


@registered(f"WITH {EDGES} SELECT pair_idx, left_idx, right_idx, round(similarity, 6) AS similarity, k FROM placed WHERE place <= {MOST}")
def mutual_knn_capped(spark, sf_dir):
    return knn.cap(_edges(spark, sf_dir), MOST).select("pair_idx", "left_idx", "right_idx", r6("similarity"), F.col("k").cast("long").alias("k"))


@registered(f"WITH {RANKED} SELECT pair_idx, left_idx, right_idx, rank_lr AS rank FROM ranked WHERE rank_lr <= {K}")
def topk_canonical(spark, sf_dir):
    return knn.topk(*adapters.sides(spark, sf_dir), K).select("pair_idx", "left_idx", "right_idx", F.col("rank").cast("long").alias("rank"))


@registered(f"WITH {RANKED} SELECT pair_idx, left_idx, right_idx, rank_lr, CASE WHEN rank_rl <= {K} THEN greatest(rank_lr, rank_rl) ELSE {K + 1} END AS entry_k FROM ranked WHERE rank_lr <= {K}")
def mutual_entry_rank_sentinel(spark, sf_dir):
    return knn.mutual_entry(*adapters.sides(spark, sf_dir), K).select("pair_idx", "left_idx", "right_idx", F.col("rank_lr").cast("long").alias("rank_lr"), F.col("entry_k").cast("long").alias("entry_k"))


@registered(f"WITH {UNIT} SELECT l.pair_idx, l.idx AS left_idx, count(*) AS n, round(max(list_dot_product(l.v, r.v)), 6) AS best, round(avg(list_dot_product(l.v, r.v)), 6) AS mean FROM unit l JOIN unit r USING (pair_idx) WHERE l.side = 0 AND r.side = 1 GROUP BY ALL")
def similarity_join(spark, sf_dir):
    return knn.similarity_summary(*adapters.sides(spark, sf_dir)).select("pair_idx", "left_idx", "n", r6("best"), r6("mean"))


CUMULATIVE = EDGES + f", ks AS (SELECT unnest(generate_series(1, {K})) AS k), cum AS (SELECT e.pair_idx, ks.k, count(*) FILTER (e.k <= ks.k) AS edges FROM edges e, ks GROUP BY ALL)"


@registered(f"WITH {CUMULATIVE} SELECT pair_idx, k::BIGINT AS k, edges, edges - lag(edges, 1, 0) OVER (PARTITION BY pair_idx ORDER BY k) AS added FROM cum")
def cumulative_edge_counts(spark, sf_dir):
    return metrics.added_edges(metrics.cumulative_edges(_edges(spark, sf_dir), K)).select("pair_idx", F.col("k").cast("long").alias("k"), "edges", "added")


@registered(f"WITH {CUMULATIVE} SELECT k::BIGINT AS k, round(avg(edges), 6) AS mean, round(quantile_cont(edges::DOUBLE, 0.5), 6) AS median, round(quantile_cont(edges::DOUBLE, 0.9), 6) AS p90 FROM cum GROUP BY k")
def match_count_report(spark, sf_dir):
    return metrics.match_counts(metrics.cumulative_edges(_edges(spark, sf_dir), K)).select(F.col("k").cast("long").alias("k"), r6("mean"), r6("median"), r6("p90"))


@registered(
    f"""WITH {CUMULATIVE}, family AS (SELECT e.pair_idx, e.left_idx, e.right_idx, ks.k AS target_k FROM edges e, ks WHERE e.k <= ks.k)
SELECT target_k::BIGINT AS target_k, count(*) AS edges, (SELECT count(*) FROM family s WHERE s.target_k = f.target_k - 1 AND NOT EXISTS (SELECT 1 FROM family l WHERE l.target_k = f.target_k AND l.pair_idx = s.pair_idx AND l.left_idx = s.left_idx AND l.right_idx = s.right_idx)) AS not_nested FROM family f GROUP BY f.target_k"""
)
def nested_graph_audit(spark, sf_dir):
    family = graph.nested(_edges(spark, sf_dir), K)
    keys = ["pair_idx", "left_idx", "right_idx"]
    shifted = family.filter(F.col("target_k") < K).withColumn("target_k", F.col("target_k") + 1)
    broken = checks.not_nested(shifted, family, [*keys, "target_k"]).groupBy("target_k").agg(F.count("*").alias("not_nested"))
    return family.groupBy("target_k").agg(F.count("*").alias("edges")).join(broken, "target_k", "left").select(F.col("target_k").cast("long").alias("target_k"), "edges", F.coalesce("not_nested", F.lit(0)).cast("long").alias("not_nested"))


def _renumbered(edges: DataFrame) -> DataFrame:
    return edges.select("pair_idx", F.col("left_idx.was").alias("left_was"), F.col("left_idx.now").cast("long").alias("left_now"), F.col("right_idx.was").alias("right_was"), F.col("right_idx.now").cast("long").alias("right_now"))


@registered(f"WITH {EDGES} SELECT pair_idx, left_idx AS left_was, dense_rank() OVER (PARTITION BY pair_idx ORDER BY left_idx) - 1 AS left_now, right_idx AS right_was, dense_rank() OVER (PARTITION BY pair_idx ORDER BY right_idx) - 1 AS right_now FROM edges")
def compact_ids_value_order(spark, sf_dir):
    return _renumbered(knn.compact_by_value(_edges(spark, sf_dir)))


@registered(f"""WITH {EDGES}, first AS (SELECT *, min(place) OVER (PARTITION BY pair_idx, left_idx) AS fl, min(place) OVER (PARTITION BY pair_idx, right_idx) AS fr FROM placed)
SELECT pair_idx, left_idx AS left_was, dense_rank() OVER (PARTITION BY pair_idx ORDER BY fl) - 1 AS left_now, right_idx AS right_was, dense_rank() OVER (PARTITION BY pair_idx ORDER BY fr) - 1 AS right_now FROM first""")
def compact_ids_first_seen(spark, sf_dir):
    return _renumbered(knn.compact_by_appearance(_edges(spark, sf_dir)))


@registered(f"WITH {EDGES} SELECT pair_idx, count(*) AS edges, round(min(similarity), 6) AS least FROM edges WHERE similarity >= 0.3 AND k <= 3 GROUP BY pair_idx")
def similarity_threshold_filter(spark, sf_dir):
    return _edges(spark, sf_dir).filter((F.col("similarity") >= 0.3) & (F.col("k") <= 3)).groupBy("pair_idx").agg(F.count("*").alias("edges"), r6(F.min("similarity"), "least"))


@registered(f"WITH {GRAPH} SELECT pair_idx, left_idx, right_idx, round(p, 6) AS p, round(left_mass, 6) AS left_mass, round(right_mass, 6) AS right_mass, round(left_c, 6) AS left_c FROM graph")
def degree_prior_probability(spark, sf_dir):
    return scoring.with_prior(_graph(spark, sf_dir)).select("pair_idx", "left_idx", "right_idx", r6("p"), r6("left_mass"), r6("right_mass"), r6("left_c"))


@registered(f"WITH {EDGES} SELECT pair_idx, left_idx, right_idx, round(1::DOUBLE / count(*) OVER (PARTITION BY pair_idx, left_idx) + 1::DOUBLE / count(*) OVER (PARTITION BY pair_idx, right_idx), 6) AS weight FROM edges")
def inlier_degree_weights(spark, sf_dir):
    return graph.degree_weights(_edges(spark, sf_dir)).select("pair_idx", "left_idx", "right_idx", r6("weight"))


@registered(f"WITH {UNIT} SELECT idx, round(sqrt(list_dot_product(v0, v0)), 6) AS before, round(sqrt(list_dot_product(v, v)), 6) AS after, round(v[1], 6) AS first FROM unit")
def l2_normalize_check(spark, sf_dir):
    return adapters.keypoints(spark, sf_dir).select("idx", r6(norm(F.col("raw")), "before"), r6(norm(F.col("v")), "after"), r6(F.get("v", F.lit(0)), "first"))


def _residual_sql(rank: int) -> str:
    sql, now = RAW, "raw"
    for k, u in enumerate(cosine_basis(64, rank)):
        unit = "[" + ", ".join(f"{x!r}::DOUBLE" for x in u) + "]"
        sql += f", c{k} AS (SELECT pair_idx, side, idx, list_transform(v0, lambda x, i: x - list_dot_product(v0, {unit}) * ({unit})[i]) AS v0 FROM {now})"
        now = f"c{k}"
    return f"WITH {sql} SELECT idx, round(v0[1] / sqrt(list_dot_product(v0, v0)), 6) AS first, round(v0[64] / sqrt(list_dot_product(v0, v0)), 6) AS last FROM {now}"


@registered(_residual_sql(3))
def subspace_projection_residual(spark, sf_dir):
    v = project_out(F.col("raw"), cosine_basis(64, 3))
    out = adapters.keypoints(spark, sf_dir).select("idx", v.alias("u"))
    return out.select("idx", r6(F.get("u", F.lit(0)), "first"), r6(F.get("u", F.lit(63)), "last"))


@registered(
    f"""WITH {RAW}, corner AS (SELECT r.pair_idx, r.idx, r.v0, dx, dy, 15.5::DOUBLE * (r.v0[1] + 1) AS x, 15.5::DOUBLE * (r.v0[2] + 1) AS y FROM raw r, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy) WHERE side = 0),
placed AS (SELECT *, least(floor(x / 8 - 0.5) + dx, 3) AS gx, least(floor(y / 8 - 0.5) + dy, 3) AS gy, x / 8 - 0.5 - floor(x / 8 - 0.5) AS fx, y / 8 - 0.5 - floor(y / 8 - 0.5) AS fy FROM corner WHERE x / 8 - 0.5 BETWEEN 0 AND 3 AND y / 8 - 0.5 BETWEEN 0 AND 3)
SELECT pair_idx, idx, round(sum((CASE dx WHEN 1 THEN fx ELSE 1 - fx END) * (CASE dy WHEN 1 THEN fy ELSE 1 - fy END) * (10 * gx + gy)), 6) AS value FROM placed GROUP BY ALL"""
)
def bilinear_interpolation(spark, sf_dir):
    """On a 4 x 4 map of patches of 8 pixels whose value is 10 * gx + gy."""
    left = adapters.sides(spark, sf_dir)[0].select("pair_idx", "idx", (15.5 * (F.get("raw", F.lit(0)) + 1)).alias("x"), (15.5 * (F.get("raw", F.lit(1)) + 1)).alias("y"))
    inside, corners = knn.bilinear_rows(F.col("x"), F.col("y"), 8, 4, 4)
    grid = spark.range(16).select((F.col("id") % 4).alias("gx"), F.floor(F.col("id") / 4).alias("gy")).withColumn("value", 10.0 * F.col("gx") + F.col("gy"))
    rows = left.filter(inside).select("pair_idx", "idx", F.explode(corners).alias("c")).select("pair_idx", "idx", "c.*")
    return rows.join(F.broadcast(grid), ["gx", "gy"]).groupBy("pair_idx", "idx").agg(r6(F.sum(F.col("weight") * F.col("value")), "value"))


@registered(f"WITH {RAW} SELECT l.pair_idx, l.idx, round(sqrt(min(power(l.v0[1] - r.v0[1], 2) + power(l.v0[2] - r.v0[2], 2) + power(l.v0[3] - r.v0[3], 2))), 6) AS min_error FROM raw l JOIN raw r USING (pair_idx) WHERE l.side = 0 AND r.side = 1 GROUP BY ALL")
def nearest_destination_min_error(spark, sf_dir):
    point = lambda k: k.select("pair_idx", "idx", *(F.get("raw", F.lit(i)).alias(c) for i, c in enumerate("xyz")))
    return knn.nearest_error(*map(point, adapters.sides(spark, sf_dir))).select("pair_idx", "idx", r6("min_error"))


RECALL = f"""WITH {RANKED}, cand AS (SELECT pair_idx, left_idx, rank_lr, CASE WHEN rank_rl <= {K} THEN greatest(rank_lr, rank_rl) ELSE {K + 1} END AS entry_k, abs(lv0[1] - rv0[1]) AS error FROM ranked WHERE rank_lr <= {K}),
source AS (SELECT pair_idx, left_idx, min(abs(lv0[1] - rv0[1])) AS min_error FROM sims GROUP BY ALL), t(threshold) AS (VALUES (0.05::DOUBLE), (0.1), (0.2)), ks(k) AS (VALUES (1), (2), (5)),
first AS (SELECT pair_idx, left_idx, threshold, min(rank_lr) AS direct, min(entry_k) AS mutual FROM cand, t WHERE error < threshold GROUP BY ALL)
SELECT s.pair_idx, t.threshold, ks.k::BIGINT AS k, count(*) AS n_source, count(*) FILTER (min_error < t.threshold) AS n_gt,
  round(count(*) FILTER (direct <= ks.k)::DOUBLE / nullif(count(*) FILTER (min_error < t.threshold), 0), 6) AS direct_cdf, round(count(*) FILTER (mutual <= ks.k)::DOUBLE / nullif(count(*) FILTER (min_error < t.threshold), 0), 6) AS mutual_cdf
FROM source s CROSS JOIN t CROSS JOIN ks LEFT JOIN first f ON f.pair_idx = s.pair_idx AND f.left_idx = s.left_idx AND f.threshold = t.threshold GROUP BY s.pair_idx, t.threshold, ks.k"""


@registered(RECALL)
def recall_at_k_cdf(spark, sf_dir):
    left, right = adapters.sides(spark, sf_dir)
    at = lambda side, c: side.select("pair_idx", F.col("idx").alias(f"{c}_idx"), F.get("raw", F.lit(0)).alias(f"{c}0"))
    l, r = at(left, "left"), at(right, "right")
    candidates = knn.mutual_entry(left, right, K).join(l, ["pair_idx", "left_idx"]).join(r, ["pair_idx", "right_idx"]).withColumn("error", F.abs(F.col("left0") - F.col("right0")))
    point = lambda side, c: side.select("pair_idx", F.col(f"{c}_idx").alias("idx"), F.col(f"{c}0").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    sources = knn.nearest_error(point(l, "left"), point(r, "right")).select("pair_idx", F.col("idx").alias("left_idx"), "min_error")
    return metrics.recall_at_k(candidates, sources, (0.05, 0.1, 0.2), (1, 2, 5)).select("pair_idx", "threshold", F.col("k").cast("long").alias("k"), "n_source", F.col("n_gt").cast("long").alias("n_gt"), r6("direct_cdf"), r6("mutual_cdf"))


# ---------------------------------------------------------------- grid filter
GRID = 8
CELLS = (
    RANKED
    + f""", pts AS (SELECT pair_idx, left_idx, right_idx, (lv0[1] + 1) / 2 AS x1, (lv0[2] + 1) / 2 AS y1, (rv0[1] + 1) / 2 AS x2, (rv0[2] + 1) / 2 AS y2 FROM ranked WHERE rank_lr <= {K} AND rank_rl <= {K}),
shifted AS (SELECT *, floor(x1 * {GRID} + CASE WHEN shift IN (2, 4) THEN 0.5 ELSE 0 END)::INT AS lx, floor(y1 * {GRID} + CASE WHEN shift IN (3, 4) THEN 0.5 ELSE 0 END)::INT AS ly, floor(x2 * {GRID})::INT AS rx, floor(y2 * {GRID})::INT AS ry FROM pts, (VALUES (1), (2), (3), (4)) s(shift)),
cell AS (SELECT pair_idx, left_idx, right_idx, shift, lx + ly * {GRID} AS left_cell, rx + ry * {GRID} AS right_cell FROM shifted WHERE lx >= CASE WHEN shift IN (2, 4) THEN 1 ELSE 0 END AND ly >= CASE WHEN shift IN (3, 4) THEN 1 ELSE 0 END AND lx < {GRID} AND ly < {GRID} AND rx >= 0 AND ry >= 0 AND rx < {GRID} AND ry < {GRID}),
points AS (SELECT pair_idx, shift, left_cell, count(DISTINCT left_idx) AS points FROM cell GROUP BY ALL),
stats AS (SELECT pair_idx, shift, left_cell, right_cell, least(count(DISTINCT left_idx), count(DISTINCT right_idx)) AS stat FROM cell GROUP BY ALL)"""
)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = adapters.sides(spark, sf_dir)
    at = lambda side, name, n: side.select("pair_idx", F.col("idx").alias(name), *(((F.get("raw", F.lit(i)) + 1) / 2).alias(f"{c}{n}") for i, c in enumerate("xy")))
    edges = knn.mutual_knn(left, right, K).join(at(left, "left_idx", 1), ["pair_idx", "left_idx"]).join(at(right, "right_idx", 2), ["pair_idx", "right_idx"])
    return gridfilter.cells(edges, GRID)


@registered(f"WITH {CELLS} SELECT pair_idx, shift::INT AS shift, left_cell, right_cell, stat, points FROM stats JOIN points USING (pair_idx, shift, left_cell)")
def grid_cell_statistics(spark, sf_dir):
    return gridfilter.cell_statistics(_cells(spark, sf_dir))


@registered(
    f"""WITH {CELLS}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_idx, shift, left_cell ORDER BY stat DESC, right_cell) AS n FROM stats) WHERE n = 1),
o AS (SELECT dx, dy FROM (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)),
near AS (SELECT pair_idx, shift, left_cell, right_cell, left_cell % {GRID} + dx AS lx, left_cell // {GRID} + dy AS ly, right_cell % {GRID} + dx AS rx, right_cell // {GRID} + dy AS ry FROM best, o),
inside AS (SELECT *, lx + ly * {GRID} AS nl, rx + ry * {GRID} AS nr FROM near WHERE lx BETWEEN 0 AND {GRID - 1} AND ly BETWEEN 0 AND {GRID - 1} AND rx BETWEEN 0 AND {GRID - 1} AND ry BETWEEN 0 AND {GRID - 1}),
total AS (SELECT i.pair_idx, i.shift, i.left_cell, i.right_cell, coalesce(sum(s.stat), 0) AS score, coalesce(sum(p.points), 0) AS points, count(*) AS cells FROM inside i
  LEFT JOIN stats s ON s.pair_idx = i.pair_idx AND s.shift = i.shift AND s.left_cell = i.nl AND s.right_cell = i.nr LEFT JOIN points p ON p.pair_idx = i.pair_idx AND p.shift = i.shift AND p.left_cell = i.nl GROUP BY ALL),
good AS (SELECT * FROM total WHERE score >= 0.7 * sqrt(points // cells))
SELECT c.pair_idx, c.left_idx, c.right_idx, bool_or(g.score IS NOT NULL) AS inlier FROM cell c LEFT JOIN good g USING (pair_idx, shift, left_cell, right_cell) GROUP BY c.pair_idx, c.left_idx, c.right_idx"""
)
def grid_neighbourhood_support(spark, sf_dir):
    placed = _cells(spark, sf_dir)
    return gridfilter.inliers(placed, gridfilter.supported_cells(gridfilter.cell_statistics(placed), GRID, factor=0.7))


@registered()
def grid_filter_exact(spark, sf_dir):
    """The exact filter, with maximum matchings, scales and rotations."""
    left, right = adapters.sides(spark, sf_dir)
    at = lambda side, name, n: side.select("pair_idx", F.col("idx").alias(name), *(((F.get("raw", F.lit(i)) + 1) / 2).alias(f"{c}{n}") for i, c in enumerate("xy")))
    edges = knn.mutual_knn(left, right, K).join(at(left, "left_idx", 1), ["pair_idx", "left_idx"]).join(at(right, "right_idx", 2), ["pair_idx", "right_idx"])
    return gridfilter.filter_exact(edges.select("pair_idx", "left_idx", "right_idx", "x1", "y1", "x2", "y2", "k"), GRID, 0.7, with_scale=True, with_rotation=True)


# ---------------------------------------------------------------- scores
@registered(f"WITH {GRAPH} SELECT pair_idx, hid, left_idx, right_idx, round(r2, 6) AS r2, inlier FROM scored")
def sampson_residual(spark, sf_dir):
    return _scored(spark, sf_dir)[1].select("pair_idx", "hid", "left_idx", "right_idx", r6("r2"), "inlier")


@registered(f"WITH {GRAPH} SELECT pair_idx, hid, round(hcm, 6) AS hcm FROM hcm")
def hcm_score(spark, sf_dir):
    edges, scored = _scored(spark, sf_dir)
    return scoring.hcm(scored, edges).select("pair_idx", "hid", r6("hcm"))


@registered(f"WITH {GRAPH} SELECT pair_idx, hid, round(avg(CASE WHEN inlier THEN r2 / 0.0001::DOUBLE ELSE 1 END), 6) AS msac FROM scored GROUP BY ALL")
def msac_cost(spark, sf_dir):
    return scoring.msac(_scored(spark, sf_dir)[1], 0.01).select("pair_idx", "hid", r6("msac"))


@registered(
    f"""WITH {GRAPH}, pool AS (SELECT *, row_number() OVER (PARTITION BY pair_idx ORDER BY round(hcm, 9), hid) AS place FROM hcm QUALIFY place <= 2), cut AS (SELECT pair_idx, max(hcm) AS cutoff FROM pool GROUP BY ALL)
SELECT pair_idx, h.hid, round(round(h.hcm, 9), 6) AS hcm, p.place, round(h.hcm, 9) < round(c.cutoff, 9) AS admitted FROM hcm h LEFT JOIN pool p USING (pair_idx, hid) JOIN cut c USING (pair_idx)"""
)
def hypothesis_pool_topn(spark, sf_dir):
    """Each hypothesis with its place in a pool of two, and whether it would enter that pool as a newcomer (scores rounded to 9 digits, as sums differ by order)."""
    edges, scored = _scored(spark, sf_dir)
    scores = scoring.hcm(scored, edges).withColumn("hcm", F.round("hcm", 9))
    pooled = scoring.pool(scores, 2)
    asked = scoring.would_enter(scores, pooled, 2)
    return asked.join(pooled.select("pair_idx", "hid", "place"), ["pair_idx", "hid"], "left").select("pair_idx", "hid", r6("hcm"), F.col("place").cast("long").alias("place"), "admitted")


@registered()
def mcm_rerank(spark, sf_dir):
    """The pool's winner by one-to-one inliers."""
    edges, scored = _scored(spark, sf_dir)
    return scoring.rerank(scoring.pool(scoring.hcm(scored, edges), 3), scoring.mcm(scored)).select("pair_idx", "hid", r6("hcm"), "cardinality", "place")


@registered()
def ransac_pose(spark, sf_dir):
    """The search on each pair's whole association graph: status, counts and the winner's pose and score."""
    edges = scoring.with_prior(_graph(spark, sf_dir)).withColumn("pair_idx", F.col("pair_idx").cast("long"))
    found = ransac.estimate(edges, least_iterations=1000, most_iterations=10_000)
    return found.drop("trace", *ransac.TIMES)


@registered()
def bipartite_max_matching(spark, sf_dir):
    """A maximum matching of each pair's association graph."""
    return graph.max_matching(_edges(spark, sf_dir), ["pair_idx"])


@registered()
def progressive_degree_cap(spark, sf_dir):
    edges = _edges(spark, sf_dir).withColumn("ordinal", knn.ordinal())
    return graph.progressive_degree_cap(edges, 100).select("pair_idx", "left_idx", "right_idx", F.col("ordinal").cast("long").alias("ordinal"))


@registered(f"WITH {EDGES} SELECT pair_idx, left_idx, right_idx, k, place FROM placed WHERE place <= 50")
def head_in_order(spark, sf_dir):
    edges = _edges(spark, sf_dir).withColumn("place", knn.ordinal()).filter("place <= 50")
    return edges.select("pair_idx", "left_idx", "right_idx", F.col("k").cast("long").alias("k"), F.col("place").cast("long").alias("place"))


@registered(
    f"""WITH {EDGES}, l AS (SELECT DISTINCT label AS pair_idx FROM embeddings UNION SELECT unnest([997, 998, 999])), m AS (SELECT pair_idx, left_idx, right_idx, k FROM edges UNION ALL SELECT 998, -1, 1, 1 UNION ALL SELECT 997, NULL, 1, 1),
n AS (SELECT l.pair_idx, count(m.pair_idx) AS n, bool_or(m.left_idx IS NULL AND m.pair_idx IS NOT NULL) AS short, coalesce(bool_or(m.left_idx < 0), false) AS negative, least(count(DISTINCT CASE WHEN k <= 2 THEN left_idx END), count(DISTINCT CASE WHEN k <= 2 THEN right_idx END)) AS o2o FROM l LEFT JOIN m USING (pair_idx) GROUP BY l.pair_idx)
SELECT pair_idx, n, CASE WHEN n = 0 THEN 'missing_match_file' WHEN pair_idx % 5 = 4 THEN 'missing_pose_intrinsics' WHEN short THEN 'missing_m2m_metadata' WHEN negative THEN 'invalid_feature_ids' WHEN n < 60 THEN 'not_enough_matches' WHEN o2o < 17 THEN 'proposal_graph_not_enough_o2o' END AS reason FROM n"""
)
def skip_reasons(spark, sf_dir):
    """Why pairs are skipped: by pose file, ids and sizes, and by the distinct ends of the graph that samples come from."""
    pairs = adapters.keypoints(spark, sf_dir).select("pair_idx").union(spark.range(997, 1000).select(F.col("id").cast("int"))).distinct()
    broken = spark.createDataFrame([(998, -1, 1, 1), (997, None, 1, 1)], "pair_idx int, left_idx long, right_idx long, k int")
    edges = _edges(spark, sf_dir).select("pair_idx", "left_idx", "right_idx", "k").unionByName(broken)
    return checks.skip_reasons(pairs, edges, 60, poses=pairs.filter("pair_idx % 5 <> 4"), least_o2o=17, proposal_k=2)
