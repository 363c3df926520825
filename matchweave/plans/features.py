"""Queries from feature maps and cameras: descriptors at keypoints, un-projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.functions import geometry as g
from matchweave.operators import gather
from matchweave.plans.registry import r6, registered
from matchweave.sources import adapters

#: Maps of SIDE x SIDE patches of PATCH pixels, made of consecutive vectors; the size of the source image of a resized one.
SIDE, PATCH, SOURCE = 4, 8, (24, 40)
CELLS, EDGE = SIDE * SIDE, SIDE * PATCH


def _maps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, maps, patches): every CELLS vectors are a map, as far as it is complete; each vector is a point too, by its first two numbers."""
    e = adapters.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / CELLS).alias("image"), (F.col("vec_id") % CELLS).alias("cell"), F.col("vec_id").alias("kp_idx"), F.col("embedding").alias("v"))
    whole = e.groupBy("image").agg(F.countDistinct("cell").alias("n")).filter(f"n = {CELLS}").select("image")
    n = lambda value: F.lit(value)
    maps = whole.select("image", n(PATCH).alias("patch_size"), n(SIDE).alias("grid_h"), n(SIDE).alias("grid_w"), n(SOURCE[0]).alias("source_h"), n(SOURCE[1]).alias("source_w"), n(EDGE).alias("resized_h"), n(EDGE).alias("resized_w"))
    share = lambda i: 0.5 + 1.2 * F.get("v", F.lit(i)).cast("double")
    return e.select("image", "kp_idx", share(0).alias("x"), share(1).alias("y")), maps, e.select("image", (F.col("cell") % SIDE).alias("gx"), F.floor(F.col("cell") / SIDE).alias("gy"), "v")


def _summary(found: DataFrame) -> DataFrame:
    """First and last number, and the sum of all by their places."""
    weighted = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return found.select("image", "kp_idx", r6("x"), r6("y"), r6(F.element_at("v", 1), "first"), r6(F.element_at("v", -1), "last"), r6(weighted, "weighted"))


def _sampled(width: int, height: int, place: str) -> str:
    """SQL of a sampling query: the image's size in the points' frame, and the place on the grid of a coordinate in it."""
    u, v = place.format(c="x", size=width), place.format(c="y", size=height)
    return f"""WITH e AS (SELECT vec_id // {CELLS} AS image, vec_id % {CELLS} AS cell, vec_id AS kp_idx, embedding AS v FROM embeddings),
whole AS (SELECT image FROM e GROUP BY image HAVING count(DISTINCT cell) = {CELLS}),
p AS (SELECT image, kp_idx, {width} * (0.5 + 1.2::DOUBLE * v[1]::DOUBLE) AS x, {height} * (0.5 + 1.2::DOUBLE * v[2]::DOUBLE) AS y FROM e JOIN whole USING (image)),
q AS (SELECT *, {u} AS u, {v} AS v FROM p), c AS (SELECT q.*, dx, dy, (CASE dx WHEN 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE dy WHEN 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS weight
  FROM q, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy) WHERE u BETWEEN 0 AND {SIDE - 1} AND v BETWEEN 0 AND {SIDE - 1}),
s AS (SELECT c.image, c.kp_idx, c.x, c.y, d, sum(c.weight * e.v[d]::DOUBLE) AS s FROM c JOIN e ON e.image = c.image AND e.cell = least(floor(c.v) + dy, {SIDE - 1}) * {SIDE} + least(floor(c.u) + dx, {SIDE - 1}), generate_series(1, 64) g(d) WHERE c.weight > 0 GROUP BY ALL),
n AS (SELECT *, s / greatest(sqrt(sum(s * s) OVER (PARTITION BY image, kp_idx)), 1e-12) AS z FROM s)
SELECT image, kp_idx, round(x, 6) AS x, round(y, 6) AS y, round(max(z) FILTER (d = 1), 6) + 0 AS first, round(max(z) FILTER (d = 64), 6) + 0 AS last, round(sum(d * z), 6) + 0 AS weighted FROM n GROUP BY ALL"""


@registered(_sampled(EDGE, EDGE, "({c} / %d::DOUBLE - 0.5)" % PATCH))
def descriptor_sampling(spark, sf_dir):
    """Descriptors at points in the maps' own pixels."""
    points, maps, patches = _maps(spark, sf_dir)
    return _summary(gather.descriptors_at(points.withColumns({c: F.col(c) * EDGE for c in "xy"}), maps, patches))


@registered(_sampled(SOURCE[1], SOURCE[0], "(({c} + 0.5) * (%d / {size}::DOUBLE) / %d - 0.5)" % (EDGE, PATCH)))
def descriptor_sampling_resized(spark, sf_dir):
    """Descriptors at points in the pixels of source images that were resized to the maps."""
    points, maps, patches = _maps(spark, sf_dir)
    return _summary(gather.descriptors_at(points.withColumns({"x": F.col("x") * SOURCE[1], "y": F.col("y") * SOURCE[0]}), maps, patches, "resized"))


#: Coefficients of the lenses of the round trip: of parts, none, four or eight by their key.
_LENS = """SELECT p_partkey, p_partkey % 3 AS kind, (p_partkey * 37 % 201 - 100) / 160::DOUBLE AS x, (p_partkey * 53 % 201 - 100) / 200::DOUBLE AS y, 600 + p_size::DOUBLE AS fx, 650 - p_size::DOUBLE AS fy, p_size / 200::DOUBLE AS k1, -(p_partkey % 7) / 100::DOUBLE AS k2,
(p_partkey % 5 - 2) / 1000::DOUBLE AS p1, (p_partkey % 9 - 4) / 1000::DOUBLE AS p2, (p_partkey % 4) / 200::DOUBLE AS k3, p_size / 400::DOUBLE AS k4, (p_partkey % 6) / 300::DOUBLE AS k5, (p_partkey % 3) / 500::DOUBLE AS k6 FROM part"""


@registered(
    f"""WITH l AS ({_LENS}), k AS (SELECT p_partkey, x, y, fx, fy, kind, CASE WHEN kind = 0 THEN 0 ELSE k1 END AS k1, CASE WHEN kind = 0 THEN 0 ELSE k2 END AS k2, CASE WHEN kind = 0 THEN 0 ELSE p1 END AS p1, CASE WHEN kind = 0 THEN 0 ELSE p2 END AS p2,
  CASE WHEN kind = 2 THEN k3 ELSE 0 END AS k3, CASE WHEN kind = 2 THEN k4 ELSE 0 END AS k4, CASE WHEN kind = 2 THEN k5 ELSE 0 END AS k5, CASE WHEN kind = 2 THEN k6 ELSE 0 END AS k6, x * x + y * y AS r2 FROM l),
d AS (SELECT *, (1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2) / (1 + k4 * r2 + k5 * r2 * r2 + k6 * r2 * r2 * r2) AS radial FROM k)
SELECT p_partkey, round(fx * (x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)) + 320, 6) AS u, round(fy * (y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y) + 240, 6) AS v, round(x, 6) AS x, round(y, 6) AS y, true AS exact FROM d"""
)
def unprojection_round_trip(spark, sf_dir):
    """Points through cameras with none, four or eight coefficients and back: the pixel, the point again, and whether it is the same to 1e-9."""
    p = adapters.table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size").cast("double")
    turn = lambda n, less, by: (key % n - less) / F.lit(float(by))
    four = [size / 200, -(key % 7) / F.lit(100.0), turn(5, 2, 1000), turn(9, 4, 1000)]
    eight = four + [turn(4, 0, 200), size / 400, turn(6, 0, 300), turn(3, 0, 500)]
    lens = F.when(key % 3 == 0, F.array().cast("array<double>")).when(key % 3 == 1, F.array(*four)).otherwise(F.array(*eight))
    camera = lambda: (F.col("fx"), F.col("fy"), F.lit(320.0), F.lit(240.0), F.col("lens"))
    points = p.select("p_partkey", ((key * 37 % 201 - 100) / F.lit(160.0)).alias("x"), ((key * 53 % 201 - 100) / F.lit(200.0)).alias("y"), (600 + size).alias("fx"), (650 - size).alias("fy"), lens.alias("lens"))
    seen = points.withColumn("seen", g.project(F.col("x"), F.col("y"), *camera()))
    back = seen.withColumn("back", g.unproject(F.col("seen.x"), F.col("seen.y"), *camera()))
    return back.select("p_partkey", r6(F.col("seen.x"), "u"), r6(F.col("seen.y"), "v"), r6(F.col("back.x"), "x"), r6(F.col("back.y"), "y"), (F.greatest(F.abs(F.col("back.x") - F.col("x")), F.abs(F.col("back.y") - F.col("y"))) < 1e-9).alias("exact"))
