"""The driver's tables as the relations of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.functions.vector import as_double, let, normalize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as keypoints: pair_idx, side, idx, raw vector, unit vector v, pixel and calibrated coordinates."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("pair_idx"), (F.col("vec_id") % 2).alias("side"), F.col("vec_id").alias("idx"), as_double(F.col("embedding")).alias("raw"))
    at = lambda i: F.get("raw", F.lit(i))
    return e.select("*", let(F.col("raw"), normalize).alias("v"), (512 * (at(0) + 1)).alias("x"), (512 * (at(1) + 1)).alias("y"), (0.64 * at(0)).alias("cx"), (0.64 * at(1)).alias("cy"))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = keypoints(spark, sf_dir)
    return k.filter("side = 0"), k.filter("side = 1")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as pose results."""
    o = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return o.select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("method"), (F.col("o_orderkey") % 5).alias("seed"), F.col("o_orderkey").alias("pair_idx"), F.col("o_custkey").alias("custkey"), ((cents % 4500).cast("double") / 100).alias("err"), ((cents % 360).cast("double")).alias("tr"))


def hypotheses(pairs: DataFrame, poses) -> DataFrame:
    """A small constant table of poses (hid, quaternion, translation) for each pair."""
    names = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")
    rows = F.explode(F.array(*(F.struct(F.lit(h).alias("hid"), *(F.lit(float(v)).alias(n) for n, v in zip(names, pose, strict=True))) for h, *pose in poses))).alias("h")
    return pairs.select("pair_idx").distinct().select("pair_idx", rows).select("pair_idx", "h.*")
