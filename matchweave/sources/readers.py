"""Scans with explicit schemas, and sinks.  Problems of one pair's rows mark that pair, never the whole read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchweave.sources.datasets import same_schema

#: Names that a column of an association file may have, the first one found counts.
ALIASES = {"left_idx": ("left_idx", "idx1", "feature_idx1", "feature1"), "right_idx": ("right_idx", "idx2", "feature_idx2", "feature2"), "similarity": ("similarity", "sim", "score"), "k": ("k", "k_first")}
ASSOCIATION = "left_idx int, right_idx int, x1 double, y1 double, x2 double, y2 double, similarity double, k int"


def pair_list(spark: SparkSession, path: str, most: int = 0) -> DataFrame:
    """(pair_idx, image_1, image_2) of a CSV, TSV or blank-separated list: ``#`` comments and a header are skipped, ids are the first of
    three fields or else the number of the line; sorted by id.  ``most`` cuts before the sort."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    lines = lines.filter(~F.trim("value").rlike("^(#.*)?$")).withColumn("f", F.filter(F.split(F.trim("value"), r"\s*[,\t]\s*|\s+"), lambda x: x != ""))
    lines = lines.filter(~F.lower(F.element_at("f", 1)).isin("pair_index", "pair_idx", "image_1", "left", "image1"))
    # a line's number: its place in its block of the file, after all lines of the blocks before (one row for each block)
    blocks = lines.groupBy("_file", "_block").agg(F.count("*").alias("_n"))
    blocks = blocks.select("_file", "_block", (F.sum("_n").over(Window.orderBy("_file", "_block")) - F.col("_n")).alias("_ahead"))
    numbered = lines.withColumn("_place", F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_id"))).join(blocks, ["_file", "_block"]).withColumn("n", F.col("_ahead") + F.col("_place"))
    if most:
        numbered = numbered.filter(F.col("n") <= most)
    explicit = (F.size("f") >= 3) & F.element_at("f", 1).rlike(r"^\d+$")
    return numbered.select(F.when(explicit, F.element_at("f", 1).cast("long")).otherwise(F.col("n") - 1).alias("pair_idx"), F.when(explicit, F.get("f", F.lit(1))).otherwise(F.get("f", F.lit(0))).alias("image_1"), F.when(explicit, F.get("f", F.lit(2))).otherwise(F.get("f", F.lit(1))).alias("image_2")).orderBy("pair_idx")


def associations(spark: SparkSession, path: str) -> DataFrame:
    """Association files with a header (``..._<pair number>.csv``): pair_idx, line, the columns of ASSOCIATION, and ``bad``, why a row is not valid."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"(\d+)\.csv$", 1).cast("long").alias("pair_idx"), F.split(F.regexp_replace("value", r"\s+$", ""), "\r?\n").alias("lines"))
    lines = lines.select("pair_idx", F.transform(F.split(F.get("lines", F.lit(0)), ","), lambda x: F.trim(x)).alias("header"), F.posexplode(F.slice("lines", 2, 1 << 30)).alias("line", "text"))
    fields = F.split("text", ",", -1)

    def value(name: str):
        places = [F.array_position("header", a) for a in ALIASES.get(name, (name,))]
        return F.coalesce(*(F.when(p > 0, F.get(F.col("fields"), p.cast("int") - 1)) for p in places))

    rows = lines.withColumn("fields", fields)
    kinds = [c.split() for c in ASSOCIATION.split(", ")]
    texts = {n: F.trim(value(n)) for n, _ in kinds}
    cast = {n: (F.when(texts[n].rlike(r"^[+-]?\d+$"), texts[n].try_cast("int")) if t == "int" else texts[n].try_cast("double")) for n, t in kinds}
    parsed = rows.select("pair_idx", "line", (F.size("fields") != F.size("header")).alias("_width"), *(cast[n].alias(n) for n, _ in kinds))
    missing = F.array_compact(F.array(*(F.when(F.col(n).isNull() | (F.isnan(n) if t == "double" else F.lit(False)), F.lit(n)) for n, t in kinds)))
    bad = F.when(F.col("_width"), "wrong number of fields").when(F.size(missing) > 0, F.concat(F.lit("invalid "), F.array_join(missing, ", "))).when((F.col("left_idx") < 0) | (F.col("right_idx") < 0), "negative id").when(F.col("k") < 1, "k below 1")
    return parsed.withColumn("bad", bad).drop("_width")


def association_audit(rows: DataFrame) -> DataFrame:
    """Per pair of ``associations``: rows, distinct edges, rows that are not valid, and whether all is well."""
    fine = F.col("bad").isNull()
    counted = rows.groupBy("pair_idx").agg(F.count("*").alias("rows"), F.countDistinct(F.when(fine, F.struct("left_idx", "right_idx"))).alias("edges"), F.sum((~fine).cast("long")).alias("invalid"))
    return counted.withColumn("valid", (F.col("invalid") == 0) & (F.col("edges") == F.col("rows")))


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of pairs without a bad row, the pairs that have one with the first reason and how many): what goes on and what is incomplete."""
    broken = rows.filter("bad IS NOT NULL").groupBy("pair_idx").agg(F.min_by("bad", "line").alias("reason"), F.count("*").alias("rows"))
    return rows.join(broken.select("pair_idx"), "pair_idx", "left_anti"), broken


def poses(spark: SparkSession, path: str) -> DataFrame:
    """Pose and intrinsics files; quoted distortion lists become arrays, f1 and f2 stand for both axes.  ``problem``: an id that occurs twice or is
    none, a number that is missing, a distortion of other than 0, 4 or 8 coefficients; null for a sound row."""
    raw = spark.read.option("header", True).option("quote", '"').csv(path)
    number = lambda n: F.coalesce(*(F.col(c).try_cast("double") for c in n if c in raw.columns)) if any(c in raw.columns for c in n) else F.lit(None).cast("double")
    names = ["qw", "qx", "qy", "qz", "tx", "ty", "tz", "cx1", "cy1", "cx2", "cy2"]
    focal = {f"f{a}{s}": (f"f{a}{s}", f"f{s}") for a in "xy" for s in "12"}
    listed = lambda c: F.transform(F.filter(F.split(F.regexp_replace(c, r"[\[\]\s]", ""), ","), lambda x: x != ""), lambda x: x.try_cast("double")) if c in raw.columns else F.array().cast("array<double>")
    read = raw.select(F.col("pair_idx").try_cast("long").alias("pair_idx"), *(number((n,)).alias(n) for n in names), *(number(v).alias(k) for k, v in focal.items()), *(F.coalesce(listed(c), F.array().cast("array<double>")).alias(c) for c in ("distortion1", "distortion2")))
    copies = read.groupBy("pair_idx").agg(F.count("*").alias("_copies"))
    lost = F.array_compact(F.array(*(F.when(F.col(n).isNull() | F.isnan(n), F.lit(n)) for n in (*names, *focal))))
    odd = lambda c: ~F.size(c).isin(0, 4, 8) | F.exists(c, lambda x: x.isNull())
    problem = F.when(F.col("pair_idx").isNull(), "no id").when(F.col("_copies") > 1, "id twice").when(F.size(lost) > 0, F.concat(F.lit("missing "), F.array_join(lost, ", "))).when(odd("distortion1") | odd("distortion2"), "distortion")
    return read.join(copies, read["pair_idx"].eqNullSafe(copies["pair_idx"])).drop(copies["pair_idx"]).withColumn("problem", problem).drop("_copies")


def write_associations(edges: DataFrame, path: str) -> None:
    """One directory of CSV for each pair, with a header; the commit protocol publishes all files or none."""
    edges.repartition("pair_idx").sortWithinPartitions("pair_idx", "k", F.desc("similarity"), "left_idx", "right_idx").write.partitionBy("pair_idx").option("header", True).mode("overwrite").csv(path)


def strict_json(rows: DataFrame) -> DataFrame:
    """One JSON object per row (column ``json``); NaN and infinities are null."""
    from matchweave.functions.geometry import finite

    fields = [F.when(finite(F.col(f.name)), F.col(f.name)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in rows.schema.fields]
    return rows.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def write_rank_shards(shards: DataFrame, path: str) -> None:
    """The long form of ranked candidates, by bin and layer, so that reads prune to what they need."""
    shards.write.partitionBy("bin", "layer").mode("overwrite").parquet(path)


def write_long_table(rows: DataFrame, path: str) -> None:
    """A long table as compressed CSV with a header."""
    rows.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def append_new(results: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the results whose keys the table lacks; returns how many.  A table of other columns or types is an error, and nothing is written."""
    spark = results.sparkSession
    try:
        done = spark.read.parquet(path)
    except Exception as e:  # nothing has been written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    if done is not None:
        same_schema(done, results)
    fresh = (results.join(done.select(*keys).distinct(), keys, "left_anti") if done is not None else results).cache()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n
