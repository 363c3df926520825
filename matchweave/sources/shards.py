"""Ranked shards with a manifest: what is stored is checked cell by cell, and only broken cells are written again.

A cell is a (bin, layer) folder of the shard table.  Its manifest row holds how many rows it has, an exclusive-or and a sum of their hashes; so a
cell that lost rows, gained some or changed a value is found by reading it, whatever wrote it.  A repair overwrites exactly the
cells that are missing or broken (dynamic partition overwrite) and afterwards checks that all others are as they were.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = ("bin", "layer")
MARKS = ("n", "mixed", "total")


class Damaged(ValueError):
    """Shards that are not what their manifest says, and may not be repaired."""


def marks(shards: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """(cell, n, mixed, total): what a manifest says of each cell's rows, in any order."""
    h = F.xxhash64(*sorted(c for c in shards.columns if c not in cell))
    return shards.groupBy(*cell).agg(F.count("*").alias("n"), F.bit_xor(h).alias("mixed"), F.sum(h.cast("decimal(38,0)")).alias("total"))


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(path)  # a torn file is a cell with fewer rows
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _manifest(spark: SparkSession, path: str, schema: DataFrame) -> DataFrame:
    try:
        return spark.read.schema(schema.schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema.schema)


def write(shards: DataFrame, path: str, cell: Sequence[str] = CELL) -> None:
    """Shards below ``path/cells`` and their manifest below ``path/manifest``, taken from what was written."""
    shards.write.partitionBy(*cell).mode("overwrite").parquet(f"{path}/cells")
    stored = shards.sparkSession.read.schema(shards.schema).parquet(f"{path}/cells")
    marks(stored, cell).write.mode("overwrite").parquet(f"{path}/manifest")


def broken(spark: SparkSession, path: str, schema: str, expected: DataFrame, cell: Sequence[str] = CELL, rules: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(cell, reason) of the expected cells that are missing, differ from their manifest or break a rule.

    ``rules`` gives the cells of the stored shards in which a rule is broken (cell columns), e.g. by ``archives.shard_problems``.
    """
    shards = _stored(spark, f"{path}/cells", schema)
    now = marks(shards, cell)
    then = _manifest(spark, f"{path}/manifest", now).select(*cell, *(F.col(m).alias(f"_{m}") for m in MARKS))
    joined = expected.select(*cell).distinct().join(now, list(cell), "left").join(then, list(cell), "left")
    same = F.lit(True)
    for m in MARKS:
        same = same & F.col(m).eqNullSafe(F.col(f"_{m}"))
    reason = F.when(F.col("n").isNull(), "missing").when(F.col("_n").isNull(), "not in the manifest").when(~same, "differs from the manifest")
    found = joined.select(*cell, reason.alias("reason")).filter("reason IS NOT NULL")
    if rules is not None:
        found = found.unionByName(rules(shards).select(*cell).distinct().join(found.select(*cell), list(cell), "left_anti").withColumn("reason", F.lit("breaks a rule")))
    return found


def repair(spark: SparkSession, path: str, schema: str, expected: DataFrame, make: Callable[[DataFrame], DataFrame], cell: Sequence[str] = CELL, rules: Callable[[DataFrame], DataFrame] | None = None) -> list[tuple]:
    """Makes the cells again that ``broken`` finds, and only these; returns them with their reasons, in order.

    ``make`` gets the cells (cell columns) and returns their shards.  Afterwards every cell must agree with the new manifest, and those that were not
    broken with the old one.  The list has a row for each cell of the shard table (bins times layers, some hundred), never one for each row of it.
    """
    found = [tuple(r) for r in broken(spark, path, schema, expected, cell, rules).orderBy(*cell).collect()]
    if not found:
        return []
    kinds = ", ".join(f"{c} {expected.schema[c].dataType.simpleString()}" for c in cell)
    cells = spark.createDataFrame([r[: len(cell)] for r in found], kinds)
    made = make(cells)
    columns = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    made.select(*columns).write.partitionBy(*cell).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/cells")
    now = marks(_stored(spark, f"{path}/cells", schema), cell)
    old = _manifest(spark, f"{path}/manifest", now)
    others = old.join(cells, list(cell), "left_anti")
    changed = others.exceptAll(now.select(*others.columns))
    if not changed.isEmpty():
        raise Damaged("cells changed that were not to be repaired: " + ", ".join(map(str, (tuple(r)[: len(cell)] for r in changed.limit(5).collect()))))
    rows = [tuple(r) for r in now.join(expected.select(*cell).distinct(), list(cell), "left_semi").select(*cell, *MARKS).collect()]  # one for each cell
    spark.createDataFrame(rows, now.select(*cell, *MARKS).schema).write.mode("overwrite").parquet(f"{path}/manifest")
    still = broken(spark, path, schema, expected, cell, rules)
    if not still.isEmpty():
        raise Damaged("cells are broken after the repair: " + ", ".join(map(str, map(tuple, still.limit(5).collect()))))
    return found
