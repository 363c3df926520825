"""Curves: frontier and regret, step lookup, resampling, adjacent differences.

Curves of a key may be long, so what runs along their points is a scan in two levels (``scan``).  Ranks and k of a curve are few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchweave.operators import scan


def frontier(points: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Each point with the best y at its x or before (all points of equal x included) and its regret in percentage points."""
    best = scan.running_max(points, keys, x, y)
    return best.withColumn("regret", 100.0 * (F.col("best") - F.col(y)))


def select_layer(points: DataFrame, keys: Sequence[str], layer: str, x: str, y: str) -> DataFrame:
    """Layers by mean regret, then the worst key's mean regret, then the greatest regret, then number: the first is the choice."""
    points = frontier(points, keys, x, y)
    by_key = points.groupBy(layer, *keys).agg(F.avg("regret").alias("mean"), F.max("regret").alias("max"), F.sum("regret").alias("sum"), F.count("regret").alias("n"))
    by_layer = by_key.groupBy(layer).agg((F.sum("sum") / F.sum("n")).alias("mean_regret"), F.max("mean").alias("worst_mean_regret"), F.max("max").alias("max_regret"))
    return by_layer.orderBy("mean_regret", "worst_mean_regret", "max_regret", layer)


def step_lookup(points: DataFrame, queries: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """The y of the last point at or before each query's x (an as-of lookup by one scan); null before the first.  A point's y may be null; points of one x have no order."""
    tagged = points.select(*keys, F.col(x).alias("x"), F.lit(0).alias("query"), F.struct(F.col(y).alias("y")).alias("p")).unionByName(queries.select(*keys, F.col(x).alias("x"), F.lit(1).alias("query"), F.lit(None).cast(f"struct<y:{points.schema[y].dataType.simpleString()}>").alias("p")))
    found = scan.last_known(tagged, keys, ["x", "query"], "p", "at")
    return found.filter("query = 1").select(*keys, F.col("x").alias(x), F.col("at.y").alias(y))


def resample(points: DataFrame, keys: Sequence[str], x: str, y: str, steps: int = 201) -> DataFrame:
    """Linear interpolation on an even grid over the common support of all keys; points of one x are averaged first."""
    once = points.groupBy(*keys, x).agg(F.avg(y).alias(y))
    span = once.groupBy(*keys).agg(F.min(x).alias("low"), F.max(x).alias("high")).agg(F.max("low").alias("low"), F.min("high").alias("high"))
    pieces = scan.following(once, keys, x, [x, y]).select(*keys, F.col(x).alias("x0"), F.col(y).alias("y0"), F.col(f"next_{x}").alias("x1"), F.col(f"next_{y}").alias("y1"))
    step = (F.col("high") - F.col("low")) / (steps - 1)
    # each piece makes the grid points in [x0, x1) itself, so nothing is joined by range
    first, last = F.ceil((F.greatest("x0", "low") - F.col("low")) / step), F.least(F.floor((F.coalesce("x1", "x0") - F.col("low")) / step), F.lit(steps - 1))
    numbers = F.filter(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")), lambda i: (F.col("low") + i * step >= F.col("x0")) & (F.coalesce(F.col("low") + i * step < F.col("x1"), F.col("low") + i * step <= F.col("x0"))))
    made = pieces.join(F.broadcast(span)).filter("high > low").select("*", F.explode(numbers).alias("i"))  # one row
    at = F.col("low") + F.col("i") * step
    value = F.col("y0") + F.coalesce((at - F.col("x0")) / (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.lit(0.0))
    return made.select(*keys, "i", at.alias(x), value.alias(y))


def adjacent_delta(points: DataFrame, keys: Sequence[str], rank: str, y: str) -> DataFrame:
    """Differences to the next lower rank with the same keys: mean, greatest size and mean size for each rank."""
    before = F.lag(y).over(Window.partitionBy(*keys).orderBy(rank))
    delta = points.withColumn("d", F.col(y) - before).filter("d IS NOT NULL")
    return delta.groupBy(rank).agg(F.avg("d").alias("mean"), F.max(F.abs("d")).alias("max_abs"), F.avg(F.abs("d")).alias("mae"), F.count("*").alias("n"))


def not_monotone(points: DataFrame, keys: Sequence[str], k: str, y: str) -> DataFrame:
    """Rows whose y is below that of the k before."""
    before = F.lag(y).over(Window.partitionBy(*keys).orderBy(k))
    return points.withColumn("before", before).filter(F.col(y) < F.col("before"))
