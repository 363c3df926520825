"""Running values along ordered rows of a key, in two levels, so that no key is ordered in one task.

Rows are dealt by ranges of (keys, order) and written with the number of their range; rows that are equal in both never part.  Inside a range
a window over (keys, range) gives the running value; what the ranges before (or behind) hold of the key is a row for each (key, range), and is carried
in by a join.  A key has at most as many such rows as there are ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchweave.sources.staging import staged

RANGE = "_range"


def in_ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """The rows as a table with the number of their range."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(rows.repartitionByRange(n, *keys, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """The join condition of equal keys, null with null."""
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[k])
    return on


def carried(dealt: DataFrame, keys: Sequence[str], summary: Mapping[str, Column], carry: Mapping[str, Callable[[Window], Column]], behind: bool = False) -> DataFrame:
    """``dealt`` with what the ranges before a row's own (``behind``: after it) hold of its key: null if there are none.

    ``summary`` names aggregates of one range; ``carry`` makes of them, over the window of the other ranges, the columns that are added.
    """
    of_range = dealt.groupBy(*keys, RANGE).agg(*(c.alias(n) for n, c in summary.items()))
    order = Window.partitionBy(*keys).orderBy(F.desc(RANGE) if behind else RANGE).rowsBetween(Window.unboundedPreceding, -1)
    brought = of_range.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(RANGE).alias("_r"), *(make(order).alias(n) for n, make in carry.items()))
    on = F.col(RANGE) == F.col("_r")
    for i, k in enumerate(keys):
        on = on & dealt[k].eqNullSafe(brought[f"_k{i}"])
    return dealt.join(brought, on, "left").drop("_r", *(f"_k{i}" for i in range(len(keys))))


def running_max(rows: DataFrame, keys: Sequence[str], x: str, y: str, name: str = "best", parts: int | None = None) -> DataFrame:
    """Each row with the greatest y at its x or before, all rows of equal x included."""
    dealt = in_ranges(rows, keys, [x], parts)
    inside = Window.partitionBy(*keys, RANGE).orderBy(x).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = carried(dealt, keys, {"_top": F.max(y)}, {"_before": lambda w: F.max("_top").over(w)})
    return found.withColumn(name, F.greatest(F.max(y).over(inside), F.col("_before"))).drop("_before", RANGE)


def last_known(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """Each row with the last value that is not null at it or before it; rows that are equal in ``order`` have no order."""
    dealt = in_ranges(rows, keys, list(order), parts)
    inside = Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    found = carried(dealt, keys, {"_last": latest}, {"_before": lambda w: F.last("_last", ignorenulls=True).over(w)})
    return found.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_before"))).drop("_before", RANGE)


def following(rows: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], parts: int | None = None) -> DataFrame:
    """Each row with ``next_<value>`` of the row behind it in its key; (keys, order) must be unique."""
    dealt = in_ranges(rows, keys, [order], parts)
    inside = Window.partitionBy(*keys, RANGE).orderBy(order)
    head = F.struct(*(F.min_by(v, order).alias(v) for v in values))
    found = carried(dealt, keys, {"_head": head}, {"_behind": lambda w: F.last("_head").over(w)}, behind=True)
    ahead = F.lead(F.struct(*values)).over(inside)
    return found.withColumn("_next", F.coalesce(ahead, F.col("_behind"))).select("*", *(F.col(f"_next.{v}").alias(f"next_{v}") for v in values)).drop("_next", "_behind", RANGE)
