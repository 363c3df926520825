"""Pose metrics, report tables and recall curves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchweave.functions.geometry import finite, pose_error, rotation_error, translation_error, unit_quaternion

FAILED = 180.0


def auc(error: Column, threshold: float) -> Column:
    """Area under recall against error up to a threshold, in percent, as one aggregate: ``100 / (n T) * (sum(T - e) + max(e) / 2)`` over errors below T."""
    below = F.when(error < threshold, error)
    return 100.0 / (F.count("*") * threshold) * (F.coalesce(F.sum(threshold - below), F.lit(0.0)) + 0.5 * F.coalesce(F.max(below), F.lit(0.0)))


def auc_table(results: DataFrame, keys: Sequence[str], thresholds: Sequence[float] = (5.0, 10.0, 20.0), error: str = "err") -> DataFrame:
    """(keys, threshold, auc, pairs), one row for each threshold."""
    wide = results.groupBy(*keys).agg(F.count("*").alias("pairs"), *(auc(F.col(error), t).alias(f"auc_{i}") for i, t in enumerate(thresholds)))
    rows = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"auc_{i}").alias("auc")) for i, t in enumerate(thresholds)))).alias("r")
    return wide.select(*keys, "pairs", rows).select(*keys, "r.threshold", "r.auc", "pairs")


def macro(table: DataFrame, keys: Sequence[str], over: str, value: str, name: str = "Macro") -> DataFrame:
    """The table with one more row for each key: the plain mean over ``over``."""
    mean = table.groupBy(*keys).agg(F.avg(value).alias(value)).withColumn(over, F.lit(name))
    return table.select(*keys, over, value).unionByName(mean.select(*keys, over, value))


def seed_summary(table: DataFrame, keys: Sequence[str], value: str, single: float | None = 0.0) -> DataFrame:
    """Mean, sample deviation (``single`` where there is one seed), least, greatest and number over seeds."""
    return table.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(single)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("seeds"))


def align(expected: DataFrame, results: DataFrame, key: str = "pair_idx") -> DataFrame:
    """The expected ids with their pose error; failed where the result is missing or not finite."""
    joined = expected.select(key).join(results, key, "left")
    return joined.select(key, pose_error(F.col("rotation_error_deg"), F.col("translation_error_deg"), FAILED).alias("err"))


def align_by_position(results: DataFrame, total: int) -> DataFrame:
    """Errors by row position (``ordinal`` from 1): missing positions fail, further ones are cut off."""
    places = results.sparkSession.range(1, total + 1).withColumnRenamed("id", "ordinal")
    return places.join(results, "ordinal", "left").select("ordinal", pose_error(F.col("rotation_error_deg"), F.col("translation_error_deg"), FAILED).alias("err"))


def paired_delta(table: DataFrame, keys: Sequence[str], by: str, baseline, value: str) -> DataFrame:
    """Each row's value less the baseline's with the same keys; two baselines for one key are an error when it is read."""
    base = table.filter(F.col(by) == baseline).groupBy(*keys).agg(F.max(value).alias("baseline"), F.count("*").alias("_n"))
    base = base.select(*keys, F.when(F.col("_n") > 1, F.raise_error(F.lit("several baselines for one key")).cast("double")).otherwise(F.col("baseline")).alias("baseline"))
    return table.join(base, list(keys)).withColumn("delta", F.col(value) - F.col("baseline"))


def pivot_delta(table: DataFrame, keys: Sequence[str], by: str, proposed, baseline, value: str, pairs: str | None = None) -> DataFrame:
    """Proposed less baseline side by side, for keys that have both; where the column ``pairs`` is named, both must have the same number."""
    wide = table.groupBy(*keys).pivot(by, [proposed, baseline]).agg(F.first(value))
    p, b = F.col(f"`{proposed}`"), F.col(f"`{baseline}`")
    if pairs:
        counts = table.filter(F.col(by).isin(proposed, baseline)).groupBy(*keys).agg(F.countDistinct(pairs).alias("_n"))
        wide = wide.join(counts, list(keys))
        p = F.when(F.col("_n") > 1, F.raise_error(F.lit("the two were measured on different numbers of pairs")).cast("double")).otherwise(p)
    return wide.filter(p.isNotNull() & b.isNotNull()).select(*keys, p.alias("proposed"), b.alias("baseline"), (p - b).alias("delta"))


def percentiles(table: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], buckets: int = 64) -> DataFrame:
    """(keys, share, value): exact percentiles with linear interpolation, of values that are not null.

    A sketch of each key cuts its values into ``buckets`` of about one size; counts of the buckets tell in which the wanted ranks
    lie, and only these are ordered, each by itself.  So no task holds a key's values, however few keys there are.
    """
    rows = table.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], 20 * buckets).alias("_cuts"), F.count("*").alias("_n"))
    ranks = F.explode(F.array(*(F.struct(F.lit(float(p)).alias("share"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("at")) for p in shares)))
    wanted = cuts.select(*keys, ranks.alias("_r")).select(*keys, F.col("_r.share").alias("_share"), F.col("_r.at").alias("_at"), F.floor("_r.at").alias("_low"), F.ceil("_r.at").alias("_high"))
    counted = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_c")).join(cuts, list(keys)).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts", "_n")
    sizes = counted.groupBy(*keys, "_b").agg(F.sum("_c").alias("_s"))
    ahead = sizes.withColumn("_ahead", F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_s"))  # as many rows as buckets
    asked = wanted.select(*keys, F.explode(F.array_distinct(F.array("_low", "_high"))).alias("_rank")).distinct()
    hit = asked.join(ahead, list(keys)).filter((F.col("_rank") >= F.col("_ahead")) & (F.col("_rank") < F.col("_ahead") + F.col("_s"))).select(*keys, "_b", "_ahead", "_rank")
    inside = counted.join(hit.select(*keys, "_b", "_ahead").distinct(), [*keys, "_b"])
    placed = inside.withColumn("_end", F.col("_ahead") + F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_v")))
    found = hit.drop("_ahead").join(placed.select(*keys, "_b", "_v", "_c", "_end"), [*keys, "_b"]).filter((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_c"))).select(*keys, "_rank", "_v")
    ends = [found.select(*keys, F.col("_rank").alias(name), F.col("_v").alias(f"{name}_v")) for name in ("_low", "_high")]
    both = wanted.join(ends[0], [*keys, "_low"]).join(ends[1], [*keys, "_high"])
    between = F.col("_low_v") + (F.col("_at") - F.col("_low")) * (F.col("_high_v") - F.col("_low_v"))
    return both.select(*keys, F.col("_share").alias("share"), between.alias("value"))


def percentile_columns(table: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """``percentiles`` with a column for each named share."""
    return percentiles(table, keys, value, tuple(shares.values())).groupBy(*keys).agg(*(F.max(F.when(F.col("share") == p, F.col("value"))).alias(n) for n, p in shares.items()))


def runtime(table: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, median and 95th percentile (linear interpolation) of finite values, with coverage."""
    x = F.when(finite(F.col(value)), F.col(value))
    fine = table.withColumn(value, x)
    means = fine.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("covered"), F.count("*").alias("rows"))
    at = percentiles(fine, keys, value, (0.5, 0.95)).groupBy(*keys).agg(*(F.max(F.when(F.col("share") == p, F.col("value"))).alias(n) for p, n in ((0.5, "median"), (0.95, "p95"))))
    return means.join(at, list(keys), "left").select(*keys, "mean", "median", "p95", "covered", "rows")


def runtime_wide(table: DataFrame, keys: Sequence[str], by: str, variants: Sequence[str], value: str, factor: float = 1000.0) -> DataFrame:
    """One column for each of the variants, in other units; only keys that have exactly these."""
    mean = table.groupBy(*keys, by).agg((F.avg(value) * factor).alias("v"))
    wide = mean.groupBy(*keys).agg(F.collect_set(by).alias("_have"), *(F.max(F.when(F.col(by) == v, F.col("v"))).alias(str(v)) for v in variants))
    return wide.filter(F.array_sort("_have") == F.array_sort(F.array(*map(F.lit, variants)))).drop("_have")


def finite_mean(value: Column) -> Column:
    """Mean of the finite values; null if there are none."""
    return F.avg(F.when(finite(value), value))


def hierarchical_mean(rows: DataFrame, levels: Sequence[str], value: str) -> DataFrame:
    """Mean of means: from the rows to the finest level, then each level's mean to the one above; ``levels`` from coarse to fine."""
    now = rows.select(*levels, F.when(finite(F.col(value)), F.col(value)).alias("v"))
    for depth in range(len(levels), 0, -1):
        now = now.groupBy(*levels[:depth]).agg(F.avg("v").alias("v"))
    return now.select(levels[0], F.col("v").alias("mean"))


def threshold_mean(table: DataFrame, keys: Sequence[str], thresholds: Sequence[float], value: str) -> DataFrame:
    """Mean over the exact set of thresholds; null where one is missing, extra or not finite."""
    n = len(set(thresholds))
    have = F.array_sort(F.collect_set("threshold")) == F.array_sort(F.array(*(F.lit(float(t)) for t in thresholds)))
    fine = F.count(F.when(finite(F.col(value)), 1)) == n
    return table.groupBy(*keys).agg(F.when(have & fine & (F.count("*") == n), F.avg(value)).alias("mean"))


def recall_at_k(candidates: DataFrame, sources: DataFrame, thresholds: Sequence[float], ks: Sequence[int], keys: Sequence[str] = ("pair_idx",)) -> DataFrame:
    """Shares of sources with a correct candidate among the first K, and among those that are mutual by K.

    candidates: keys, left_idx, rank_lr, entry_k, error.  sources: keys, left_idx, min_error.  A candidate is
    correct below the threshold; ``n_gt`` counts sources whose smallest error is below it.
    """
    levels = F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold")
    first = candidates.select(*keys, "left_idx", "rank_lr", "entry_k", "error", levels).filter("error < threshold").groupBy(*keys, "left_idx", "threshold").agg(F.min("rank_lr").alias("direct"), F.min("entry_k").alias("mutual"))
    whole = sources.select(*keys, "left_idx", "min_error", levels).join(first, [*keys, "left_idx", "threshold"], "left")
    at = F.explode(F.array(*map(F.lit, ks))).alias("k")
    counted = whole.select("*", at).groupBy(*keys, "threshold", "k").agg(F.count("*").alias("n_source"), F.sum((F.col("min_error") < F.col("threshold")).cast("long")).alias("n_gt"), F.sum(F.when(F.col("direct") <= F.col("k"), 1).otherwise(0)).alias("n_direct"), F.sum(F.when(F.col("mutual") <= F.col("k"), 1).otherwise(0)).alias("n_mutual"))
    share = lambda n: F.try_divide(F.col(n).cast("double"), F.col("n_gt").cast("double"))
    return counted.select(*keys, "threshold", "k", "n_source", "n_gt", share("n_direct").alias("direct_cdf"), share("n_mutual").alias("mutual_cdf"))


def cumulative_edges(edges: DataFrame, most: int) -> DataFrame:
    """Edges of each pair that are mutual by K, for K from 1 to ``most``."""
    counts = edges.groupBy("pair_idx").agg(*(F.sum((F.col("k") <= k).cast("long")).alias(str(k)) for k in range(1, most + 1)))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("edges")) for k in range(1, most + 1)))).alias("r")
    return counts.select("pair_idx", rows).select("pair_idx", "r.k", "r.edges")


def added_edges(cumulative: DataFrame) -> DataFrame:
    before = F.lag("edges", 1, 0).over(Window.partitionBy("pair_idx").orderBy("k"))
    return cumulative.withColumn("added", F.col("edges") - before)


def match_counts(cumulative: DataFrame) -> DataFrame:
    means = cumulative.groupBy("k").agg(F.avg("edges").alias("mean"))
    return means.join(percentile_columns(cumulative, ["k"], "edges", {"median": 0.5, "p90": 0.9}), "k", "left").select("k", "mean", "median", "p90")


def inclusion_rate(table: DataFrame, dataset: str, k: str, included: str) -> DataFrame:
    """Percent included per (dataset, k), and the plain mean over datasets with null counts."""
    per = table.groupBy(dataset, k).agg(F.sum(F.col(included).cast("long")).alias("included"), F.count("*").alias("total"))
    per = per.withColumn("rate", 100.0 * F.col("included") / F.col("total"))
    mean = per.groupBy(k).agg(F.avg("rate").alias("rate")).select(F.lit("Macro").alias(dataset), k, F.lit(None).cast("long").alias("included"), F.lit(None).cast("long").alias("total"), "rate")
    return per.unionByName(mean)


def histogram_distance(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """L1 distance of two histograms, missing cells counting 0, for each key."""
    a, b = (x.groupBy(*keys, value).agg(F.count("*").alias(n)) for x, n in ((left, "a"), (right, "b")))
    both = a.join(b, [*keys, value], "full")
    return both.groupBy(*keys).agg(F.sum(F.abs(F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0)))).alias("l1"))


def content_hash(rows: DataFrame, keys: Sequence[str], chunk: Column, order: Column, line: Column) -> DataFrame:
    """SHA-256 of each key's lines in order: the digest of its chunks' digests, one a line.  ``chunk`` rises with ``order`` and bounds what one task holds of a key."""
    joined = lambda o, x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), x.alias("x")))), lambda y: y["x"]), "\n")
    parts = rows.groupBy(*keys, chunk.alias("_chunk")).agg(F.sha2(joined(order, line), 256).alias("_digest"))
    return parts.groupBy(*keys).agg(F.sha2(joined(F.col("_chunk"), F.col("_digest")), 256).alias("digest"))


def errors_against_truth(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Results (pair_idx, qw..tz) with rotation and translation error against the true poses; NaN where a pair has none."""
    names = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")
    joined = results.join(truth.select("pair_idx", *(F.col(c).alias(f"_{c}") for c in names)), "pair_idx", "left")
    q, p = ([F.col(f"{u}{c}") for c in names] for u in ("", "_"))
    nan = F.lit(float("nan"))
    rotated = rotation_error(unit_quaternion(q[:4]), unit_quaternion(p[:4]))
    moved = translation_error(q[4:], p[4:])
    known = F.col("_qw").isNotNull()
    return joined.withColumns({"rotation_error_deg": F.when(known, F.coalesce(rotated, nan)).otherwise(nan), "translation_error_deg": F.when(known, F.coalesce(moved, nan)).otherwise(nan)}).drop(*(f"_{c}" for c in names))


def strict_errors(expected: DataFrame, results: DataFrame, key: str = "pair_idx") -> DataFrame:
    """Errors of exactly the expected ids: one that is missing, unexpected or there twice is an error when it is read."""
    have = results.groupBy(key).agg(F.count("*").alias("_n"), F.first("rotation_error_deg").alias("_r"), F.first("translation_error_deg").alias("_t"))
    both = expected.select(key).distinct().withColumn("_want", F.lit(True)).join(have, key, "full")
    wrong = F.when(F.col("_want").isNull(), "unexpected").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "twice")
    error = pose_error(F.col("_r"), F.col("_t"), FAILED)
    return both.select(key, F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.lit(" id "), F.col(key).cast("string"))).cast("double")).otherwise(error).alias("err"))


def dataset_report(results: DataFrame, keys: Sequence[str], subset: str, thresholds: Sequence[float], costs: Sequence[str]) -> DataFrame:
    """Per key the AUC over all pairs of its subsets together, and each cost as the plain mean of the subsets' means; texts that are no numbers do not count."""
    auc_ = auc_table(results, keys, thresholds)
    number = lambda c: F.col(c).try_cast("double") if results.schema[c].dataType.simpleString() == "string" else F.col(c).cast("double")
    means = results.groupBy(*keys, subset).agg(*(finite_mean(number(c)).alias(c) for c in costs))
    return auc_.join(means.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in costs)), list(keys))


def nested_summary(table: DataFrame, keys: Sequence[str], value: str, delta: str, pairs: str) -> DataFrame:
    """Over seeds: mean and sample deviation (null for one seed) of a value, mean and range of its delta, seeds, and the pairs of the first seed."""
    return table.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.avg(delta).alias("delta_mean"), F.min(delta).alias("delta_min"), F.max(delta).alias("delta_max"), F.count("*").alias("seeds"), F.min_by(pairs, "seed").alias("pairs"))


def five_seeds(summary: DataFrame, seeds: int = 5) -> DataFrame:
    """A summary whose rows must all be over the same number of seeds; another number is an error when it is read."""
    return summary.withColumn("seeds", F.when(F.col("seeds") == seeds, F.col("seeds")).otherwise(F.raise_error(F.concat(F.lit("seeds: "), F.col("seeds").cast("string"))).cast("long")))


def worst(table: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Each key's largest value with its name, of equal values the last by name."""
    return table.groupBy(*keys).agg(F.max(F.struct(F.col(value).alias("value"), F.col(name).alias("name"))).alias("w")).select(*keys, F.col("w.value").alias(value), F.col("w.name").alias(name))


def support(table: DataFrame, keys: Sequence[str], **columns: str) -> DataFrame:
    """Distinct values of some columns for each key."""
    return table.groupBy(*keys).agg(*(F.countDistinct(c).alias(n) for n, c in columns.items()))


def in_dataset_order(tables: Sequence[DataFrame], names: Sequence[str], dataset: str = "dataset") -> DataFrame:
    """Tables one after the other, sorted by a given order of datasets; others follow by name."""
    whole = reduce(lambda a, b: a.unionByName(b), tables)
    place = F.array_position(F.array(*map(F.lit, names)), F.col(dataset))
    return whole.withColumn("place", F.when(place > 0, place).otherwise(len(names) + 1)).orderBy("place", dataset)
