"""Relational checks: each returns the rows that break a rule, or counts of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchweave.functions.geometry import finite


class CheckFailed(ValueError):
    pass


def require_none(violations: DataFrame, message: str) -> None:
    """Raises if there is any row, with a few of them in the message."""
    some = violations.limit(5).collect()
    if some:
        raise CheckFailed(f"{message}: {[r.asDict() for r in some]}")


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def unexpected(observed: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, with the side they are missing from."""
    a, b = observed.select(*keys).distinct(), expected.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("problem", F.lit("unexpected")).unionByName(b.join(a, list(keys), "left_anti").withColumn("problem", F.lit("missing")))


def rectangle(rows: DataFrame, keys: Sequence[str], most: int = 50_000_000) -> DataFrame:
    """Combinations of the keys' own values that no row has.  Keys are those of reports, with few values each; a rectangle of
    more than ``most`` cells is refused before it is written out."""
    domains = [rows.select(k).distinct() for k in keys]
    sizes = rows.agg(*(F.countDistinct(k) for k in keys)).first()
    if prod(sizes) > most:
        raise CheckFailed(f"a rectangle of {' x '.join(map(str, sizes))} cells")
    return reduce(lambda a, b: a.crossJoin(b), domains).join(rows.select(*keys).distinct(), list(keys), "left_anti")


def shared(left: DataFrame, right: DataFrame, node: str) -> DataFrame:
    """Nodes that both sets have and must not."""
    return left.select(node).intersect(right.select(node))


def endpoints(pairs: DataFrame, a: str, b: str, name: str = "node") -> DataFrame:
    return pairs.select(F.explode(F.array(a, b)).alias(name)).distinct()


def not_nested(smaller: DataFrame, larger: DataFrame, keys: Sequence[str]) -> DataFrame:
    return smaller.select(*keys).join(larger.select(*keys), list(keys), "left_anti")


def replay_differences(first: DataFrame, second: DataFrame, ignore: Sequence[str]) -> DataFrame:
    """Rows of one run that the other lacks, timing columns aside."""
    columns = [c for c in first.columns if c not in set(ignore)]
    a, b = first.select(*columns), second.select(*columns)
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second")))


def violation_counts(rows: DataFrame, rules: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """How many rows break each rule (a column that is true where the rule is broken), in one pass."""
    counts = [F.sum(F.when(F.coalesce(r, F.lit(True)), 1).otherwise(0)).alias(name) for name, r in rules.items()]
    return rows.groupBy(*keys).agg(*counts)


def result_rules() -> dict[str, Column]:
    """Broken rules of pose results: status domain, negative times, success without finite errors."""
    ok = F.col("status") == "success"
    return {
        "bad_status": ~F.col("status").isin("success", "failed", "skipped"),
        "negative_time": F.coalesce(F.col("running_time_s") < 0, F.lit(False)),
        "not_finite": ok & ~(finite(F.col("rotation_error_deg")) & finite(F.col("translation_error_deg"))),
    }


def frozen(rows: DataFrame, protocol: dict[str, object]) -> DataFrame:
    """Rows that differ from the frozen values of some columns."""
    return rows.filter(reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.lit(v)) for c, v in protocol.items())))


def uniform(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys for which some column has more than one value."""
    return rows.groupBy(*keys).agg(*(F.countDistinct(c).alias(c) for c in columns)).filter(reduce(lambda a, b: a | b, (F.col(c) > 1 for c in columns)))


def isolate(rows: DataFrame, bad: Column, key: str = "pair_idx") -> DataFrame:
    """Rows with ``status``: one bad row makes its pair skipped, and no other."""
    broken = F.max(F.coalesce(bad, F.lit(True)).cast("int")).over(Window.partitionBy(key))
    return rows.withColumn("status", F.when(broken == 1, "skipped").otherwise("success"))


def skip_reasons(pairs: DataFrame, edges: DataFrame, least: int = 5, poses: DataFrame | None = None, least_o2o: int | None = None, threshold: float = 0.0, proposal_k: int = 0, failed: DataFrame | None = None) -> DataFrame:
    """A row for every pair of the list: edges, and why it cannot be estimated, null if it can.

    edges: pair_idx, left_idx, right_idx and, where the file has them, similarity, k and ``bad`` (why a row is not valid).  poses: the pairs with
    pose and intrinsics.  ``threshold`` above 0 keeps edges of that similarity, ``proposal_k`` above 0 draws samples from edges up to that k only.
    One-to-one edges are bounded by distinct ends here; the search itself counts them.  failed: pairs whose search ended without a pose.
    """
    has = lambda c: c in edges.columns
    ends = F.col("left_idx").isNull() | F.col("right_idx").isNull()
    kept = (F.col("similarity") >= threshold) if threshold > 0 and has("similarity") else F.lit(True)
    offered = kept & (F.col("k") <= proposal_k) if proposal_k and has("k") else kept
    distinct = lambda c: F.countDistinct(F.when(offered, F.col(c)))
    some = lambda c: F.max(F.coalesce(c, F.lit(False)))
    measured = edges.groupBy("pair_idx").agg(
        F.count("*").alias("n"), F.sum(kept.cast("long")).alias("_kept"), F.least(distinct("left_idx"), distinct("right_idx")).alias("_o2o"), F.count(F.when(~ends, 1)).alias("_whole"), some((F.col("left_idx") < 0) | (F.col("right_idx") < 0)).alias("_negative"),
        (F.max("bad") if has("bad") else F.lit(None).cast("string")).alias("_bad"), (F.count("similarity") if has("similarity") else F.lit(0)).alias("_similar"), (F.count("k") if has("k") else F.lit(0)).alias("_ranked"),
    )
    joined = pairs.select("pair_idx").join(measured, "pair_idx", "left")
    posed = joined.join(poses.select("pair_idx").distinct().withColumn("_posed", F.lit(True)), "pair_idx", "left") if poses is not None else joined.withColumn("_posed", F.lit(True))
    ended = posed.join(failed.select("pair_idx").distinct().withColumn("_failed", F.lit(True)), "pair_idx", "left") if failed is not None else posed.withColumn("_failed", F.lit(None).cast("boolean"))
    reason = (
        F.when(F.col("n").isNull(), "missing_match_file")
        .when(F.col("_posed").isNull(), "missing_pose_intrinsics")
        .when(F.col("_bad").isNotNull(), F.concat(F.lit("invalid_match_csv: "), "_bad"))
        .when(F.col("_whole") == 0, "missing_m2m_metadata")
        .when(F.col("_negative"), "invalid_feature_ids")
        .when(F.lit(threshold > 0) & (F.col("_similar") == 0), "similarity_threshold_requires_similarity")
        .when(F.col("_whole") < F.col("n"), "column_size_mismatch")
        .when(F.lit(proposal_k > 0) & (F.col("_ranked") < F.col("n")), "proposal_rank_size_mismatch")
        .when(F.col("_kept") < least, "not_enough_matches")
        .when(F.col("_o2o") < (least if least_o2o is None else least_o2o), "proposal_graph_not_enough_o2o")
        .when(F.col("_failed"), "ransac_failed")
    )
    return ended.select("pair_idx", F.coalesce("n", F.lit(0)).alias("n"), reason.alias("reason"))


def complete(results: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(problem, count) of results against the rows that there must be: missing, unexpected, twice; then the broken rules of ``result_rules``."""
    have, want = results.select(*keys), expected.select(*keys).distinct()
    found = [("missing", want.join(have.distinct(), list(keys), "left_anti")), ("unexpected", have.distinct().join(want, list(keys), "left_anti")), ("duplicate", duplicates(results, keys).select(*keys))]
    counts = [rows.agg(F.count("*").alias("count")).select(F.lit(name).alias("problem"), "count") for name, rows in found]
    rules = violation_counts(results, result_rules())
    listed = F.explode(F.array(*(F.struct(F.lit(n).alias("problem"), F.col(n).cast("long").alias("count")) for n in rules.columns))).alias("r")
    return reduce(DataFrame.unionByName, counts).unionByName(rules.select(listed).select("r.problem", "r.count")).select("problem", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def pending(expected: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return expected.join(done.select(*keys).distinct(), list(keys), "left_anti")


POLICIES = ("skip", "overwrite", "error", "validate", "repair")


def to_do(expected: DataFrame, stored: DataFrame, keys: Sequence[str], policy: str = "skip", broken: DataFrame | None = None) -> DataFrame:
    """The expected rows that a run has to make, given what is stored and which stored keys are ``broken``.

    ``skip``: those that are missing; ``overwrite``: all; ``error``: all, if nothing is stored yet; ``validate``: none, if all are
    stored and sound; ``repair``: the missing and the broken ones.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    if policy == "overwrite":
        return expected
    if policy == "error":
        require_none(expected.join(stored.select(*keys).distinct(), list(keys), "left_semi"), "there are results already")
        return expected
    sound = stored.select(*keys).distinct()
    if policy in ("validate", "repair") and broken is not None:
        sound = sound.join(broken.select(*keys).distinct(), list(keys), "left_anti")
    missing = pending(expected, sound, keys)
    if policy == "validate":
        require_none(missing, "results are missing or broken")
    return missing


def plot_inputs(rows: DataFrame, keys: Sequence[str], values: Sequence[str], seeds: int | None = 5) -> DataFrame:
    """(problem, count) of a table that is to be drawn: keys twice, cells of the keys' rectangle that are missing, values that are not finite, other numbers of seeds (column ``seeds``)."""
    bad = reduce(lambda a, b: a | b, (~finite(F.col(v)) for v in values))
    found = [("duplicate", duplicates(rows, keys)), ("missing cell", rectangle(rows, keys)), ("not finite", rows.filter(bad))]
    if seeds is not None:
        found.append(("seeds", rows.filter(~F.col("seeds").eqNullSafe(F.lit(seeds).cast("long")))))
    return reduce(DataFrame.unionByName, (d.agg(F.count("*").alias("count")).select(F.lit(name).alias("problem"), "count") for name, d in found))


def denominators(poses: DataFrame, bound: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Per key how many pairs there are to be scored, from its pose table, and the digest of their ids; ``problem`` where the digest or the
    number is not the one that ``bound`` (keys, pairs, sha256) holds it to.

    Ids are hashed in chunks of a thousand, then the chunks' digests, so no task holds all of a key's.
    """
    from matchweave.operators.metrics import content_hash

    number = F.col("pair_idx").cast("long")
    digest = content_hash(poses, keys, F.floor(number / 1000), number, number.cast("string"))
    counted = poses.groupBy(*keys).agg(F.count("*").alias("pairs"), F.countDistinct("pair_idx").alias("_ids")).join(digest, list(keys))
    held = bound.select(*keys, F.col("pairs").alias("_pairs"), F.col("sha256").alias("_sha256"))
    problem = F.when(F.col("_ids") != F.col("pairs"), "an id twice").when(F.col("_pairs").isNull(), "not bound").when(F.col("_pairs") != F.col("pairs"), "another number of pairs").when(F.col("_sha256") != F.col("digest"), "other ids")
    return counted.join(held, list(keys), "left").select(*keys, "pairs", "digest", problem.alias("problem"))
