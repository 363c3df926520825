"""Scores of pose hypotheses over association graphs, pools and reranking.

``edges``: pair_idx, left_idx, right_idx, p and calibrated x1, y1, x2, y2.
``hypotheses``: pair_idx, hid and a pose as q (w, x, y, z) and t, columns qw..tz.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchweave.functions import geometry as g
from matchweave.operators.graph import max_matching, node_mass

POSE = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")


def residuals(edges: DataFrame, hypotheses: DataFrame, threshold: float, cheirality: bool = True, nearest: float = 0.01) -> DataFrame:
    """Every edge under every hypothesis of its pair: squared residual r2 and inlier (below the threshold's square, in front of both cameras).

    A pose's matrices are columns of the hypotheses before these meet the edges, and each step is columns of the step before, so
    that no expression is written out twice.
    """
    q = g.unit_quaternion([F.col(n) for n in POSE[:4]])
    posed = hypotheses.withColumns(dict(zip(("_w", "_x", "_y", "_z"), q, strict=True)))
    r = g.rotation([F.col(c) for c in ("_w", "_x", "_y", "_z")])
    posed = posed.withColumns({f"_r{i}{j}": r[i][j] for i in range(3) for j in range(3)})
    t = [F.col(n) for n in POSE[4:]]
    entry = lambda i, j: {0: t[1] * F.col(f"_r2{j}") - t[2] * F.col(f"_r1{j}"), 1: t[2] * F.col(f"_r0{j}") - t[0] * F.col(f"_r2{j}"), 2: t[0] * F.col(f"_r1{j}") - t[1] * F.col(f"_r0{j}")}[i]
    posed = posed.withColumns({f"_e{i}{j}": entry(i, j) for i in range(3) for j in range(3)})
    joined = edges.join(posed, "pair_idx")
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    row = lambda m, i: F.col(f"_{m}{i}0") * x1 + F.col(f"_{m}{i}1") * y1 + F.col(f"_{m}{i}2")
    back = {f"_b{j}": F.col(f"_e0{j}") * x2 + F.col(f"_e1{j}") * y2 + F.col(f"_e2{j}") for j in range(2)}
    joined = joined.withColumns({f"_l{i}": row("e", i) for i in range(3)} | back | {f"_a{i}": row("r", i) for i in range(3)})
    l, a, b = [F.col(f"_l{i}") for i in range(3)], [F.col(f"_a{i}") for i in range(3)], [x2, y2, F.lit(1.0)]
    joined = joined.withColumns({
        "_top": g.dot3(b, l), "_below": l[0] * l[0] + l[1] * l[1] + F.col("_b0") * F.col("_b0") + F.col("_b1") * F.col("_b1"),
        "_aa": g.dot3(a, a), "_ab": g.dot3(a, b), "_bb": g.dot3(b, b), "_at": g.dot3(a, t), "_bt": g.dot3(b, t),
    })
    det = F.col("_aa") * F.col("_bb") - F.col("_ab") * F.col("_ab")
    depths = [F.try_divide(F.col("_ab") * F.col("_bt") - F.col("_bb") * F.col("_at"), det), F.try_divide(F.col("_aa") * F.col("_bt") - F.col("_ab") * F.col("_at"), det)]
    front = F.coalesce((depths[0] > nearest) & (depths[1] > nearest), F.lit(False))
    below = F.greatest(F.col("_below"), F.lit(1e-12))
    scored = joined.withColumns({"r2": F.when(F.col("_below") > 1e-12, F.col("_top") * F.col("_top") / below).otherwise(F.lit(float("inf"))), "_front": front if cheirality else F.lit(True)})
    inlier = g.finite(F.col("r2")) & (F.col("r2") < threshold * threshold) & F.col("_front")
    return scored.withColumn("inlier", inlier).drop(*(c for c in scored.columns if c.startswith("_")))


def hcm(scored: DataFrame, masses: DataFrame) -> DataFrame:
    """(pair_idx, hid, hcm): minus the sum over both sides' nodes of ``log1p(C * inlier mass)``; 0 without inliers.

    ``masses``: edges with p, left_c and right_c (``graph.node_mass``).
    """
    weights = masses.select("pair_idx", "left_idx", "right_idx", "p", "left_c", "right_c")
    rows = scored.drop("p", "left_c", "right_c").join(weights, ["pair_idx", "left_idx", "right_idx"])
    mass = F.when(F.col("inlier"), F.col("p")).otherwise(0.0)
    by = lambda side: rows.groupBy("pair_idx", "hid", f"{side}_idx").agg(F.sum(mass).alias("mass"), F.first(f"{side}_c").alias("c")).select("pair_idx", "hid", F.log1p(F.col("c") * F.col("mass")).alias("x"))
    return by("left").unionByName(by("right")).groupBy("pair_idx", "hid").agg((-F.sum("x")).alias("hcm"))


def mcm(scored: DataFrame) -> DataFrame:
    """(pair_idx, hid, cardinality): one-to-one inliers, by maximum matching; hypotheses without inliers have 0."""
    found = max_matching(scored.filter("inlier"), ["pair_idx", "hid"]).groupBy("pair_idx", "hid").agg(F.count("*").alias("cardinality"))
    return scored.select("pair_idx", "hid").distinct().join(found, ["pair_idx", "hid"], "left").select("pair_idx", "hid", F.coalesce("cardinality", F.lit(0)).alias("cardinality"))


def msac(scored: DataFrame, threshold: float) -> DataFrame:
    """(pair_idx, hid, msac): mean of ``r2 / threshold**2`` of inliers and 1 of the others."""
    cost = F.when(F.col("inlier"), F.col("r2") / (threshold * threshold)).otherwise(1.0)
    return scored.groupBy("pair_idx", "hid").agg(F.avg(cost).alias("msac"))


def inlier_weights(scored: DataFrame) -> DataFrame:
    degree = lambda c: F.count("*").over(Window.partitionBy("pair_idx", "hid", c))
    return scored.filter("inlier").withColumn("weight", 1 / degree("left_idx") + 1 / degree("right_idx"))


def pool(scores: DataFrame, capacity: int, order: str = "hid") -> DataFrame:
    """The best ``capacity`` hypotheses of each pair by hcm, earlier ones first among equals, with their place."""
    place = F.row_number().over(Window.partitionBy("pair_idx").orderBy("hcm", order))
    return scores.withColumn("place", place).filter(F.col("place") <= capacity)


def would_enter(reference: DataFrame, pooled: DataFrame, capacity: int) -> DataFrame:
    """Whether each pair's reference score (pair_idx, hcm) would enter its pool: it is not full, or its worst score is strictly worse."""
    cutoff = pooled.groupBy("pair_idx").agg(F.max("hcm").alias("cutoff"), F.count("*").alias("held"))
    joined = reference.join(cutoff, "pair_idx", "left")
    return joined.withColumn("admitted", (F.coalesce("held", F.lit(0)) < capacity) | (F.col("hcm") < F.col("cutoff")))


def rerank(pooled: DataFrame, cardinalities: DataFrame) -> DataFrame:
    """Each pair's winner: most one-to-one inliers, then the better hcm, then the earlier place."""
    joined = pooled.join(cardinalities, ["pair_idx", "hid"])
    best = F.row_number().over(Window.partitionBy("pair_idx").orderBy(F.desc("cardinality"), "hcm", "place"))
    return joined.withColumn("_n", best).filter("_n = 1").drop("_n")


def with_prior(edges: DataFrame, q: float = 0.3, delta: float = 0.01) -> DataFrame:
    """Edges with degree prior and node weights; a column ``prob`` overrides the prior where it is not null."""
    from matchweave.operators.graph import degree_prior

    prior = degree_prior(edges, q)
    if "prob" in edges.columns:
        prior = prior.withColumn("p", F.coalesce("prob", "p"))
    return node_mass(prior, delta)
