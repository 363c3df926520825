"""Queries over results, runs and curves: pose metrics, report tables, checks, sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchweave.functions import geometry as g
from matchweave.functions import text
from matchweave.operators import checks, frontier, graph, metrics, sampling, splits
from matchweave.plans.registry import r6, registered
from matchweave.sources import adapters, readers

THRESHOLDS = (5.0, 10.0, 20.0)

# SQL building blocks
RES = "res AS (SELECT o_orderpriority AS dataset, o_orderstatus AS method, o_orderkey % 5 AS seed, o_orderkey AS pair_idx, o_custkey AS custkey, (cast(round(o_totalprice * 100) AS BIGINT) % 4500)::DOUBLE / 100 AS err, (cast(round(o_totalprice * 100) AS BIGINT) % 360)::DOUBLE AS tr FROM orders)"
T = "t(threshold) AS (VALUES (5::DOUBLE), (10), (20))"


def _auc(keys: str) -> str:
    return f"SELECT {keys}, threshold, 100::DOUBLE / (count(*) * threshold) * (coalesce(sum(threshold - err) FILTER (err < threshold), 0) + 0.5::DOUBLE * coalesce(max(err) FILTER (err < threshold), 0)) AS auc, count(*) AS pairs FROM res, t GROUP BY {keys}, threshold"


AUC = f"WITH {RES}, {T}, auc AS ({_auc('dataset, method, seed')})"


def _aucs(spark, sf_dir):
    return metrics.auc_table(adapters.results(spark, sf_dir), ["dataset", "method", "seed"], THRESHOLDS)


@registered(f"{AUC} SELECT dataset, method, seed, threshold, round(auc, 6) AS auc, pairs FROM auc")
def pose_auc_by_dataset(spark, sf_dir):
    return _aucs(spark, sf_dir).select("dataset", "method", "seed", "threshold", r6("auc"), "pairs")


@registered(f"{AUC} SELECT method, seed, threshold, dataset, round(auc, 6) AS auc FROM auc UNION ALL SELECT method, seed, threshold, 'Macro', round(avg(auc), 6) FROM auc GROUP BY ALL")
def pose_auc_macro(spark, sf_dir):
    return metrics.macro(_aucs(spark, sf_dir), ["method", "seed", "threshold"], "dataset", "auc").select("method", "seed", "threshold", "dataset", r6("auc"))


@registered(f"{AUC} SELECT dataset, method, threshold, round(avg(auc), 6) AS mean, round(coalesce(stddev_samp(auc), 0), 6) AS std, round(min(auc), 6) AS min, round(max(auc), 6) AS max, count(*) AS seeds FROM auc GROUP BY ALL")
def auc_seed_summary(spark, sf_dir):
    s = metrics.seed_summary(_aucs(spark, sf_dir), ["dataset", "method", "threshold"], "auc")
    return s.select("dataset", "method", "threshold", *(r6(c) for c in ("mean", "std", "min", "max")), "seeds")


@registered(f"{AUC} SELECT a.dataset, a.seed, a.threshold, a.method, round(a.auc - b.auc, 6) AS delta FROM auc a JOIN auc b ON a.dataset = b.dataset AND a.seed = b.seed AND a.threshold = b.threshold AND b.method = 'F'")
def auc_paired_delta_baseline(spark, sf_dir):
    d = metrics.paired_delta(_aucs(spark, sf_dir), ["dataset", "seed", "threshold"], "method", "F", "auc")
    return d.select("dataset", "seed", "threshold", "method", r6("delta"))


@registered(f"{AUC} SELECT dataset, threshold, round(avg(p.auc - b.auc), 6) AS mean, round(stddev_samp(p.auc - b.auc), 6) AS std, count(*) AS seeds FROM auc p JOIN auc b USING (dataset, seed, threshold) WHERE p.method = 'O' AND b.method = 'F' GROUP BY ALL")
def auc_paired_delta_pivot(spark, sf_dir):
    d = metrics.pivot_delta(_aucs(spark, sf_dir), ["dataset", "seed", "threshold"], "method", "O", "F", "auc")
    s = metrics.seed_summary(d, ["dataset", "threshold"], "delta", single=None)
    return s.select("dataset", "threshold", r6("mean"), r6("std"), "seeds")


@registered("SELECT l_returnflag, round(avg(l_extendedprice), 6) AS mean, round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 6) AS median, round(quantile_cont(l_extendedprice::DOUBLE, 0.95), 6) AS p95, count(*) AS covered FROM lineitem GROUP BY ALL")
def runtime_percentiles(spark, sf_dir):
    x = adapters.table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("l_extendedprice"))
    return metrics.runtime(x, ["l_returnflag"], "l_extendedprice").select("l_returnflag", r6("mean"), r6("median"), r6("p95"), "covered")


@registered("SELECT l_linestatus, round(1000 * avg(l_quantity::DOUBLE) FILTER (l_returnflag = 'N'), 6) AS N, round(1000 * avg(l_quantity::DOUBLE) FILTER (l_returnflag = 'R'), 6) AS R, round(1000 * avg(l_quantity::DOUBLE) FILTER (l_returnflag = 'A'), 6) AS A FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) = 3")
def runtime_wide_table(spark, sf_dir):
    x = adapters.table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag", F.col("l_quantity").cast("double").alias("q"))
    return metrics.runtime_wide(x, ["l_linestatus"], "l_returnflag", ["N", "R", "A"], "q").select("l_linestatus", *(r6(c) for c in "NRA"))


@registered(f"WITH {RES}, done AS (SELECT * FROM res WHERE pair_idx % 7 <> 0) SELECT a.dataset, count(*) AS pairs, count(*) FILTER (coalesce(greatest(d.err, d.tr), 180) >= 180) AS failed, round(avg(coalesce(greatest(d.err, d.tr), 180)), 6) AS mean FROM res a LEFT JOIN done d USING (pair_idx) GROUP BY a.dataset")
def missing_as_failure_align(spark, sf_dir):
    r = adapters.results(spark, sf_dir)
    done = r.filter("pair_idx % 7 <> 0").select("pair_idx", F.col("err").alias("rotation_error_deg"), F.col("tr").alias("translation_error_deg"))
    aligned = metrics.align(r, done).join(r.select("pair_idx", "dataset"), "pair_idx")
    return aligned.groupBy("dataset").agg(F.count("*").alias("pairs"), F.sum((F.col("err") >= 180).cast("long")).alias("failed"), r6(F.avg("err"), "mean"))


@registered(f"WITH {RES}, per AS (SELECT dataset, seed AS k, sum((err < 10)::INT)::BIGINT AS included, count(*) AS total FROM res GROUP BY ALL) SELECT dataset, k, included, total, round(100::DOUBLE * included / total, 6) AS rate FROM per UNION ALL SELECT 'Macro', k, NULL, NULL, round(avg(100::DOUBLE * included / total), 6) FROM per GROUP BY k")
def inclusion_rate_macro(spark, sf_dir):
    r = adapters.results(spark, sf_dir).select("dataset", F.col("seed").alias("k"), (F.col("err") < 10).alias("included_"))
    return metrics.inclusion_rate(r, "dataset", "k", "included_").select("dataset", "k", "included", "total", r6("rate"))


@registered(
    """WITH h AS (SELECT r.r_name AS bin, n.n_name AS category, c.c_custkey AS pair, o.o_orderkey AS direction, CASE WHEN l_quantity::DOUBLE > 2 THEN l_quantity::DOUBLE END AS v
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey),
d AS (SELECT bin, category, pair, direction, avg(v) AS v FROM h GROUP BY ALL), p AS (SELECT bin, category, pair, avg(v) AS v FROM d GROUP BY ALL), c AS (SELECT bin, category, avg(v) AS v FROM p GROUP BY ALL)
SELECT bin, round(avg(v), 6) AS mean FROM c GROUP BY bin"""
)
def hierarchical_macro_mean(spark, sf_dir):
    t = lambda n: adapters.table(spark, sf_dir, n)
    places = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(places, F.col("o_custkey") == F.col("c_custkey"))
    q = F.col("l_quantity").cast("double")
    rows = rows.select(F.col("r_name").alias("bin"), F.col("n_name").alias("category"), F.col("c_custkey").alias("pair"), F.col("o_orderkey").alias("direction"), F.when(q > 2, q).otherwise(F.lit(float("nan"))).alias("v_"))
    return metrics.hierarchical_mean(rows, ["bin", "category", "pair", "direction"], "v_").select("bin", r6("mean"))


@registered(f"{AUC} SELECT dataset, method, seed, round(avg(auc), 6) AS mean FROM auc GROUP BY ALL")
def threshold_mean(spark, sf_dir):
    return metrics.threshold_mean(_aucs(spark, sf_dir), ["dataset", "method", "seed"], THRESHOLDS, "auc").select("dataset", "method", "seed", r6("mean"))


CURVE = "curve AS (SELECT event_type AS bin, user_id AS layer, event_id, user_id::DOUBLE AS x, value::DOUBLE AS y FROM events)"


def _curve(spark, sf_dir):
    return adapters.table(spark, sf_dir, "events").select(F.col("event_type").alias("bin"), F.col("user_id").alias("layer"), "event_id", F.col("user_id").cast("double").alias("x"), F.col("value").cast("double").alias("y"))


@registered(f"WITH {CURVE} SELECT bin, event_id, round(max(y) OVER w, 6) AS best, round(100 * (max(y) OVER w - y), 6) AS regret FROM curve WINDOW w AS (PARTITION BY bin ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def frontier_regret(spark, sf_dir):
    return frontier.frontier(_curve(spark, sf_dir), ["bin"], "x", "y").select("bin", "event_id", r6("best"), r6("regret"))


@registered(
    f"""WITH {CURVE}, r AS (SELECT layer, bin, 100 * (max(y) OVER (PARTITION BY bin ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - y) AS regret FROM curve),
b AS (SELECT layer, bin, avg(regret) AS a, max(regret) AS m, sum(regret) AS s, count(*) AS n FROM r GROUP BY layer, bin) SELECT layer, round(sum(s) / sum(n), 6) AS mean_regret, round(max(a), 6) AS worst_mean_regret, round(max(m), 6) AS max_regret FROM b GROUP BY layer"""
)
def layer_selection(spark, sf_dir):
    """All layers in the order of choice."""
    return frontier.select_layer(_curve(spark, sf_dir), ["bin"], "layer", "x", "y").select("layer", r6("mean_regret"), r6("worst_mean_regret"), r6("max_regret"))


@registered(
    f"""WITH {CURVE}, once AS (SELECT bin, x, avg(y) AS y FROM curve GROUP BY ALL), span AS (SELECT max(low) AS low, min(high) AS high FROM (SELECT min(x) AS low, max(x) AS high FROM once GROUP BY bin)),
piece AS (SELECT bin, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM once WINDOW w AS (PARTITION BY bin ORDER BY x)), grid AS (SELECT i::BIGINT AS i, low + i * ((high - low) / 200) AS gx FROM span, generate_series(0, 200) s(i))
SELECT bin, i, round(gx, 6) AS x, round(CASE WHEN x1 IS NULL THEN y0 ELSE y0 + (gx - x0) / (x1 - x0) * (y1 - y0) END, 6) AS y FROM piece JOIN grid ON gx >= x0 AND (gx < x1 OR (x1 IS NULL AND gx <= x0))"""
)
def curve_resample_interp(spark, sf_dir):
    return frontier.resample(_curve(spark, sf_dir), ["bin"], "x", "y").select("bin", "i", r6("x"), r6("y"))


@registered(f"WITH {CURVE}, p AS (SELECT bin, x, max(y) AS y FROM curve GROUP BY ALL), q AS (SELECT DISTINCT bin, floor(x * 0.75::DOUBLE) - 0.5::DOUBLE AS x FROM curve) SELECT q.bin, q.x, round(p.y, 6) AS y FROM q ASOF LEFT JOIN p ON q.bin = p.bin AND q.x >= p.x")
def step_lookup(spark, sf_dir):
    """Looks up all rows' places at three quarters of their x, between the points."""
    c = _curve(spark, sf_dir)
    points = c.groupBy("bin", "x").agg(F.max("y").alias("y"))
    return frontier.step_lookup(points, c.select("bin", (F.floor(F.col("x") * 0.75) - F.lit(0.5)).alias("x")).distinct(), ["bin"], "x", "y").select("bin", "x", r6("y"))


@registered(f"WITH {CURVE}, m AS (SELECT bin, layer, avg(y) AS y FROM curve GROUP BY ALL), d AS (SELECT layer, y - lag(y) OVER (PARTITION BY bin ORDER BY layer) AS d FROM m) SELECT layer, round(avg(d), 6) AS mean, round(max(abs(d)), 6) AS max_abs, round(avg(abs(d)), 6) AS mae, count(*) AS n FROM d WHERE d IS NOT NULL GROUP BY layer")
def adjacent_rank_delta(spark, sf_dir):
    m = _curve(spark, sf_dir).groupBy("bin", "layer").agg(F.avg("y").alias("y"))
    return frontier.adjacent_delta(m, ["bin"], "layer", "y").select("layer", r6("mean"), r6("max_abs"), r6("mae"), "n")


@registered(f"WITH {CURVE}, m AS (SELECT bin, layer, max(y) AS y FROM curve GROUP BY ALL), b AS (SELECT bin, layer, y, lag(y) OVER (PARTITION BY bin ORDER BY layer) AS before FROM m) SELECT bin, count(*) AS broken FROM b WHERE y < before GROUP BY bin")
def monotonicity_violations(spark, sf_dir):
    m = _curve(spark, sf_dir).groupBy("bin", "layer").agg(F.max("y").alias("y"))
    return frontier.not_monotone(m, ["bin"], "layer", "y").groupBy("bin").agg(F.count("*").alias("broken"))


@registered(f"WITH {RES}, a AS (SELECT dataset, floor(err)::BIGINT AS v, count(*) AS n FROM res WHERE seed < 2 GROUP BY ALL), b AS (SELECT dataset, floor(err)::BIGINT AS v, count(*) AS n FROM res WHERE seed >= 2 GROUP BY ALL) SELECT coalesce(a.dataset, b.dataset) AS dataset, sum(abs(coalesce(a.n, 0) - coalesce(b.n, 0)))::BIGINT AS l1 FROM a FULL JOIN b ON a.dataset = b.dataset AND a.v = b.v GROUP BY 1")
def histogram_l1_balance(spark, sf_dir):
    r = adapters.results(spark, sf_dir).withColumn("v", F.floor("err"))
    return metrics.histogram_distance(r.filter("seed < 2"), r.filter("seed >= 2"), ["dataset"], "v")


@registered("WITH o AS (SELECT o_orderpriority AS p, o_orderkey AS k, (cast(round(o_totalprice * 100) AS BIGINT) % 4500)::DOUBLE / 100 AS d FROM orders) SELECT CASE WHEN d < 15 THEN 0 WHEN d < 30 THEN 1 ELSE 2 END::INT AS bin, floor((d - CASE WHEN d < 15 THEN 0 WHEN d < 30 THEN 15 ELSE 30 END) / 5)::INT AS sub_bin, count(*) AS n FROM o GROUP BY ALL")
def angle_bin_histogram(spark, sf_dir):
    d = F.col("err")
    b = g.angle_bin(d, (0, 15, 30, 45))
    return adapters.results(spark, sf_dir).select(b.alias("bin"), g.sub_bin(d, 15.0 * b).alias("sub_bin")).groupBy("bin", "sub_bin").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- graphs and sets
@registered("WITH e AS (SELECT DISTINCT l_partkey AS a, -l_suppkey AS b FROM lineitem), d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node) SELECT (node < 0) AS supplier, max(degree) AS max_degree, count(*) AS nodes, sum(degree * degree)::BIGINT AS squares FROM d GROUP BY ALL")
def edge_endpoint_degree(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (-F.col("l_suppkey")).alias("b")).distinct()
    return graph.endpoint_degrees(e, "a", "b").groupBy((F.col("node") < 0).alias("supplier")).agg(F.max("degree").alias("max_degree"), F.count("*").alias("nodes"), F.sum(F.col("degree") * F.col("degree")).alias("squares"))


@registered("SELECT DISTINCT least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high FROM lineitem WHERE l_partkey <> l_suppkey")
def undirected_dedup(spark, sf_dir):
    return graph.undirected(adapters.table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@registered("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0) AND l_suppkey IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)")
def induced_subgraph(spark, sf_dir):
    nodes = adapters.table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("node"))
    return graph.induced(adapters.table(spark, sf_dir, "lineitem"), nodes, "l_partkey", "l_suppkey").distinct()


@registered("SELECT count(*) AS shared FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem)")
def set_disjointness_audit(spark, sf_dir):
    t = lambda n, c: adapters.table(spark, sf_dir, n).select(F.col(c).alias("node"))
    return checks.shared(t("orders", "o_orderkey"), t("lineitem", "l_orderkey"), "node").agg(F.count("*").alias("shared"))


@registered(f"WITH {RES}, c AS (SELECT DISTINCT dataset, custkey AS block FROM res) SELECT d.dataset, b.block FROM (SELECT DISTINCT dataset FROM c) d, (SELECT DISTINCT block FROM c) b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.dataset = d.dataset AND c.block = b.block)")
def rectangle_completeness(spark, sf_dir):
    """Customers without a result in some dataset."""
    return checks.rectangle(adapters.results(spark, sf_dir).select("dataset", F.col("custkey").alias("block")), ["dataset", "block"])


@registered(f"WITH {RES} SELECT custkey, seed, count(*) AS copies FROM res GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return checks.duplicates(adapters.results(spark, sf_dir), ["custkey", "seed"])


@registered("WITH o AS (SELECT DISTINCT o_custkey + o_orderkey % 3 * 100000 AS custkey FROM orders) SELECT c_custkey AS custkey, 'missing' AS problem FROM customer WHERE c_custkey NOT IN (SELECT custkey FROM o) UNION ALL SELECT custkey, 'unexpected' FROM o WHERE custkey NOT IN (SELECT c_custkey FROM customer)")
def missing_and_unexpected(spark, sf_dir):
    o = adapters.table(spark, sf_dir, "orders").select((F.col("o_custkey") + F.col("o_orderkey") % 3 * 100000).alias("custkey"))
    return checks.unexpected(o, adapters.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey")), ["custkey"])


@registered(f"WITH {RES} SELECT dataset, count(*) FILTER (method NOT IN ('O', 'F')) AS bad_status, count(*) FILTER (tr < 30) AS low_tr, count(*) FILTER (method = 'F' AND err >= 40) AS late_success FROM res GROUP BY ALL")
def violation_counts(spark, sf_dir):
    rules = {"bad_status": ~F.col("method").isin("O", "F"), "low_tr": F.col("tr") < 30, "late_success": (F.col("method") == "F") & (F.col("err") >= 40)}
    return checks.violation_counts(adapters.results(spark, sf_dir), rules, ["dataset"])


@registered("SELECT l_orderkey AS pair_idx, count(*) AS n, CASE WHEN bool_or(l_quantity >= 49) THEN 'skipped' ELSE 'success' END AS status FROM lineitem GROUP BY l_orderkey")
def pair_isolation(spark, sf_dir):
    rows = adapters.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair_idx"), "l_quantity")
    return checks.isolate(rows, F.col("l_quantity") >= 49).groupBy("pair_idx").agg(F.count("*").alias("n"), F.min("status").alias("status"))


@registered("SELECT o_orderkey AS pair_idx FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def resume_pending(spark, sf_dir):
    expected = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair_idx"))
    done = adapters.table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("pair_idx"))
    return checks.pending(expected, done, ["pair_idx"])


@registered("WITH c AS (SELECT o_orderpriority AS dataset, o_orderkey // 1000 AS chunk, sha256(string_agg(o_orderkey::VARCHAR || ':' || o_custkey::VARCHAR, chr(10) ORDER BY o_orderkey)) AS digest FROM orders GROUP BY ALL) SELECT dataset, sha256(string_agg(digest, chr(10) ORDER BY chunk)) AS digest FROM c GROUP BY dataset")
def content_hash(spark, sf_dir):
    o = adapters.table(spark, sf_dir, "orders")
    line = F.concat_ws(":", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))
    return metrics.content_hash(o.withColumnRenamed("o_orderpriority", "dataset"), ["dataset"], F.floor(F.col("o_orderkey") / 1000), F.col("o_orderkey"), line)


@registered(
    """WITH g AS (SELECT o_orderpriority AS dataset, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL)
SELECT dataset, '{"dataset":"' || dataset || '","status":"' || status || '","n":' || n || ',"value":' || CASE WHEN n % 2 = 0 OR n % 3 = 0 THEN 'null' ELSE (n / 4::DOUBLE)::VARCHAR END || '}' AS json FROM g"""
)
def strict_json(spark, sf_dir):
    """Groups whose value is NaN, infinite or a number, by their size."""
    rows = adapters.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    value = F.when(F.col("n") % 2 == 0, F.lit(float("nan"))).when(F.col("n") % 3 == 0, F.lit(float("-inf"))).otherwise(F.col("n") / 4)
    made = readers.strict_json(rows.withColumn("value", value))
    return made.select(F.get_json_object("json", "$.dataset").alias("dataset"), "json")


# ---------------------------------------------------------------- sampling
@registered(
    """WITH e AS (SELECT DISTINCT l_suppkey % 10 AS stratum, l_partkey AS a, l_suppkey AS b FROM lineitem), h AS (SELECT *, cast('0x' || substr(sha256('flip:' || a || ':' || b), 1, 16) AS UBIGINT) AS h FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, a, b) AS n, count(*) OVER (PARTITION BY stratum) AS c FROM h) SELECT stratum, a, b, n <= c // 2 AS flip FROM r"""
)
def hash_balanced_orientation(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("stratum"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    return sampling.balanced_flip(e, ["stratum"], "flip", ["a", "b"])


@registered(
    """WITH o AS (SELECT DISTINCT p_brand AS object FROM part), r AS (SELECT object, row_number() OVER (ORDER BY cast('0x' || substr(sha256('quota:' || object), 1, 16) AS UBIGINT), object) - 1 AS place, count(*) OVER () AS n FROM o),
b AS (SELECT * FROM (VALUES (0, 'easy'), (1, 'medium'), (2, 'hard')) b(i, bin)) SELECT object, bin, 500 // n + CASE WHEN (place - i * (500 % n) + 10 * n) % n < 500 % n THEN 1 ELSE 0 END AS quota FROM r, b"""
)
def quota_assignment(spark, sf_dir):
    return sampling.quotas(adapters.table(spark, sf_dir, "part").select(F.col("p_brand").alias("object")), ["easy", "medium", "hard"], 500)


@registered(
    """WITH o AS (SELECT p_brand AS object, count(*) AS size FROM part GROUP BY ALL), k AS (SELECT *, size % 2 = 1 AS odd, sum(size) OVER () // 2 - sum(size // 2) OVER () AS missing, cast('0x' || substr(sha256('larger-side:' || object), 1, 16) AS UBIGINT) AS h FROM o),
r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN odd THEN 0 ELSE 1 END, h, object) AS p FROM k) SELECT object, size, (size // 2 + CASE WHEN odd AND p <= missing THEN 1 ELSE 0 END)::BIGINT AS half FROM r"""
)
def half_sizes(spark, sf_dir):
    return sampling.half_sizes(adapters.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("object")).agg(F.count("*").alias("size")))


BINS = {"near": (0.0, 15.0), "mid": (15.0, 30.0), "far": (30.0, 45.0)}


def _objects(spark, sf_dir):
    """Edges between images: parts of a brand in 40 groups, suppliers in 40 groups; bin and sub-bin follow the part's and supplier's keys."""
    l = adapters.table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    brand = adapters.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("object"))
    low, high = F.col("l_partkey") % 40, F.col("l_suppkey") % 40 + 40
    e = l.join(brand, "l_partkey").select("object", low.alias("low"), high.alias("high"))
    return e.distinct().withColumns({"bin": F.concat(F.lit("b"), ((F.col("low") + F.col("high")) % 2).cast("string")), "sub_bin": F.floor(F.col("high") / 2) % 2})


def _quotas(edges, share=40):
    """A quota for each bin of an object, and its parts by sub-bin, in proportion to the edges."""
    raw = edges.groupBy("object", "bin", "sub_bin").agg(F.count("*").alias("raw")).withColumns({"left": F.col("raw"), "right": F.col("raw")})
    allocated = sampling.sub_quotas(raw, F.greatest(F.lit(1), F.floor(F.sum("raw").over(Window.partitionBy("object", "bin")) / share)))
    return allocated.groupBy("object", "bin").agg(F.sum("allocated").alias("quota")), allocated


@registered()
def partition_search(spark, sf_dir):
    """Each object's images in two halves, with the score of the best of 4,096 partitions."""
    e = _objects(spark, sf_dir)
    images = e.select("object", F.explode(F.array("low", "high")).alias("image")).distinct()
    halves = sampling.half_sizes(images.groupBy("object").agg(F.count("*").alias("size")))
    about = images.withColumns({"split": F.col("image") % 2, "height": 480 + F.col("image") % 3, "width": F.lit(640), "camera": F.col("image") % 5})
    found = sampling.partition_search(e, halves, _quotas(e)[0], about, trials=4096, strict=False)
    return found.select("object", F.col("image").cast("long").alias("image"), "side", *sampling.SCORE)


@registered()
def low_degree_edges(spark, sf_dir):
    """Each object's selection of the smallest degrees, of 192 trials."""
    e = _objects(spark, sf_dir)
    wanted = _quotas(e)[1].select("object", "bin", "sub_bin", F.col("allocated").alias("target"))
    return sampling.low_degree_edges(e, wanted, trials=192, most_in_bin=8, most=12)


#: Pairs of each object and bin.
QUOTA = 30
UNITS = f"""raw AS (SELECT o_orderpriority AS object, CASE WHEN d < 15 THEN 'near' WHEN d < 30 THEN 'mid' ELSE 'far' END AS bin, floor((d - CASE WHEN d < 15 THEN 0 WHEN d < 30 THEN 15 ELSE 30 END) / 5)::BIGINT AS sub_bin, count(*) AS raw,
  count(*) FILTER (o_custkey % 2 = 0) AS l, count(*) FILTER (o_custkey % 2 = 1) AS r FROM (SELECT *, (cast(round(o_totalprice * 100) AS BIGINT) % 4500)::DOUBLE / 100 AS d FROM orders) GROUP BY ALL),
cap AS (SELECT *, least(l, r) AS capacity, sum(raw) OVER (PARTITION BY object, bin) AS total FROM raw),
unit AS (SELECT *, row_number() OVER (PARTITION BY object, bin ORDER BY j * total - {QUOTA} * raw, sub_bin) AS due FROM (SELECT *, unnest(range(0, capacity)) AS j FROM cap)),
given AS (SELECT c.object, c.bin, c.sub_bin, c.raw, c.capacity, (SELECT count(*) FROM unit u WHERE u.object = c.object AND u.bin = c.bin AND u.sub_bin = c.sub_bin AND u.due <= {QUOTA}) AS allocated FROM cap c)"""


def _sided(spark, sf_dir):
    """Results as edges of an object, of both sides of a split: an edge's distance gives its bin."""
    e = splits.object_bins(adapters.results(spark, sf_dir).select(F.col("dataset").alias("object"), "custkey", "pair_idx", F.col("err").alias("distance")), BINS)
    return e.withColumn("side", F.col("custkey") % 2)


def _allocated(spark, sf_dir):
    rows = _sided(spark, sf_dir).groupBy("object", "bin", "sub_bin").agg(F.count("*").alias("raw"), *(F.sum((F.col("side") == s).cast("long")).alias(n) for s, n in ((0, "left"), (1, "right"))))
    return sampling.sub_quotas(rows, QUOTA)


@registered(f"WITH {UNITS} SELECT object, bin, sub_bin, raw, capacity, allocated FROM given")
def sub_bin_quotas(spark, sf_dir):
    return _allocated(spark, sf_dir).select("object", "bin", F.col("sub_bin").cast("long").alias("sub_bin"), "raw", "capacity", "allocated")


@registered(
    f"""WITH {UNITS}, e AS (SELECT DISTINCT o_orderpriority AS object, o_custkey AS low, o_custkey + 2 * (o_orderkey % 3) - 2 AS high, o_orderkey % 2 AS b FROM orders),
i AS (SELECT DISTINCT object, image, image % 2 AS side FROM (SELECT object, low AS image FROM e UNION ALL SELECT object, high FROM e)),
c AS (SELECT object, b, count(*) AS raw_edges, count(*) FILTER (low % 2 = 0 AND high % 2 = 0) AS edges_0, count(*) FILTER (low % 2 = 1 AND high % 2 = 1) AS edges_1 FROM e GROUP BY ALL),
n AS (SELECT object, count(*) FILTER (side = 0) AS images_0, count(*) FILTER (side = 1) AS images_1 FROM i GROUP BY ALL),
q AS (SELECT object, bin, string_agg(allocated::VARCHAR, ';' ORDER BY sub_bin) AS sub_bin_quotas FROM given GROUP BY ALL)
SELECT q.object, q.bin, {QUOTA}::BIGINT AS quota, coalesce(raw_edges, 0) AS raw_edges, coalesce(edges_0, 0) AS edges_0, coalesce(edges_1, 0) AS edges_1, images_0, images_1, sub_bin_quotas
FROM q LEFT JOIN c ON c.object = q.object AND q.bin = CASE c.b WHEN 0 THEN 'near' ELSE 'mid' END JOIN n ON n.object = q.object"""
)
def split_capacity_report(spark, sf_dir):
    o = adapters.results(spark, sf_dir)
    e = o.select(F.col("dataset").alias("object"), F.col("custkey").alias("low"), (F.col("custkey") + 2 * (F.col("pair_idx") % 3) - 2).alias("high"), F.when(F.col("pair_idx") % 2 == 0, "near").otherwise("mid").alias("bin")).distinct()
    sides = e.select("object", F.explode(F.array("low", "high")).alias("image")).distinct().withColumn("side", (F.col("image") % 2).cast("int"))
    allocated = _allocated(spark, sf_dir)
    quotas = allocated.select("object", "bin").distinct().withColumn("quota", F.lit(QUOTA).cast("long"))
    return sampling.capacity_report(e, sides, quotas, allocated)


# a split in which some promises are broken
SPLIT = """e AS (SELECT CASE o_custkey % 2 WHEN 0 THEN 'est' ELSE 'cor' END AS family, CASE WHEN d < 15 THEN 'near' WHEN d < 30 THEN 'mid' ELSE 'far' END AS bin, o_orderpriority AS object, o_custkey AS image_1, o_custkey + 2 * (o_orderkey % 4) + 1 AS image_2, d::VARCHAR AS distance, o_orderkey
  FROM (SELECT *, (cast(round(o_totalprice * 100) AS BIGINT) % 4500) // 100 AS d FROM orders)),
sel AS (SELECT family, CASE WHEN o_orderkey % 29 = 0 THEN 'near' ELSE bin END AS bin, object, CASE WHEN o_orderkey % 4 = 0 THEN image_2 ELSE image_1 END AS image_1, CASE WHEN o_orderkey % 4 = 0 THEN image_1 ELSE image_2 END AS image_2, distance FROM e),
src AS (SELECT DISTINCT object, image_1, image_2, distance FROM e WHERE o_orderkey % 31 <> 0), side AS (SELECT DISTINCT image, CASE image % 2 WHEN 0 THEN 'est' ELSE 'cor' END AS family FROM (SELECT image_1 AS image FROM e UNION ALL SELECT image_2 FROM e)),
quota AS (SELECT o_orderpriority AS object, b.bin, 100::BIGINT AS quota FROM (SELECT DISTINCT o_orderpriority FROM orders), (VALUES ('near'), ('mid'), ('far')) b(bin)), fam(family) AS (VALUES ('est'), ('cor')),
ends AS (SELECT family, bin, image_1 AS image FROM sel UNION ALL SELECT family, bin, image_2 FROM sel)"""


def _split(spark, sf_dir):
    o = adapters.results(spark, sf_dir)
    e = o.select(F.when(F.col("custkey") % 2 == 0, "est").otherwise("cor").alias("family"), F.col("dataset").alias("object"), F.col("custkey").alias("image_1"), (F.col("custkey") + 2 * (F.col("pair_idx") % 4) + 1).alias("image_2"), F.floor("err").cast("string").alias("distance"), "pair_idx")
    e = splits.object_bins(e, BINS)
    turned = F.col("pair_idx") % 4 == 0
    selected = e.select("family", F.when(F.col("pair_idx") % 29 == 0, "near").otherwise(F.col("bin")).alias("bin"), "object", F.when(turned, F.col("image_2")).otherwise(F.col("image_1")).alias("image_1"), F.when(turned, F.col("image_1")).otherwise(F.col("image_2")).alias("image_2"), "distance")
    source = e.filter("pair_idx % 31 <> 0").select("object", "image_1", "image_2", "distance").distinct()
    sides = e.select(F.explode(F.array("image_1", "image_2")).alias("image")).distinct().withColumn("family", F.when(F.col("image") % 2 == 0, "est").otherwise("cor"))
    quotas = e.select("object").distinct().select("object", F.explode(F.array(*map(F.lit, BINS))).alias("bin")).withColumn("quota", F.lit(100))
    images = sides.select("image", (F.col("image") % 3).cast("string").alias("camera"))
    return selected, source, sides, quotas, images


@registered(
    f"""WITH {SPLIT}, per AS (SELECT family, bin, image, count(*) AS n FROM ends GROUP BY ALL), turned AS (SELECT s.family, s.bin, count(*) FILTER (q.distance IS NULL) AS n FROM sel s LEFT JOIN (SELECT DISTINCT image_1, image_2, distance FROM src) q ON q.image_1 = s.image_1 AND q.image_2 = s.image_2 AND q.distance = s.distance GROUP BY ALL),
fine AS (SELECT object, bin, floor((distance::DOUBLE - CASE bin WHEN 'near' THEN 0 WHEN 'mid' THEN 15 ELSE 30 END) / 5) AS sub, count(*) FILTER (family = 'est') AS a, count(*) FILTER (family = 'cor') AS b FROM sel GROUP BY ALL),
sides AS (SELECT * FROM side UNION ALL SELECT image, CASE family WHEN 'est' THEN 'cor' ELSE 'est' END FROM side WHERE image % 19 = 0)
SELECT 'images in several families' AS "check", count(*) AS violations FROM (SELECT 1 FROM sides GROUP BY image HAVING count(DISTINCT family) > 1)
UNION ALL SELECT 'pairs of a bin', count(*) FILTER (n <> 500) FROM (SELECT f.family, b.bin, (SELECT count(*) FROM sel s WHERE s.family = f.family AND s.bin = b.bin) AS n FROM fam f, (VALUES ('near'), ('mid'), ('far')) b(bin))
UNION ALL SELECT 'quotas', count(*) FILTER (n <> 100) FROM (SELECT f.family, q.object, q.bin, (SELECT count(*) FROM sel s WHERE s.family = f.family AND s.bin = q.bin AND s.object = q.object) AS n FROM fam f, quota q)
UNION ALL SELECT 'duplicate edges', count(*) FROM (SELECT 1 FROM sel GROUP BY family, bin, image_1, image_2 HAVING count(*) > 1)
UNION ALL SELECT 'edges outside the source', count(*) FROM sel s WHERE NOT EXISTS (SELECT 1 FROM src q WHERE least(q.image_1, q.image_2) = least(s.image_1, s.image_2) AND greatest(q.image_1, q.image_2) = greatest(s.image_1, s.image_2) AND q.distance = s.distance)
UNION ALL SELECT 'distance outside the bin', count(*) FILTER (bin <> CASE WHEN distance::DOUBLE < 15 THEN 'near' WHEN distance::DOUBLE < 30 THEN 'mid' ELSE 'far' END) FROM sel
UNION ALL SELECT 'ends in another family', count(*) FROM ends JOIN sides ON sides.image = ends.image AND sides.family <> ends.family
UNION ALL SELECT 'roles out of balance', count(*) FILTER (n <> 250) FROM turned
UNION ALL SELECT 'degree in a bin', count(*) FILTER (n > 4) FROM per
UNION ALL SELECT 'degree in a family', count(*) FROM (SELECT 1 FROM ends GROUP BY family, image HAVING count(*) > 6)
UNION ALL SELECT 'distance histograms differ', count(*) FILTER (a <> b) FROM fine"""
)
def split_validation(spark, sf_dir):
    """Every nineteenth image is on both sides, so that each rule has something to find."""
    selected, source, sides, quotas, images = _split(spark, sf_dir)
    twice = sides.filter("image % 19 = 0").withColumn("family", F.when(F.col("family") == "est", "cor").otherwise("est"))
    return splits.split_problems(selected, source, sides.unionByName(twice), quotas, images, bins=BINS, pairs=500)


@registered(
    f"""WITH {SPLIT}, p AS (SELECT family, bin, object, least(image_1 % 3, image_2 % 3) AS c, greatest(image_1 % 3, image_2 % 3) AS d FROM sel), h AS (SELECT bin, object, c, d, count(*) FILTER (family = 'est') AS a, count(*) FILTER (family = 'cor') AS b FROM p GROUP BY ALL),
o AS (SELECT bin, object, sum(abs(a - b)) AS l1, coalesce(sum(a) FILTER (c = d), 0) AS sa, coalesce(sum(b) FILTER (c = d), 0) AS sb FROM h GROUP BY ALL)
SELECT bin, sum(sa)::BIGINT AS same_a, sum(sb)::BIGINT AS same_b, sum(abs(sa - sb))::BIGINT AS same_sum, max(abs(sa - sb))::BIGINT AS same_max, arg_max(object, (abs(sa - sb), object)) AS same_object, sum(l1)::BIGINT AS l1_sum, max(l1)::BIGINT AS l1_max, arg_max(object, (l1, object)) AS l1_object FROM o GROUP BY bin"""
)
def split_camera_balance(spark, sf_dir):
    selected, _, _, _, images = _split(spark, sf_dir)
    return splits.camera_balance(selected, images, ("est", "cor"))


@registered(
    """WITH l AS (SELECT o_orderpriority AS object, o_custkey % 20 AS c, sum(o_orderkey % 3)::BIGINT AS s0, count(*) AS s1 FROM orders GROUP BY ALL), j AS (SELECT a.object, a.s0 + b.s0 AS s0, a.s1 + b.s1 AS s1, a.c AS left_candidate, b.c AS right_candidate FROM l a JOIN l b ON a.object = b.object WHERE a.c < 10 AND b.c >= 10)
SELECT object, s0, s1, left_candidate, right_candidate FROM (SELECT *, row_number() OVER (PARTITION BY object ORDER BY s0, s1, left_candidate, right_candidate) AS n FROM j) WHERE n = 1"""
)
def joint_choice(spark, sf_dir):
    o = adapters.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("object"), (F.col("o_custkey") % 20).alias("candidate")).agg(F.sum(F.col("o_orderkey") % 3).cast("long").alias("s0"), F.count("*").alias("s1"))
    return sampling.joint_choice(o.filter("candidate < 10"), o.filter("candidate >= 10"), ["s0", "s1"])


# ---------------------------------------------------------------- geometry
POSE = "pose AS (SELECT vec_id AS idx, label, [x::DOUBLE for x in embedding] AS v FROM embeddings), nq AS (SELECT *, sqrt(v[3]*v[3]+v[4]*v[4]+v[5]*v[5]+v[6]*v[6]) AS n FROM pose), unitq AS (SELECT idx, label, v[3]/n AS w, v[4]/n AS x, v[5]/n AS y, v[6]/n AS z, v[7] AS t0, v[8] AS t1, v[9] AS t2 FROM nq)"
ROT = "1-2*(y*y+z*z) AS r00, 2*(x*y-w*z) AS r01, 2*(x*z+w*y) AS r02, 2*(x*y+w*z) AS r10, 1-2*(x*x+z*z) AS r11, 2*(y*z-w*x) AS r12, 2*(x*z-w*y) AS r20, 2*(y*z+w*x) AS r21, 1-2*(x*x+y*y) AS r22"


def _poses(spark, sf_dir):
    k = adapters.keypoints(spark, sf_dir)
    q = g.unit_quaternion([F.get("raw", F.lit(i)) for i in range(2, 6)])
    return k.select("idx", "pair_idx", *(x.alias(n) for n, x in zip("wxyz", q, strict=True)), *(F.get("raw", F.lit(6 + i)).alias(f"t{i}") for i in range(3)))


@registered(f"WITH {POSE} SELECT idx, {', '.join(f'round({c}, 6) AS {n}' for c, n in (x.rsplit(' AS ', 1) for x in ROT.split(', ')))} FROM unitq")
def quaternion_rotation_matrix(spark, sf_dir):
    r = g.rotation([F.col(c) for c in "wxyz"])
    return _poses(spark, sf_dir).select("idx", *(r6(r[i][j], f"r{i}{j}") for i in range(3) for j in range(3)))


@registered(f"WITH {POSE}, s AS (SELECT *, sign(CASE WHEN abs(w) > 1e-15 THEN w WHEN abs(x) > 1e-15 THEN x WHEN abs(y) > 1e-15 THEN y ELSE z END) AS s FROM unitq) SELECT idx, round(abs(w), 6) AS w, round(x * s, 6) AS x, round(y * s, 6) AS y, round(z * s, 6) AS z FROM s")
def rotation_to_quaternion(spark, sf_dir):
    q = g.canonical(g.quaternion(g.rotation([F.col(c) for c in "wxyz"])))
    return _poses(spark, sf_dir).select("idx", *(x.alias(n) for n, x in zip("wxyz", q, strict=True))).select("idx", *(r6(c) for c in "wxyz"))


@registered(
    f"""WITH {POSE}, m AS (SELECT *, {ROT} FROM unitq), j AS (SELECT a.idx, a.r00*b.r00+a.r01*b.r01+a.r02*b.r02+a.r10*b.r10+a.r11*b.r11+a.r12*b.r12+a.r20*b.r20+a.r21*b.r21+a.r22*b.r22 AS tr,
  (a.t0*b.t0+a.t1*b.t1+a.t2*b.t2) / (sqrt(a.t0*a.t0+a.t1*a.t1+a.t2*a.t2) * sqrt(b.t0*b.t0+b.t1*b.t1+b.t2*b.t2)) AS c FROM m a JOIN m b ON a.label = b.label AND b.idx = a.idx + 1)
SELECT idx, round(degrees(acos(greatest(-1, least(1, (tr - 1) / 2)))), 6) AS rotation, round(least(degrees(acos(greatest(-1, least(1, c)))), 180 - degrees(acos(greatest(-1, least(1, c))))), 6) AS translation FROM j"""
)
def relative_pose_error(spark, sf_dir):
    p = _poses(spark, sf_dir)
    names = [*"wxyz", "t0", "t1", "t2"]
    b = p.select((F.col("idx") - 1).alias("idx"), "pair_idx", *(F.col(c).alias(f"b_{c}") for c in names))
    joined = p.join(b, ["idx", "pair_idx"])
    c = lambda prefix, which: [F.col(prefix + n) for n in which]
    return joined.select("idx", r6(g.rotation_error(c("", "wxyz"), c("b_", "wxyz")), "rotation"), r6(g.translation_error(c("", names[4:]), c("b_", names[4:])), "translation"))


@registered(
    f"""WITH {POSE}, j AS (SELECT a.idx, b.w*a.w+b.x*a.x+b.y*a.y+b.z*a.z AS w, -b.w*a.x+b.x*a.w-b.y*a.z+b.z*a.y AS x, -b.w*a.y+b.x*a.z+b.y*a.w-b.z*a.x AS y, -b.w*a.z-b.x*a.y+b.y*a.x+b.z*a.w AS z, a.t0, a.t1, a.t2, b.t0 AS u0, b.t1 AS u1, b.t2 AS u2 FROM unitq a JOIN unitq b ON a.label = b.label AND b.idx = a.idx + 1),
m AS (SELECT *, {ROT} FROM j) SELECT idx, round(w, 6) AS w, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(u0 - (r00*t0+r01*t1+r02*t2), 6) AS t0, round(u1 - (r10*t0+r11*t1+r12*t2), 6) AS t1, round(u2 - (r20*t0+r21*t1+r22*t2), 6) AS t2 FROM m"""
)
def relative_pose(spark, sf_dir):
    p = _poses(spark, sf_dir)
    names = [*"wxyz", "t0", "t1", "t2"]
    b = p.select((F.col("idx") - 1).alias("idx"), "pair_idx", *(F.col(c).alias(f"b_{c}") for c in names))
    q, t = g.relative_pose(*([F.col(x + n) for n in s] for x in ("", "b_") for s in (names[:4], names[4:])))
    return p.join(b, ["idx", "pair_idx"]).select("idx", *(r6(v, n) for n, v in zip(names, [*q, *t], strict=True)))


@registered(
    """WITH s AS (SELECT p_partkey, 480 + p_size * 37 AS h, 640 + (p_partkey % 50) * 31 AS w FROM part), r AS (SELECT *, 1024::DOUBLE / greatest(h, w) AS s, greatest(h, w) <= 1024 AS same FROM s),
z AS (SELECT p_partkey, w, CASE WHEN same THEN h ELSE trunc(h * s)::INT END AS height, CASE WHEN same THEN w ELSE trunc(w * s)::INT END AS width, CASE WHEN same THEN 1::DOUBLE ELSE s END AS scale FROM r)
SELECT p_partkey, height::INT AS height, width::INT AS width, round(scale, 6) AS scale, ((height + 13) // 14 * 14)::INT AS padded_height, ((width + 13) // 14 * 14)::INT AS padded_width, floor(trunc(w * scale) / 2)::BIGINT AS cx, round(width / w::DOUBLE, 6) AS scale_x FROM z"""
)
def resize_and_pad_sizes(spark, sf_dir):
    s = adapters.table(spark, sf_dir, "part").select("p_partkey", (480 + F.col("p_size") * 37).alias("h"), (640 + (F.col("p_partkey") % 50) * 31).alias("w"))
    h, w, scale = g.resize(F.col("h"), F.col("w"), 1024, only_down=True)
    r = s.select("p_partkey", "w", h.cast("int").alias("height"), w.cast("int").alias("width"), scale.alias("scale"))
    return r.select("p_partkey", "height", "width", r6("scale"), g.pad(F.col("height"), 14).alias("padded_height"), g.pad(F.col("width"), 14).alias("padded_width"), g.scaled_intrinsics(F.lit(1.0), F.col("w"), F.col("scale"))[1].alias("cx"), r6(F.col("width") / F.col("w"), "scale_x"))


@registered(
    """WITH p AS (SELECT p_partkey, p_size, p_partkey % 20 AS patch FROM part), c AS (SELECT *, (patch % 5 + 0.5::DOUBLE) * 14 AS x, (patch // 5 + 0.5::DOUBLE) * 14 AS y, CASE WHEN p_size % 10 <> 0 THEN 655.35::DOUBLE / p_size END AS d FROM p)
SELECT p_partkey, round(x, 6) AS x, round(y, 6) AS y, round(d, 6) AS depth, round((x - 35) / 50 * d, 6) AS px, round((y - 28) / 50 * d, 6) AS py, greatest(0, least(59, floor(x * 0.9 + 0.5)))::INT AS pixel FROM c"""
)
def patch_geometry(spark, sf_dir):
    p = adapters.table(spark, sf_dir, "part")
    x, y = g.patch_centre(F.col("p_partkey") % 20, 5, 14)
    raw = F.when(F.col("p_size") % 10 != 0, F.col("p_size")).otherwise(0)
    q = p.select("p_partkey", x.alias("x"), y.alias("y"), g.inverse_depth(raw).alias("depth"))
    px, py, _ = g.back_project(F.col("x"), F.col("y"), F.col("depth"), F.lit(50.0), F.lit(70.0), F.lit(56.0))
    return q.select("p_partkey", r6("x"), r6("y"), r6("depth"), r6(px, "px"), r6(py, "py"), g.nearest_pixel(F.col("x") * 0.9, 60).alias("pixel"))


@registered(
    """WITH s AS (SELECT p_partkey, (p_size % 50 + 1) / 60::DOUBLE AS r, p_size % 50 + 5 AS m FROM part), q AS (SELECT *, m / 60::DOUBLE * ((m - 1) / 59::DOUBLE) * ((m - 2) / 58::DOUBLE) * ((m - 3) / 57::DOUBLE) * ((m - 4) / 56::DOUBLE) AS p FROM s)
SELECT p_partkey, greatest(100, least(100000, ceil(ln(0.01::DOUBLE) / ln(1 - p))))::BIGINT AS iterations, round(0.5::DOUBLE * (1 / (400 + r) + 1 / (500 - r)), 6) AS scale FROM q"""
)
def adaptive_iterations(spark, sf_dir):
    """Five draws without putting back, of sixty edges with 5 to 54 inliers."""
    s = adapters.table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") % 50 + 1) / 60.0).alias("r"), (F.col("p_size") % 50 + 5).alias("m"))
    ratios = [(F.col("m") - i) / F.lit(60.0 - i) for i in range(5)]
    return s.select("p_partkey", g.adaptive_iterations(ratios, 0.99, 100, 100_000).alias("iterations"), r6(g.threshold_scale(400 + F.col("r"), 500 - F.col("r")), "scale"))


@registered("SELECT o_orderkey, printf('matching_%03d', o_orderkey) AS name, o_orderkey AS number, o_orderpriority AS object, cast('0x' || substr(sha256('7:' || o_orderkey || ':' || o_custkey), 1, 16) AS UBIGINT)::VARCHAR AS hash, CASE o_orderstatus WHEN 'F' THEN 'Failed' ELSE o_orderstatus END AS label FROM orders")
def names_and_hashes(spark, sf_dir):
    o = adapters.table(spark, sf_dir, "orders").withColumn("name", text.numbered("matching_", F.col("o_orderkey")))
    return o.select("o_orderkey", "name", text.trailing_number(F.concat("name", F.lit(".csv"))).alias("number"), text.first_segment(F.concat("o_orderpriority", F.lit("/"), "name")).alias("object"), text.stable_hash(7, F.col("o_orderkey"), F.col("o_custkey")).cast("string").alias("hash"), text.alias_label(F.col("o_orderstatus"), {"F": "Failed"}).alias("label"))
