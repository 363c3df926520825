"""A robust pose search for each pair: seeded samples, the five-point solver, scoring, local optimisation, pool, rerank and polish.

Each pair is one group, seeded by its own id, so pairs run anywhere in any order with the same result.  A pair holds a
few thousand edges at most (the caps of ``knn``); its work is one task's.  Samples are drawn, solved and scored ``BATCH`` at a
time as arrays, and then looked at one by one in their order, so that a search stops at the sample that ends it.

A sample takes ``Options.sample`` edges of distinct lefts and rights from the proposal graph (all edges, or those with k up to ``proposal_k``);
every pose that its five points allow is scored on all edges.  The modes differ in what counts as better:

* ``cm``: more inliers, then the lower truncated cost
* ``hcm``: the lower score of ``scoring.hcm``
* ``mcm``: more one-to-one inliers, then the lower score
* ``hcm_mc``: seeds are pooled by hcm; at the end each is refined and the one with most one-to-one inliers wins, of equal ones the better seed
"""

from __future__ import annotations

import bisect
import math
import time
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.functions import geometry as g
from matchweave.operators import relpose
from matchweave.operators.graph import matching
from matchweave.operators.lean import lean

#: Samples of a batch, at most; cells (poses times edges) of one array.
BATCH, CELLS = 256, 1 << 17
MODES = ("cm", "hcm", "mcm", "hcm_mc")
POSE = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")
TIMES = ("draw_ms", "solve_ms", "score_ms", "refine_ms", "rank_ms", "total_ms")
_TRACE = "rank int, hcm double, cardinality long, n_inliers long, msac double, seed_pose array<double>, refined_pose array<double>, polished_pose array<double>"
SCHEMA = (
    "pair_idx long, status string, message string, n_edges long, iterations long, refinements long, n_inliers long, inlier_ratio double, cardinality long, hcm double, model_score double, "
    + ", ".join(f"{c} double" for c in POSE)
    + ", pool_size long, pool_full boolean, pool_cutoff double, pool_attempts long, pool_duplicates long, pool_basins long, run long, "
    + ", ".join(f"{c} double" for c in TIMES)
    + f", trace array<struct<{_TRACE.replace(' array', ':array').replace(' int', ':int').replace(' double', ':double').replace(' long', ':long')}>>"
)


@dataclass(frozen=True)
class Options:
    """What a search does.  Thresholds are in calibrated units; ``dedup_deg`` above 0 keeps one pool entry for poses that close."""

    mode: str = "hcm_mc"
    threshold: float = 0.01
    sample: int = 5
    least_iterations: int = 100
    most_iterations: int = 500
    success: float = 0.9999
    capacity: int = 20
    dedup_deg: float = 0.0
    proposal_k: int = 0
    runs: int = 1
    seed: int = 0
    local: bool = True

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if self.proposal_k and self.least_iterations != self.most_iterations:
            raise ValueError("a restricted proposal graph needs a fixed number of iterations")
        if self.sample != 5:
            raise ValueError("the solver takes five edges")


# ---------------------------------------------------------------- poses
def _quaternion(r: np.ndarray) -> np.ndarray:
    k = np.array([[r[0, 0] - r[1, 1] - r[2, 2], 0, 0, 0], [r[0, 1] + r[1, 0], r[1, 1] - r[0, 0] - r[2, 2], 0, 0], [r[0, 2] + r[2, 0], r[1, 2] + r[2, 1], r[2, 2] - r[0, 0] - r[1, 1], 0], [r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1], np.trace(r)]])
    x, y, z, w = np.linalg.eigh(k / 3)[1][:, -1]
    q = np.array([w, x, y, z])
    return q * np.sign(q[np.flatnonzero(abs(q) > 1e-15)[0]])


def similar(p, q, degrees: float) -> bool:
    """Whether two poses (quaternion, translation) agree within an angle: either sign of a quaternion is the same rotation, either
    sign of a translation the same direction; without a translation the rotation decides."""
    (q1, t1), (q2, t2) = p, q
    if abs(np.dot(q1, q2)) < math.cos(math.radians(degrees) / 2):
        return False
    size = np.linalg.norm(t1) * np.linalg.norm(t2)
    return size < 1e-18 or abs(np.dot(t1, t2)) / size >= math.cos(math.radians(degrees))


def dynamic_iterations(inliers: int, edges: int, options: Options) -> int:
    """Iterations until a sample of inliers alone is drawn with the wanted probability, drawn without putting back."""
    n = np.arange(options.sample)
    p = float(np.prod(np.maximum(0, inliers - n) / np.maximum(1, edges - n))) if min(inliers, edges) >= options.sample else 0.0
    if p >= 1 - 1e-7:
        return options.least_iterations
    if p <= 1e-7:
        return options.most_iterations
    return max(options.least_iterations, min(options.most_iterations, math.ceil(math.log(1 - options.success) / math.log(1 - p))))


# ---------------------------------------------------------------- one pair
@dataclass
class Seed:
    """A pose with what it was scored."""

    pose: tuple
    hcm: float
    inliers: int
    cardinality: int = 0
    cost: float = math.inf


@dataclass
class Pool:
    """The best seeds by hcm, in order, at most ``capacity``.  A full pool takes only what is strictly better than its last entry; with
    ``dedup_deg`` a seed that agrees with an entry takes that one's place if it is better, and is left out if not."""

    capacity: int
    dedup_deg: float = 0.0
    entries: list = field(default_factory=list)
    attempts: int = 0
    duplicates: int = 0

    def cutoff(self) -> float:
        return self.entries[-1].hcm if len(self.entries) >= self.capacity else math.inf

    def twin(self, seed: Seed) -> int | None:
        """The best entry that agrees with a seed."""
        return next((i for i, s in enumerate(self.entries) if similar(s.pose, seed.pose, self.dedup_deg or 1.0)), None)

    def offer(self, seed: Seed) -> None:
        if seed.hcm >= self.cutoff():
            return
        self.attempts += 1
        twin = self.twin(seed)
        if twin is not None:
            self.duplicates += 1
            if self.dedup_deg > 0:
                if self.entries[twin].hcm <= seed.hcm:
                    return
                del self.entries[twin]
        bisect.insort(self.entries, seed, key=lambda s: s.hcm)
        del self.entries[self.capacity :]

    def basins(self) -> int:
        """Entries that agree with none before them."""
        poses = [s.pose for s in self.entries]
        return sum(not any(similar(p, o, self.dedup_deg or 1.0) for o in poses[:i]) for i, p in enumerate(poses))


@dataclass
class Scored:
    """Many poses of a pair with what they were scored; ``most`` bounds the one-to-one inliers from above.  ``inlier``: bits of each pose's
    inliers, poses x edges, only where the mode counts one-to-one inliers of seeds."""

    r: np.ndarray
    t: np.ndarray
    sample: np.ndarray
    inlier: np.ndarray
    inliers: np.ndarray
    hcm: np.ndarray
    cost: np.ndarray
    most: np.ndarray


class Pair:
    """The edges of one pair, and what poses are worth on them."""

    def __init__(self, pdf: pd.DataFrame, options: Options, scale: float = 1.0):
        self.options, self.spent = options, dict.fromkeys(TIMES, 0.0)
        self.threshold = options.threshold * scale
        self.left, self.right = (pd.factorize(pdf[c])[0] for c in ("left_idx", "right_idx"))
        self.a, self.b = pdf[["x1", "y1"]].to_numpy(float), pdf[["x2", "y2"]].to_numpy(float)
        self.x, self.y = relpose.homogeneous(self.a), relpose.homogeneous(self.b)
        self.p = pdf["p"].to_numpy(float)
        self.c = []
        for side, name in ((self.left, "left_c"), (self.right, "right_c")):
            weight = np.zeros(side.max() + 1)
            weight[side] = pdf[name].to_numpy(float)
            self.c.append(weight)
        proposal = np.arange(len(pdf)) if not options.proposal_k else np.flatnonzero(pdf["k"].to_numpy() <= options.proposal_k)
        self.room = len(matching(zip(self.left[proposal].tolist(), self.right[proposal].tolist(), strict=True)))
        # the proposal's edges by left: edges of the i-th left are order[first[i] : first[i] + degree[i]]
        self.order = proposal[np.argsort(self.left[proposal], kind="stable")]
        _, self.first, self.degree = np.unique(self.left[self.order], return_index=True, return_counts=True)

    def timed(self, what: str, work, *arguments):
        began = time.perf_counter()
        try:
            return work(*arguments)
        finally:
            self.spent[what] += 1000 * (time.perf_counter() - began)

    def draw(self, random: np.random.Generator, count: int) -> tuple[np.ndarray, np.ndarray]:
        """(edges, whole) of ``count`` samples: lefts one after another without putting back, each with the first edge from a random place on whose
        right is free; a left that has none is passed over.  A sample that cannot be filled is drawn again, some times; ``whole`` tells which succeeded."""
        size, lefts = self.options.sample, len(self.first)
        edges, whole = np.zeros((count, size), np.int64), np.zeros(count, bool)
        if lefts < size:
            return edges, whole
        for _ in range(max(50, 10 * lefts)):
            open_ = np.flatnonzero(~whole)
            if not len(open_):
                break
            edges[open_], whole[open_] = self._attempt(random, len(open_))
        return edges, whole

    def _attempt(self, random: np.random.Generator, count: int) -> tuple[np.ndarray, np.ndarray]:
        size, lefts = self.options.sample, len(self.first)
        edges, rights, got = np.zeros((count, size), np.int64), np.full((count, size), -1), np.zeros(count, np.int64)
        tried = np.zeros((count, lefts), bool)
        rows, left_over = np.arange(count), np.full(count, lefts)
        while len(rows := rows[(got[rows] < size) & (left_over[rows] > 0)]):
            # a left that this sample has not tried: drawn at random until it is new, at once where few are left
            some = random.integers(lefts, size=len(rows))
            again = np.flatnonzero(tried[rows, some])
            for _ in range(8):
                if not len(again):
                    break
                some[again] = random.integers(lefts, size=len(again))
                again = again[tried[rows[again], some[again]]]
            if len(again):
                some[again] = np.where(tried[rows[again]], -1.0, random.random((len(again), lefts))).argmax(1)
            tried[rows, some] = True
            left_over[rows] -= 1
            degree, start = self.degree[some], random.integers(1 << 30, size=len(rows)) % self.degree[some]
            found = np.full(len(rows), -1)
            for turn in range(int(degree.max())):
                asks = np.flatnonzero((found < 0) & (turn < degree))
                if not len(asks):
                    break
                edge = self.order[self.first[some[asks]] + (start[asks] + turn) % degree[asks]]
                free = (rights[rows[asks]] != self.right[edge][:, None]).all(1)
                found[asks[free]] = edge[free]
            hit = found >= 0
            into = rows[hit]
            edges[into, got[into]], rights[into, got[into]] = found[hit], self.right[found[hit]]
            got[into] += 1
        return edges, got == size

    def masks(self, r: np.ndarray, t: np.ndarray, widen: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(inliers, squared residuals) of poses, each poses x edges, under ``widen`` times the squared threshold."""
        r2 = relpose.sampson(relpose.skew(t) @ r, self.x, self.y)
        near = r2 < widen * self.threshold**2
        k, at = np.nonzero(near)
        near[k, at] = relpose.in_front(r[k], t[k], self.x[at], self.y[at])
        return near, r2

    def mask(self, r: np.ndarray, t: np.ndarray, widen: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        near, r2 = self.masks(r[None], t[None], widen)
        return near[0], r2[0]

    def score(self, r: np.ndarray, t: np.ndarray, sample: np.ndarray | None = None) -> Scored:
        """Poses (m x 3 x 3, m x 3) on all edges, some at a time."""
        parts, step, bits = [], max(1, CELLS // max(1, len(self.p))), self.options.mode == "mcm"
        for at in range(0, len(r), step):
            inlier, r2 = self.masks(r[at : at + step], t[at : at + step])
            k, edge = np.nonzero(inlier)
            m, hcm, most = len(inlier), 0.0, []
            for side, weight in zip((self.left, self.right), self.c, strict=True):
                cell = k * len(weight) + side[edge]
                mass = np.bincount(cell, self.p[edge], minlength=m * len(weight)).reshape(m, -1)
                hcm = hcm - np.log1p(weight * mass).sum(1)
                most.append((np.bincount(cell, minlength=m * len(weight)).reshape(m, -1) > 0).sum(1))
            parts.append((np.packbits(inlier[:, : bits * inlier.shape[1]], axis=1), inlier.sum(1), hcm, np.where(inlier, r2 / self.threshold**2, 1.0).mean(1), np.minimum(*most)))
        inlier, inliers, hcm, cost, most = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros((0, 0), np.uint8), *(np.zeros(0) for _ in range(4)))
        return Scored(r, t, np.zeros(len(r), np.int64) if sample is None else sample, inlier, inliers, hcm, cost, most)

    def one_to_one(self, inlier: np.ndarray) -> int:
        return len(matching(zip(self.left[inlier].tolist(), self.right[inlier].tolist(), strict=True)))

    def seed(self, scored: Scored, i: int, best: Seed | None = None) -> Seed:
        """The i-th pose; its one-to-one inliers are counted where the mode needs them and their bound does not rule it out already."""
        found = Seed((scored.r[i], scored.t[i]), float(scored.hcm[i]), int(scored.inliers[i]), 0, float(scored.cost[i]))
        if self.options.mode == "mcm" and (best is None or scored.most[i] >= best.cardinality):
            found.cardinality = self.timed("rank_ms", self.one_to_one, np.unpackbits(scored.inlier[i], count=len(self.p)).astype(bool))
        return found

    def value(self, seed: Seed):
        """What the mode minimises."""
        return {"cm": (-seed.inliers, seed.cost), "mcm": (-seed.cardinality, seed.hcm)}.get(self.options.mode, (seed.hcm,))

    def refine(self, r: np.ndarray, t: np.ndarray, widen: float = 5.0, steps: int = 25) -> tuple[np.ndarray, np.ndarray]:
        """A pose drawn to the edges within the (widened) squared threshold by ``relpose.refine``: edges of nodes with many such edges count less, and
        beyond the threshold itself an edge counts no more.  Unchanged where no more edges than a sample are left."""
        near = self.mask(r, t, widen)[0]
        if near.sum() <= self.options.sample:
            return r, t
        weight = sum(1 / np.bincount(side[near])[side[near]] for side in (self.left, self.right))
        return relpose.refine(r, t, self.x[near], self.y[near], weight, self.threshold, steps)

    def polish(self, r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.refine(r, t, 1.0, 100)


def _named(pose) -> tuple:
    return _quaternion(pose[0]), pose[1]


def search(pair: Pair, random: np.random.Generator) -> tuple[dict, list]:
    """One run over a pair: (fields of the result, trace of the pool)."""
    o, pool = pair.options, Pool(pair.options.capacity, pair.options.dedup_deg)
    best = gate = None
    limit, iterations, refinements, n = o.most_iterations, 0, 0, len(pair.p)
    ends = lambda: iterations >= o.most_iterations or iterations > max(o.least_iterations, limit)
    batch = 32
    while not ends():
        count, batch = min(batch, o.most_iterations - iterations), min(2 * batch, BATCH)
        edges, whole = pair.timed("draw_ms", pair.draw, random, count)
        at = np.flatnonzero(whole)
        r, t, k = pair.timed("solve_ms", relpose.sample_poses, pair.a[edges[at]], pair.b[edges[at]])
        scored = pair.timed("score_ms", pair.score, r, t, at[k])
        of = np.searchsorted(scored.sample, np.arange(count + 1))
        for sample in range(count):
            if ends():
                break
            iterations += 1
            for i in range(of[sample], of[sample + 1]):
                if not scored.inliers[i]:
                    continue
                seed = pair.seed(scored, i, best)
                if best is None or pair.value(seed) < pair.value(best):
                    best, limit = seed, dynamic_iterations(seed.inliers, n, o)
                if o.mode == "hcm_mc" and seed.hcm < pool.cutoff():
                    pool.offer(Seed(_named(seed.pose), seed.hcm, seed.inliers))
                # local optimisation where the seed is better than all before it in what the mode looks at
                larger = gate is None or (seed.cardinality > gate[1] if o.mode == "mcm" else seed.inliers > gate[0] or seed.hcm < gate[2])
                if o.local and larger:
                    gate = (max(seed.inliers, gate[0]), max(seed.cardinality, gate[1]), min(seed.hcm, gate[2])) if gate else (seed.inliers, seed.cardinality, seed.hcm)
                    refinements += 1
                    refined = pair.timed("refine_ms", pair.refine, *seed.pose)
                    again = pair.seed(pair.timed("score_ms", pair.score, refined[0][None], refined[1][None]), 0, best)
                    if pair.value(again) < pair.value(best):
                        best, limit = again, dynamic_iterations(again.inliers, n, o)
    about = {"iterations": iterations, "pool_size": len(pool.entries), "pool_full": len(pool.entries) >= o.capacity, "pool_cutoff": pool.cutoff(), "pool_attempts": pool.attempts, "pool_duplicates": pool.duplicates, "pool_basins": pool.basins()}
    trace = []
    if pool.entries:  # the pool alone decides: refined seeds by one-to-one inliers, then by the seed's own score
        winner = None
        for place, seed in enumerate(pool.entries, 1):
            refined = pair.timed("refine_ms", pair.refine, _matrix(seed.pose[0]), seed.pose[1])
            refinements += 1
            inlier, r2 = pair.mask(*refined)
            cardinality = pair.timed("rank_ms", pair.one_to_one, inlier)
            cost = float(np.where(inlier, r2 / pair.threshold**2, 1.0).mean())
            flat = lambda x: [*_quaternion(x[0]).tolist(), *x[1].tolist()]
            polished = pair.timed("refine_ms", pair.polish, *refined)
            trace.append((place, seed.hcm, cardinality, int(inlier.sum()), cost, [*seed.pose[0].tolist(), *seed.pose[1].tolist()], flat(refined), flat(polished)))
            if winner is None or (-cardinality, seed.hcm) < winner[0]:
                winner = (-cardinality, seed.hcm), polished, inlier
        (negative, hcm), pose, inlier = winner
        found = {"cardinality": -negative, "hcm": hcm, "n_inliers": int(inlier.sum()), "model_score": float(negative)}
    elif best is not None:
        inlier = pair.mask(*best.pose)[0]
        found = {"cardinality": pair.timed("rank_ms", pair.one_to_one, inlier), "hcm": best.hcm, "n_inliers": int(inlier.sum()), "model_score": float(pair.value(best)[0])}
        pose = pair.timed("refine_ms", pair.polish, *best.pose)
        refinements += 1
    else:
        return about | {"refinements": refinements}, []
    fields = dict(zip(POSE, [*_quaternion(pose[0]).tolist(), *pose[1].tolist()], strict=True))
    return about | found | fields | {"refinements": refinements, "inlier_ratio": found["n_inliers"] / n}, trace


def _matrix(q: np.ndarray) -> np.ndarray:
    w, v = q[0], q[1:]
    skew = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return np.eye(3) + 2 * w * skew + 2 * skew @ skew


def estimate(edges: DataFrame, options: Options | None = None, cameras: DataFrame | None = None, **changes) -> DataFrame:
    """One row per pair of ``edges`` (pair_idx, left_idx, right_idx, x1, y1, x2, y2, p, left_c, right_c, and k for a proposal graph): SCHEMA.

    Points are calibrated and the threshold is in their units; with ``cameras`` (pair_idx, fx1, fy1, cx1, cy1, distortion1, and the same for 2)
    they are pixels, and so is the threshold: points are un-projected (``geometry.unproject``), the threshold is scaled by the mean inverse focal length.
    A pair that cannot be estimated is skipped with a message: ``invalid_feature_ids``, ``not_enough_matches``,
    ``proposal_graph_not_enough_o2o``, ``ransac_failed``; one without a camera with ``no_camera``.  Of several runs the one with the lowest model_score counts.
    """
    o = options or Options(**changes)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        row = dict.fromkeys(columns) | {"trace": [], "pair_idx": int(key[0]), "status": "skipped", "message": None, "n_edges": len(pdf), "iterations": 0, "refinements": 0, "n_inliers": 0, "cardinality": 0}
        pdf = pdf.sort_values(["left_idx", "right_idx"], kind="stable")
        if (pdf[["left_idx", "right_idx"]] < 0).any(axis=None):
            return pd.DataFrame([row | {"message": "invalid_feature_ids"}])
        if len(pdf) < o.sample:
            return pd.DataFrame([row | {"message": "not_enough_matches"}])
        if pdf["scale"].isna().any():
            return pd.DataFrame([row | {"message": "no_camera"}])
        pair = Pair(pdf, o, float(pdf["scale"].iloc[0]))
        if pair.room < o.sample:
            return pd.DataFrame([row | {"message": "proposal_graph_not_enough_o2o"}])
        began, best, tried = time.perf_counter(), None, 0
        for n in range(o.runs):
            found, trace = search(pair, np.random.default_rng([o.seed, int(key[0]), n]))
            tried += found["iterations"]
            if "model_score" in found and (best is None or found["model_score"] < best[0]["model_score"]):
                best = found, trace, n
        if best is None:
            return pd.DataFrame([row | {"message": "ransac_failed", "iterations": tried}])
        pair.spent["total_ms"] = 1000 * (time.perf_counter() - began)
        names = [c.split()[0] for c in _TRACE.split(", ")]
        trace = [dict(zip(names, x, strict=True)) for x in best[1]]
        return pd.DataFrame([row | {"status": "success", "run": best[2], "trace": trace} | best[0] | pair.spent])

    columns = edges.sparkSession.createDataFrame([], SCHEMA).columns
    chosen = ["pair_idx", "left_idx", "right_idx", "x1", "y1", "x2", "y2", "p", "left_c", "right_c", *["k"] * bool(o.proposal_k)]
    ready = edges.select(*chosen, F.lit(1.0).alias("scale")) if cameras is None else calibrated(edges.select(*chosen), cameras)
    return ready.groupBy("pair_idx").applyInPandas(lean(run), SCHEMA)


def calibrated(edges: DataFrame, cameras: DataFrame) -> DataFrame:
    """Edges in pixels as edges in calibrated units, with ``scale``, the pair's pixels in these units; both are null where a pair has no camera."""
    held = cameras.select("pair_idx", *(f"{c}{s}" for s in "12" for c in ("fx", "fy", "cx", "cy", "distortion")))
    focal = lambda s: (F.col(f"fx{s}") + F.col(f"fy{s}")) / 2
    for s in "12":
        point = g.unproject(F.col(f"x{s}"), F.col(f"y{s}"), *(F.col(f"{c}{s}") for c in ("fx", "fy", "cx", "cy", "distortion")))
        edges = (edges.join(held, "pair_idx", "left") if s == "1" else edges).withColumn(f"_{s}", point)
    moved = {f"{c}{s}": F.col(f"_{s}.{c}") for s in "12" for c in "xy"}
    return edges.withColumn("scale", g.threshold_scale(focal("1"), focal("2"))).withColumns(moved).drop("_1", "_2", *(c for c in held.columns if c != "pair_idx"))


def traces(results: DataFrame) -> DataFrame:
    """One row for each pool entry of each pair: the sidecar table beside the results."""
    return results.select("pair_idx", F.explode("trace").alias("t")).select("pair_idx", "t.*")


def probes(results: DataFrame, reference: DataFrame) -> DataFrame:
    """Per pair whether a reference score (pair_idx, hcm) would have entered the pool as it was at the end: there was room, or it is strictly better than the worst."""
    held = results.filter("status = 'success'").select("pair_idx", "pool_size", "pool_full", "pool_cutoff")
    return reference.join(held, "pair_idx", "left").withColumn("admitted", ~F.coalesce("pool_full", F.lit(False)) | (F.col("hcm") < F.col("pool_cutoff")))


def write_results(results: DataFrame, path: str, *labels: tuple[str, object]) -> None:
    """Results and their traces, each in folders named by the labels (mode, proposal, seed, ...): partition columns take the place of file names."""
    names = [n for n, _ in labels]
    named = results.withColumns({n: F.lit(v) for n, v in labels})
    for part, rows in (("results", named.drop("trace")), ("traces", named.select(*names, "pair_idx", F.explode("trace").alias("t")).select(*names, "pair_idx", "t.*"))):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*names).parquet(f"{path}/{part}")
