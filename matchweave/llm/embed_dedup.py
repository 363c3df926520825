"""Embedding near-dedup by NN-descent.

A neighbour graph inside each label is refined in rounds: the neighbours of a
vector, in both directions, are compared with each other where one of them is new,
and each keeps the best it meets.  The first lists come from small cells of
random hyperplanes, as many as the label's own size needs and more where a cell is full.  A list grows with
the links it holds, so that it is enlarged when saturated.  Rounds end when few lists change and an audit against brute force, on
a bounded sample of queries that grows until it holds enough links, finds enough of them; where it
does not, cells of other hyperplanes are added each round, and the run fails if that does not help.

The edges at or above the threshold are confirmed in double precision and give
components.  Where a vector has more links than a plain list holds, its whole component
is dense and its links are counted in blocks: tasks compare two blocks of bounded size and send
counts, not pairs, so no cap loses a link and none of the group's pairs is written out.  Blocks of
two dense components of the label are compared too where both have more vectors than the longest list holds,
as their own links may have filled the lists (a smaller component leaves room in its lists for links that lead out of it, which the
rounds find as any others), unless their centres are further apart than
their radii and the threshold's angle together, so no link can lie between them; components that
turn out to be linked become one.  A similarity that equals the threshold is a link, and of equally near neighbours
a list takes the smaller ids.  A last audit, which takes dense queries too, fails the run
if counts are short.

Equal vectors of a label are one point with a weight.  Vectors with a null label, and vectors that are null, empty, zero or
hold null or non-finite components, link with nothing, as do null ids; of different vectors with one id, the
smallest (label, vector) is compared and the others link with nothing.  Vectors of different lengths do not link.
An empty table gives an empty result; columns that are not named are not read, whatever their names.
"""

from __future__ import annotations

import functools
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchweave.llm.components import connected
from matchweave.llm.shared import Workspace

#: Random hyperplane trees, points in a cell, plain list length, longest list, rows of a counting block at least and at most, block centres in a tile, cells of work at least.
TREES, CELL, LIST, LONGEST, BLOCK, MOST_BLOCK, TILE, WORK = 4, 96, 10, 40, 160, 2048, 1024, 256
#: Single-precision similarities this far below the threshold still go to the exact check.
SLACK = 1e-5
#: Queries of the audit, how often they become four times as many while they hold fewer links than enough, enough links; recall that it asks for; rounds before cells are added, rounds at most.
AUDIT, GROWS, ENOUGH, RECALL, ROUNDS, MOST_ROUNDS = 256, 2, 200, 0.99, 8, 24
#: Queries whose best neighbour is so far below the threshold at most are asked where links are rare.
NEAR = 0.05
#: Bits of a hyperplane code.
BITS = 24


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _matrix(column, kind) -> np.ndarray:
    raw = [x.as_buffer() for x in column]
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1) if raw else np.zeros((0, 1), kind)


def _units(batches):
    """Unit vectors in double and single precision."""
    for batch in batches:
        wide, narrow = [], []
        for x in batch.column(3).to_pylist():
            v = np.array(x, np.float64)
            v /= np.abs(v).max()
            v /= np.sqrt(v @ v)
            wide.append(v.tobytes())
            narrow.append(v.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([len(x) // 8 for x in wide], pa.int32()), pa.array(wide, pa.binary()), pa.array(narrow, pa.binary())], names=["id", "label", "w", "dim", "wide", "narrow"])


def _codes(number: int):
    """A hyperplane code for each tree; each ``number`` has its own hyperplanes."""

    def run(batches):
        for batch in batches:
            dims, codes = batch.column(2).to_numpy(), np.zeros((len(batch), TREES), np.int32)
            for dim in np.unique(dims):
                here = np.flatnonzero(dims == dim)
                planes = np.random.default_rng([int(dim), number]).standard_normal((TREES * BITS, dim))
                bits = (_matrix(batch.column(3).take(pa.array(here)), np.float32) @ planes.T > 0).reshape(len(here), TREES, BITS)
                codes[here] = bits @ (1 << np.arange(BITS - 1, -1, -1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(list(codes), pa.list_(pa.int32()))], names=["id", "label", "dim", "codes"])

    return run


def _neighbours(ids: np.ndarray, near: np.ndarray, most: int):
    """The best ``most`` neighbours of each row of a similarity matrix with an empty diagonal."""
    most = min(most, len(ids) - 1)
    best = np.argpartition(-near, most - 1, 1)[:, :most] if most > 0 else np.zeros((len(ids), 0), int)
    return np.repeat(ids, most), ids[best].ravel(), np.take_along_axis(near, best, 1).ravel()


def _cell(kind: pa.DataType):
    def run(group: pa.Table) -> pa.Table:
        v = _matrix(group.column("narrow"), np.float32)
        near = v @ v.T
        np.fill_diagonal(near, -2)
        a, b, s = _neighbours(group.column("id").to_numpy(), near, LIST)
        return pa.table({"u": pa.array(a, kind), "v": pa.array(b, kind), "s": pa.array(s, pa.float32())})

    return run


def _first(space: Workspace, points: DataFrame, number: int, id_type: str, label_type: str, kind: pa.DataType) -> DataFrame:
    """Edges of all pairs inside small cells.  The bits of a cell follow the size of its label, and full cells take more; one that all bits leave full is split by chance."""
    own = points.groupBy("label", "dim").agg(F.ceil(F.log2(F.count("*") / CELL)).alias("depth")).select("label", "dim", F.least(F.greatest("depth", F.lit(0)), F.lit(BITS)).cast("int").alias("depth"))
    coded = points.select("id", "label", "dim", "narrow").mapInArrow(_codes(number), f"id {id_type}, label {label_type}, dim int, codes array<int>")
    left = coded.join(own, ["label", "dim"]).select("id", "label", "dim", "depth", F.posexplode("codes").alias("tree", "code"))
    left, done, step = space.table(left, f"codes-{number}"), [], 0
    while step == 0 or not left.isEmpty():
        keyed = left.withColumn("cell", F.xxhash64("label", "dim", "tree", "depth", F.expr(f"shiftright(code, {BITS} - depth)")))
        sized = space.table(keyed.join(keyed.groupBy("cell").agg(F.count("*").alias("size")), "cell"), f"cells-{number}-{step}")
        open_ = (F.col("size") > 2 * CELL) & (F.col("depth") < BITS)
        done.append(sized.filter(~open_).select("id", "tree", "cell", "size"))
        more = F.greatest(F.lit(2), F.ceil(F.log2(F.col("size") / CELL)))
        left, step = sized.filter(open_).select("id", "label", "dim", F.least(F.lit(BITS), F.col("depth") + more).cast("int").alias("depth"), "tree", "code"), step + 1
    cells = functools.reduce(DataFrame.unionByName, done)
    split = cells.withColumn("part", F.pmod(F.xxhash64("id", "tree"), F.ceil(F.col("size") / (2 * CELL)))).join(points.select("id", "label", "dim", "narrow"), "id")
    edges = split.select("cell", "part", "label", "dim", "id", "narrow").groupBy("cell", "part", "label", "dim").applyInArrow(_cell(kind), f"u {id_type}, v {id_type}, s float")
    return edges.withColumn("fresh", F.lit(True))


def _descend(kind: pa.DataType):
    """One cell of work: for many neighbourhoods, the pairs with a new member that are better than what one of the two has."""

    def run(group: pa.Table) -> pa.Table:
        order = np.lexsort((group.column("part").to_numpy(), group.column("w").to_numpy()))
        key = np.stack((group.column("w").to_numpy()[order], group.column("part").to_numpy()[order]))
        ids, floor, fresh = group.column("x").to_numpy()[order], group.column("floor").to_numpy()[order], group.column("fresh").to_numpy(zero_copy_only=False)[order]
        v = _matrix(group.column("narrow"), np.float32)[order]
        cuts = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [len(ids)]))
        out = [[], [], []]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if fresh[a:b].any():
                near = v[a:b] @ v[a:b].T
                np.fill_diagonal(near, -2)
                i, j = np.nonzero((near > floor[a:b, None]) & (fresh[a:b, None] | fresh[None, a:b]))
                for x, y in zip(out, (ids[a:b][i], ids[a:b][j], near[i, j]), strict=True):
                    x.append(y)
        u, v_, s = (np.concatenate(x) if x else np.zeros(0) for x in out)
        if len(u):  # a pair met in several neighbourhoods counts once
            once = np.unique(np.stack((u, v_)), axis=1, return_index=True)[1]
            u, v_, s = u[once], v_[once], s[once]
        return pa.table({"u": pa.array(u, kind), "v": pa.array(v_, kind), "s": pa.array(s, pa.float32())})

    return run


def _best(rows: DataFrame, threshold: float) -> DataFrame:
    """Each vector's best neighbours: LIST of them, or twice its links if these are more, LONGEST at most."""
    once = rows.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    mine = Window.partitionBy("u")
    ranked = once.withColumns({"rank": F.row_number().over(mine.orderBy(F.desc("s"), "v")), "close": F.sum((F.col("s") >= threshold - SLACK).cast("int")).over(mine)})
    return ranked.filter(F.col("rank") <= F.greatest(F.lit(LIST), F.least(F.lit(LONGEST), 2 * F.col("close")))).drop("rank")


def _exact(threshold: float):
    def run(batches):
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            sizes = np.array([len(x.as_buffer()) for x in batch.column(2)], np.int64)
            for size in np.unique(sizes):
                here = np.flatnonzero(sizes == size)
                a, b = (_matrix(batch.column(c).take(pa.array(here)), np.float64) for c in (2, 3))
                keep[here] = np.einsum("ij,ij->i", a, b) >= threshold
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    return run


def _truth(points: DataFrame, graph: DataFrame, threshold: float, n: int) -> dict:
    """Links of the sampled queries by brute force, id -> (linked points, their weight with the query's equals left out).

    The sample is AUDIT points, and four times as many, GROWS times at most, while it holds too few links and is not the whole table.  Where links are rare
    the same number is asked again of points whose best neighbour so far comes near the threshold, so that the audit has links to count.
    """
    for step in range(GROWS + 1):
        truth = _asked(points, threshold, AUDIT * 4**step)
        if sum(x for x, _ in truth.values()) >= ENOUGH or len(truth) >= n:
            return truth
    likely = graph.filter(F.col("s") >= threshold - NEAR).select(F.col("u").alias("id")).distinct()
    truth |= _asked(points.join(likely, "id", "left_semi"), threshold, AUDIT * 4**GROWS, points)
    if sum(x for x, _ in truth.values()) < ENOUGH:
        warnings.warn(f"near_duplicates: {len(truth)} of {n} vectors hold {sum(x for x, _ in truth.values())} links, too few for a sure audit", stacklevel=3)
    return truth


def _asked(pool: DataFrame, threshold: float, most: int, points: DataFrame | None = None) -> dict:
    """Links of some vectors of ``pool`` in all of ``points`` (else of the pool)."""
    points = pool if points is None else points
    sample = pool.orderBy(F.xxhash64(F.lit("audit"), F.col("id")), "id").limit(most).select("id", "label", "dim", "w", "wide").collect()
    queries: dict = {}
    for r in sample:
        queries.setdefault((r.label, r.dim), []).append((r.id, r.w, np.frombuffer(r.wide, np.float64)))
    queries = {k: ([i for i, _, _ in x], [w for _, w, _ in x], np.stack([v for _, _, v in x])) for k, x in queries.items()}

    def count(batches):
        for batch in batches:
            total: dict = {}
            rows: dict = {}
            weight = batch.column(2).to_numpy()
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                rows.setdefault(key, []).append(i)
            for key, here in rows.items():
                if key in queries:
                    (ids, _, q), v = queries[key], _matrix(batch.column(3).take(pa.array(here)), np.float64)
                    for k in range(0, len(ids), AUDIT):  # so that the similarities stay small
                        near = v @ q[k : k + AUDIT].T >= threshold
                        total |= dict(zip(ids[k : k + AUDIT], zip(near.sum(0).tolist(), (weight[here] @ near).tolist(), strict=True), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([w for _, w in total.values()], pa.int64())], names=["id", "n", "w"])

    own = {i: w for ids, ws, _ in queries.values() for i, w in zip(ids, ws, strict=True)}
    every = points.select("label", "dim", "w", "wide").mapInArrow(count, "id long, n long, w long").groupBy("id").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect()
    return {r.id: (r.n - 1, r.w - own[r.id]) for r in every}  # a vector is near itself


def _recall(true: dict, held: dict) -> float:
    """The share of the true links, id -> number, that is held; a tie at the threshold that rounds the other way counts for no other query."""
    wanted = sum(true.values())
    return sum(min(held.get(i, 0), n) for i, n in true.items()) / wanted if wanted > 0 else 1.0


def _audit(truth: dict, graph: DataFrame, threshold: float) -> float:
    """The share of the sampled queries' links that the graph holds.

    Queries whose list is full of links are left out: their links are counted exactly later, and audited then.
    """
    held = {r.u: r["count"] for r in graph.filter(F.col("u").isin(list(truth)) & (F.col("s") >= threshold - SLACK)).groupBy("u").count().collect()}
    return _recall({i: n for i, (n, _) in truth.items() if held.get(i, 0) < LIST}, held)


def _pack(kind: pa.DataType):
    """A block in one row, with its unit centre and its radius, the largest angle between the centre and a member."""

    def run(group: pa.Table) -> pa.Table:
        first = {c: group.column(c).take([0]) for c in ("label", "dim", "component", "block", "crowded")}
        ids, w = group.column("id").to_numpy().astype(np.int64), group.column("w").to_numpy().astype(np.int64)
        v = _matrix(group.column("wide"), np.float64)
        centre = v.sum(0)
        centre = centre / size if (size := np.sqrt(centre @ centre)) > 1e-9 else v[0]
        radius = float(np.arccos(np.clip(v @ centre, -1, 1)).max())
        return pa.table({**first, "ids": pa.array([ids.tobytes()], pa.binary()), "ws": pa.array([w.tobytes()], pa.binary()), "vs": pa.array([v.tobytes()], pa.binary()), "centre": pa.array([centre.tobytes()], pa.binary()), "radius": pa.array([radius], pa.float64())})

    return run


def _close(threshold: float):
    """Two tiles of block centres (or one with itself): the pairs of blocks that a link can lie between, by the triangle inequality of angles."""
    angle = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6

    def run(group: pa.Table) -> pa.Table:
        tile, low = group.column("tile").to_numpy(), group.column("low").to_numpy()[0]
        key, r, c = group.column("key").to_numpy(), group.column("radius").to_numpy(), _matrix(group.column("centre"), np.float64)
        x = np.flatnonzero(tile == low)
        y = x if group.column("high").to_numpy()[0] == low else np.flatnonzero(tile != low)
        i, j = np.nonzero(np.arccos(np.clip(c[x] @ c[y].T, -1, 1)) <= r[x][:, None] + r[y][None, :] + angle)
        a, b = key[x[i]], key[y[j]]
        if y is x:
            a, b = a[a <= b], b[a <= b]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _count(threshold: float, kind: pa.DataType):
    """Two blocks (or one with itself): the weight of each vector's links in the other, and both components."""

    def run(group: pa.Table) -> pa.Table:
        read = lambda name, t: [np.frombuffer(x.as_buffer(), t) for x in group.column(name)]
        ids, ws, c = read("ids", np.int64), read("ws", np.int64), group.column("component").to_numpy()
        vs = [x.reshape(len(i), -1) for x, i in zip(read("vs", np.float64), ids, strict=True)]
        near = vs[0] @ vs[-1].T >= threshold
        if len(ids) == 1:
            np.fill_diagonal(near, False)
            u, n = ids[0], near @ ws[0]
            mine = other = np.repeat(c, len(u))
        else:
            u, n = np.concatenate(ids), np.concatenate((near @ ws[1], near.T @ ws[0]))
            mine, other = np.repeat(c, [len(i) for i in ids]), np.repeat(c[::-1], [len(i) for i in ids])
        some = n > 0
        return pa.table({"id": pa.array(u[some], kind), "n": pa.array(n[some], pa.int64()), "a": pa.array(mine[some], kind), "b": pa.array(other[some], kind)})

    return run


def near_duplicates(vectors: DataFrame, space: Workspace, threshold: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Per vector: id, n_links (other vectors of its label with a cosine >= threshold), component_id (smallest id reachable by links, itself included), kept (id = component_id).

    The id is an integer column.
    """
    id_type = vectors.schema[vec_id].dataType.simpleString()
    kind = pa.int64() if id_type == "bigint" else pa.int32()
    label_type = vectors.schema[label].dataType.simpleString()
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("v"), F.col(label).alias("label"))
    fine = rows.filter(usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    distinct = fine.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("w"))
    chosen = distinct.groupBy("id").agg(F.min(F.struct("label", "v", "w")).alias("p")).select("id", "p.label", "p.w", "p.v")
    reps = space.table(chosen, "reps")
    points = space.table(reps.select("id", "label", "w", "v").mapInArrow(_units, f"id {id_type}, label {label_type}, w long, dim int, wide binary, narrow binary"), "points")

    n = points.count()
    edge = f"u {id_type}, v {id_type}, s float"
    graph = space.table(_best(_first(space, points, 0, id_type, label_type, kind), threshold), "graph-0")

    truth, short = _truth(points, graph, threshold, n), False
    for number in range(1, MOST_ROUNDS + 1):
        lists = graph.groupBy("u").agg(F.count("*").alias("held"), F.first("close").alias("close"), F.min("s").alias("least"))
        full = F.col("held") >= F.greatest(F.lit(LIST), F.least(F.lit(LONGEST), 2 * F.col("close")))
        floor = F.when(full, F.col("least")).when(F.col("close") >= LIST, threshold - SLACK).otherwise(-2.0).cast("float")
        state = space.table(points.select(F.col("id").alias("x"), "dim", "narrow").join(lists.select(F.col("u").alias("x"), floor.alias("floor")), "x"), f"state-{number}")
        sides = graph.select(F.col("u").alias("w"), F.col("v").alias("x"), "fresh").unionByName(graph.select(F.col("v").alias("w"), F.col("u").alias("x"), "fresh"))
        around = sides.groupBy("w", "x").agg(F.max("fresh").alias("fresh"))
        # neighbourhoods of hubs are taken in parts, each time in another order
        place = F.row_number().over(Window.partitionBy("w").orderBy(F.xxhash64("x", F.lit(number))))
        parts = space.table(around.withColumn("part", F.floor((place - 1) / (2 * LONGEST)).cast("long")), f"around-{number}")
        work = max(WORK, n // 500)
        near = parts.join(state, "x").withColumn("cell", F.pmod(F.xxhash64("w", "part"), F.lit(work)))
        better = near.select("cell", "dim", "w", "part", "x", "floor", "fresh", "narrow").groupBy("cell", "dim").applyInArrow(_descend(kind), edge)
        merged = graph.select("u", "v", "s", F.lit(False).alias("fresh")).unionByName(better.withColumn("fresh", F.lit(True)))
        if short:
            merged = merged.unionByName(_first(space, points, number, id_type, label_type, kind))
        graph = space.table(_best(merged, threshold), f"graph-{number}")
        space.drop(f"state-{number}", f"around-{number}", f"graph-{number - 1}")
        changed = graph.agg(F.sum(F.col("fresh").cast("int"))).first()[0] or 0
        if changed <= 0.02 * LIST * n or number >= ROUNDS:
            recall = _audit(truth, graph, threshold)
            if recall >= RECALL:
                break
            short = True
    else:
        raise RuntimeError(f"near_duplicates: after {MOST_ROUNDS} rounds the audit finds {recall:.4f} of the sampled vectors' links, below {RECALL}")

    close = graph.filter(F.col("s") >= threshold - SLACK).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    wide = points.select("id", "wide")
    both = close.join(wide.select(F.col("id").alias("a"), F.col("wide").alias("x")), "a").join(wide.select(F.col("id").alias("b"), F.col("wide").alias("y")), "b")
    links = space.table(both.select("a", "b", "x", "y").mapInArrow(_exact(threshold), f"a {id_type}, b {id_type}"), "links")
    found = space.table(connected(space, links), "found")

    # components with a vector that has more links than a plain list holds are counted in blocks, with each other where blocks are close
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    many = ends.groupBy("a").count().filter(F.col("count") >= LIST).select(F.col("a").alias("id"))
    dense = space.table(found.join(many, "id").select("component").distinct(), "dense")
    # each block is sent once for each block it is compared with, so blocks grow with the component
    rows_of_block = F.least(F.lit(float(MOST_BLOCK)), F.greatest(F.lit(float(BLOCK)), 8 * F.sqrt(F.count("*"))))
    size = space.table(found.join(dense, "component").groupBy("component").agg(F.ceil(F.count("*") / rows_of_block).alias("blocks"), (F.count("*") > LONGEST).alias("crowded")), "dense-sizes")
    members = found.join(size, "component").join(points.select("id", "label", "dim", "w", "wide"), "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    packed = members.groupBy("component", "block", "crowded").applyInArrow(_pack(kind), f"label {label_type}, dim int, component {id_type}, block long, crowded boolean, ids binary, ws binary, vs binary, centre binary, radius double")
    packed = space.table(packed.withColumn("key", F.monotonically_increasing_id()), "packed")
    # a component that leaves room in its lists is one block and is compared with itself alone, so the tiles hold crowded ones only
    alone, crowded = packed.filter("NOT crowded").select(F.col("key").alias("a"), F.col("key").alias("b")), packed.filter("crowded")
    tiles = space.table(crowded.groupBy("label", "dim").agg(F.ceil(F.count("*") / TILE).alias("tiles")), "tiles")
    tiled = crowded.select("label", "dim", "key", "centre", "radius").join(tiles, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    tiled = tiled.select("label", "dim", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "key", "centre", "radius")
    pairs = space.table(tiled.groupBy("label", "dim", "low", "high").applyInArrow(_close(threshold), "a long, b long").unionByName(alone), "block-pairs")
    compared = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("key")).join(packed.select("key", "component", "ids", "ws", "vs"), "key").select("a", "b", "component", "ids", "ws", "vs")
    counted = compared.groupBy("a", "b").applyInArrow(_count(threshold, kind), f"id {id_type}, n long, a {id_type}, b {id_type}")
    counted = space.table(counted.groupBy("id", "a", "b").agg(F.sum("n").alias("n")), "counted")
    listed = ends.join(points.select(F.col("id").alias("b"), "w"), "b").select(F.col("a").alias("id"), F.col("w").alias("n")).join(found, "id").join(dense, "component", "left_anti").select("id", "n")
    total = space.table(counted.select("id", "n").unionByName(listed).groupBy("id").agg(F.sum("n").alias("n")), "totals")
    merged = connected(space, counted.filter("a != b").select("a", "b").distinct(), "merged").select(F.col("id").alias("component"), F.col("component").alias("least"))
    found = space.table(found.join(merged, "component", "left").select("id", F.coalesce("least", "component").alias("component")), "found-merged")
    recall = _recall({i: w for i, (_, w) in truth.items()}, {r.id: r.n for r in total.filter(F.col("id").isin(list(truth))).collect()})
    if recall < RECALL:
        raise RuntimeError(f"near_duplicates: the last audit finds {recall:.4f} of the sampled vectors' links, below {RECALL}")

    about = reps.select(F.col("id").alias("rep"), "label", "v", "w").join(total.withColumnRenamed("id", "rep"), "rep", "left").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    about = space.table(about.select("rep", "label", "v", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c")), "about")
    space.clear("about")
    whole = rows.withColumn("label", F.when(usable(F.col("v")) & F.col("id").isNotNull(), F.col("label"))).join(about, ["label", "v"], "left")
    component = F.coalesce("c", "id")
    return whole.select(F.col("id").alias(vec_id), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
