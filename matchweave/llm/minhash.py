"""MinHash near-dedup with b-bit signatures.

One pass over the texts gives each document the size and a 128-bit hash of its
shingle set, keys of bands of minima, and the low bits of all minima packed into
longs.  Documents with equal sets are one class and go on as one representative.
Representatives that share a band key are candidates; the similarity of a
candidate pair is estimated from equal bit groups of the packed signatures,
corrected for chance collisions, and only pairs more than five standard
deviations below the threshold are dropped by it.  The rest are confirmed on full sets.

Not all pairs of a bucket are written out.  Every member is compared with the
bucket's smallest one; confirmed links give components.  What is left are pairs of different
components that share a band key.  A key with few members gives them one by one.  A key
with many is split into blocks: a task meets the packed signatures of two blocks of bounded size, finds the pairs of
different components that the estimate lets pass and that share no earlier key, and names the documents
that have any; a second task meets the sets of these documents, counts all intersections by matrix products, and returns one link for
two components at most.  Pairs inside a component cannot change it, so no link is
lost, and thousands of near copies cost as many rows as there are copies.

Words, shingles and sets are compared by hashes that are not linear (``shared.span_hashes``): 64 bits of a shingle where two documents'
sets are compared, two independent sums of 64 bits where equal sets become one class.  Two documents with s shingles in all
get a wrong intersection with a probability below s**2 / 2**65, two different sets are one class with one of about 2**-128.

Null and empty texts have an empty set and link with nothing; so do null ids, whose
component is null and which are kept.  Rows with equal ids are one node.  Ids are integers.  An empty table gives an empty result; texts
and words of any length are taken whole, in memory that grows with one text; columns that are not named are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchweave.llm.components import connected
from matchweave.llm.shared import Workspace, block_words, blocks, broadcast_if_small, lean, mix, mix_other, pair

#: Bands and minima of a band (a pair of similarity 0.8 shares none with a probability of 3e-6), bits kept of each minimum.
BANDS, ROWS, BITS = 32, 5, 2
#: Members of a key that are still compared one by one; documents of a block, shingles of a block; shingles that a matrix product takes at once.
FEW, BLOCK, SHINGLES, COLUMNS = 32, 192, 1 << 19, 4096


def _functions() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240229)
    n = BANDS * ROWS
    return random.integers(1 << 62, 1 << 63, n, dtype=np.uint64) | np.uint64(1), random.integers(0, 1 << 63, n, dtype=np.uint64)


def _windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on."""
    whole = h
    with np.errstate(over="ignore"):
        for j in range(1, n):
            whole = pair(whole[:-1], h[j:]) if len(whole) > 1 else whole[:0]
    return whole


def _sequence(h: np.ndarray) -> np.ndarray:
    """One hash of all words."""
    folded = np.full(1, len(h), np.uint64)
    with np.errstate(over="ignore"):
        for x in h:
            folded = pair(folded, np.full(1, x, np.uint64), 1)
    return folded


def _cut(h: np.ndarray, whole: np.ndarray, a: int, b: int, n: int) -> np.ndarray:
    """The shingles of the words a to b: fewer than n are one, none are none."""
    return whole[a : b - n + 1] if b - a >= n else _sequence(h[a:b]) if b > a else h[:0]


def shingle_sets(raws: list[bytes], n: int):
    """The distinct hashed n-word shingles of each text, A-Z folded."""
    h, first = block_words(raws, lower=True)[::4]
    whole = _windows(h, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.unique(_cut(h, whole, a, b, n))


def named_sets(raws: list[bytes], n: int):
    """The same, each with two sums that stand for the set: over these hashes, and over others of the same shingles that are independent of them."""
    (h, first), other = block_words(raws, lower=True)[::4], block_words(raws, lower=True, second=True)[0]
    whole, whole_other = _windows(h, n), _windows(other, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        s, at = np.unique(_cut(h, whole, a, b, n), return_index=True)
        with np.errstate(over="ignore"):
            sums = [x.sum(dtype=np.uint64).view(np.int64) for x in (mix(s + np.uint64(1)), mix_other(_cut(other, whole_other, a, b, n)[at] + np.uint64(1)))]
        yield s, int(sums[0]), int(sums[1])


def minima(shingles: np.ndarray, up: np.ndarray, plus: np.ndarray) -> np.ndarray:
    out = np.full(len(up), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        out = np.minimum(out, (shingles[at : at + 4096] * up[:, None] + plus[:, None]).min(1))
    return out


def _signatures(n: int):
    up, plus = _functions()
    per_long = 64 // BITS
    shifts = np.arange(0, 64, BITS, dtype=np.uint64)

    def run(batches):
        for batch in batches:
            size, sets, bands, packed = [], [], [], []
            with np.errstate(over="ignore"):
                for _, raws in blocks(batch.column(1).to_pylist()):
                    for s, *names in named_sets(raws, n):
                        size.append(len(s))
                        sets.append(names)
                        if not len(s):
                            bands.append([])
                            packed.append([0] * (len(up) // per_long))
                            continue
                        least = minima(s, up, plus)
                        key = np.arange(BANDS, dtype=np.uint64)
                        for column in least.reshape(BANDS, ROWS).T:
                            key = pair(key, column)
                        bands.append(key.view(np.int64))
                        low = ((least >> np.uint64(32)) & np.uint64((1 << BITS) - 1)).reshape(-1, per_long)
                        packed.append(np.bitwise_or.reduce(low << shifts, axis=1).view(np.int64))
            longs = pa.list_(pa.int64())
            first, second = zip(*sets, strict=True) if sets else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(bands, longs), pa.array(packed, longs)], names=["id", "n_shingles", "s1", "s2", "bands", "sig"])

    return run


def estimate(a: Column, b: Column) -> Column:
    """Collision-corrected similarity from two packed signatures: equal bit groups counted by bit operations."""
    unequal = F.lit(0)
    for i in range(BANDS * ROWS * BITS // 64):
        x = a[i].bitwiseXOR(b[i])
        groups = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        unequal = unequal + F.bit_count(groups)
    chance = 0.5**BITS
    equal = F.lit(1.0) - unequal / (BANDS * ROWS)
    return (equal - chance) / (1 - chance)


def most_unequal(least: float) -> int:
    """The most unequal bit groups of two signatures with an estimate of ``least`` or more."""
    return int(np.floor(BANDS * ROWS * (1 - (least * (1 - 0.5**BITS) + 0.5**BITS)) + 1e-9))


def least_estimate(threshold: float) -> float:
    """Five standard deviations of the estimate below the threshold."""
    chance = 0.5**BITS
    f = threshold + (1 - threshold) * chance
    return threshold - 5 * (f * (1 - f) / (BANDS * ROWS)) ** 0.5 / (1 - chance)


def _sets(n: int):
    def run(batches):
        for batch in batches:
            sets = [s.tobytes() for _, raws in blocks(batch.column(1).to_pylist()) for s in shingle_sets(raws, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return run


def _compare(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                shared = int((y[at] == x).sum()) if len(y) else 0
                keep.append(bool(shared) and 100 * shared >= percent * (len(x) + len(y) - shared))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    return run


def _shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all sets of one list with all of another."""
    whole = [np.concatenate(x) for x in (a, b)]
    both = np.intersect1d(*whole)
    out = np.zeros((len(a), len(b)), np.float64)
    row = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    at = [np.searchsorted(both, x) for x in whole]
    here = [np.append(both, np.uint64(0))[p] == x if len(both) else np.zeros(len(x), bool) for p, x in zip(at, whole, strict=True)]
    row, at = [r[h] for r, h in zip(row, here, strict=True)], [p[h] for p, h in zip(at, here, strict=True)]
    order = [np.argsort(p, kind="stable") for p in at]
    row, at = [r[o] for r, o in zip(row, order, strict=True)], [p[o] for p, o in zip(at, order, strict=True)]
    for low in range(0, len(both), COLUMNS):
        sides = []
        for r, p, n in zip(row, at, out.shape, strict=True):
            x, y = np.searchsorted(p, [low, low + COLUMNS])
            side = np.zeros((n, min(COLUMNS, len(both) - low)), np.float32)
            side[r[x:y], p[x:y] - low] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _pack(group: pa.Table) -> pa.Table:
    """A block in one row."""
    first = {c: group.column(c).take([0]) for c in ("key", "block", "only")}
    flat = lambda c: pa.array([np.asarray(group.column(c).combine_chunks().flatten()).astype(np.int64).tobytes()], pa.binary())
    plain = lambda c: pa.array([group.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary())
    return pa.table({**first, "ids": plain("id"), "cs": plain("c"), "sigs": flat("sig"), "bands": flat("bands")})


def _candidates(most: int, kind: pa.DataType):
    """Two blocks of a key (or one with itself): the documents of pairs of different components that the estimate lets pass and that share no earlier key."""
    pattern = np.uint64(0x5555555555555555)

    def run(group: pa.Table) -> pa.Table:
        read = lambda c: [np.frombuffer(x.as_buffer(), np.int64) for x in group.column(c)]
        ids, cs = read("ids"), read("cs")
        sigs, bands = ([x.reshape(len(i), -1) for x, i in zip(read(c), ids, strict=True)] for c in ("sigs", "bands"))
        a, b = sigs[0].view(np.uint64), sigs[-1].view(np.uint64)
        unequal = np.zeros((len(a), len(b)), np.int16)
        for k in range(a.shape[1]):
            x = a[:, k, None] ^ b[None, :, k]
            unequal += np.bitwise_count((x | (x >> np.uint64(1))) & pattern)
        i, j = np.nonzero((unequal <= most) & (cs[0][:, None] != cs[-1][None, :]))
        key, found = group.column("key")[0].as_py(), [np.zeros(len(x), bool) for x in ids]
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            place = (bands[0][x] == bands[-1][y]).argmax(1)
            mine = bands[0][x, place] == key
            found[0][x[mine]] = True
            found[-1][y[mine]] = True
        some = np.concatenate([x[f] for x, f in zip(ids, found, strict=True)])
        whose = np.concatenate([x[f] for x, f in zip(cs, found, strict=True)])
        cell = {c: pa.array([group.column(c)[0].as_py()] * len(some), pa.int64()) for c in ("key", "low", "high")}
        return pa.table({**cell, "id": pa.array(some, kind), "c": pa.array(whose, kind)})

    return run


def _bridges(percent: int, kind: pa.DataType):
    """Documents of one cell: for components that a link joins, one link that does."""

    def run(group: pa.Table) -> pa.Table:
        ids, c, sets = group.column("id").to_numpy(), group.column("c").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
        shared = _shared_counts(sets, sets)
        size = np.array([len(x) for x in sets])
        i, j = np.nonzero((100 * shared >= percent * (size[:, None] + size[None, :] - shared)) & (c[:, None] < c[None, :]))
        up: dict = {}

        def top(x):
            while x in up:
                x = up[x]
            return x

        out = []
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = top(c[x]), top(c[y])
            if p != q:
                up[max(p, q)] = min(p, q)
                out.append((x, y))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(ids[list(a)], kind), "b": pa.array(ids[list(b)], kind)})

    return run


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def _sets_of(space: Workspace, docs: DataFrame, ids: DataFrame, n: int, kind: str, name: str) -> DataFrame:
    """(id, shingles) of the ids, as a table."""
    ids = space.table(ids.distinct(), f"{name}-ids")
    return space.table(docs.join(broadcast_if_small(ids), "id", "left_semi").select("id", "text").mapInArrow(lean(_sets(n)), f"id {kind}, shingles binary"), f"{name}-sets")


def _confirm(space: Workspace, pairs: DataFrame, sets: DataFrame, percent: int, kind: str, name: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough, as a table."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return space.table(both.select("a", "b", "x", "y").mapInArrow(lean(_compare(percent)), f"a {kind}, b {kind}"), f"{name}-links")


def _inside(space: Workspace, members: DataFrame, reps: DataFrame, docs: DataFrame, n: int, percent: int, kind: str) -> DataFrame:
    """Links between different components ``c`` of the ``members`` (key, id, n_shingles, c) of keys with many of them, as a table; enough of them to join what any link joins."""
    arrow = pa.int64() if kind == "bigint" else pa.int32()
    sized = members.groupBy("key", "c").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / SHINGLES))
    sized = space.table(sized.withColumn("parts", parts), "sized")
    # a large component has blocks of its own, so that they need not be compared with each other; small ones share blocks
    rest = sized.groupBy("key").agg(F.greatest(*(F.ceil(F.sum(F.when(F.col("parts") == 1, F.col(c))) / most) for c, most in (("n", BLOCK), ("s", SHINGLES)))).alias("rest"))
    large = F.col("parts") > 1
    own = F.xxhash64("c", F.pmod(F.xxhash64("id"), F.col("parts")))
    small = F.xxhash64(F.pmod(F.xxhash64("c"), F.col("rest")), F.lit("small"))
    placed = members.join(broadcast_if_small(sized).select("key", "c", "parts"), ["key", "c"]).join(rest, "key")
    placed = placed.select("id", "key", "c", F.when(large, own).otherwise(small).alias("block"), F.when(large, F.col("c")).alias("only"))
    packed = placed.join(reps.select("id", "sig", "bands"), "id").groupBy("key", "block").applyInArrow(_pack, f"key long, block long, only {kind}, ids binary, cs binary, sigs binary, bands binary")
    packed = space.table(packed, "packed")
    low, high = (packed.select("key", F.col("block").alias(name), F.col("only").alias(f"{name}_only")) for name in ("low", "high"))
    cells = low.join(high, "key").filter((F.col("low") <= F.col("high")) & ~F.coalesce(F.col("low_only") == F.col("high_only"), F.lit(False)))
    sides = cells.select("key", "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block")).join(packed.drop("only"), ["key", "block"])
    some = sides.groupBy("key", "low", "high").applyInArrow(_candidates(most_unequal(least_estimate(percent / 100)), arrow), f"key long, low long, high long, id {kind}, c {kind}")
    some = space.table(some, "candidates")
    sets = _sets_of(space, docs, some.select("id"), n, kind, "inside")
    return space.table(some.join(sets, "id").groupBy("key", "low", "high").applyInArrow(_bridges(percent, arrow), f"a {kind}, b {kind}"), "inside-links")


def near_duplicates(docs: DataFrame, space: Workspace, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_shingles, component_id (smallest id reachable by links, itself included), kept (id = component_id).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of n-word shingles.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    signed = space.table(source.mapInArrow(lean(_signatures(n)), f"id {kind}, n_shingles long, s1 long, s2 long, bands array<long>, sig array<long>"), "signed")
    usable = signed.filter("n_shingles > 0 AND id IS NOT NULL")
    classes = space.table(usable.groupBy("s1", "s2", "n_shingles").agg(F.min("id").alias("rep")), "classes")
    reps = space.table(usable.join(classes.withColumnRenamed("rep", "id"), ["id", "s1", "s2", "n_shingles"], "left_semi").dropDuplicates(["id", "s1", "s2", "n_shingles"]).select("id", "n_shingles", "bands", "sig"), "reps")
    keyed = reps.select("id", "n_shingles", F.explode("bands").alias("key"))
    shared = space.table(keyed.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z").select("key", "a"), "shared")
    sig = reps.select("id", "sig")
    floor = least_estimate(percent / 100)

    # every member with the smallest of its bucket
    stars = space.table(keyed.join(shared, "key").filter("id != a").select("a", F.col("id").alias("b")).distinct(), "stars")
    alike = stars.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    alike = space.table(alike.filter(estimate(F.col("sa"), F.col("sb")) >= floor).select("a", "b"), "alike")
    sets = _sets_of(space, source, _ends(alike), n, kind, "first")
    links = _confirm(space, alike, sets, percent, kind, "first")
    found = space.table(connected(space, links, "first-components"), "first-found")

    # what is left: pairs of different components that share a key
    members = keyed.join(shared.select("key"), "key").join(found, "id", "left").select("key", "id", "n_shingles", F.coalesce("component", "id").alias("c"))
    members = space.table(members, "members")
    split = space.table(members.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("m")).filter("low < high").select("key", "m"), "split")
    few = space.table(members.join(split.filter(F.col("m") <= FEW).select("key"), "key").join(sig, "id"), "few")
    left, right = (few.select("key", *(F.col(c).alias(f"{c}{side}") for c in ("id", "c", "sig"))) for side in "ab")
    apart = left.join(right, "key").filter((F.col("ida") < F.col("idb")) & (F.col("ca") != F.col("cb")) & (estimate(F.col("siga"), F.col("sigb")) >= floor))
    pairs = space.table(apart.select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct(), "pairs")
    more = [_confirm(space, pairs, _sets_of(space, source, _ends(pairs), n, kind, "second"), percent, kind, "second")] if not pairs.isEmpty() else []
    many = split.filter(F.col("m") > FEW).select("key")
    if not many.isEmpty():
        more.append(_inside(space, members.join(broadcast_if_small(many), "key"), reps, source, n, percent, kind))
    more = [x for x in more if not x.isEmpty()]
    if more:
        known = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
        found = space.table(connected(space, functools.reduce(DataFrame.unionByName, more, known), "second-components"), "second-found")

    whole = signed.select("id", "n_shingles", "s1", "s2").join(classes, ["s1", "s2", "n_shingles"], "left").join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    answer = whole.select(F.col("id").alias(doc_id), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
    answer = space.table(answer, "answer")
    space.clear("answer")
    return answer
