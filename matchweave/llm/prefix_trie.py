"""The trie of all conversation prefixes, with members, leaves and tokens saved by sharing.

A node is a distinct sequence of first turns.  It is named by its depth and 128 bits: the exclusive-or, over the places of the sequence, of a hash
of (place, turn), where a turn is 128 bits of BLAKE2b over role and text.  Such names are running sums along a conversation, so a conversation of
any length is named block by block and never meets in one task.

Partitions emit partial tries: node tables combined from the rows at hand, with the members' count and smallest id, and the ids that end at the node.
Partial tries merge: rounds of merging by (node, salt) with ever fewer salts add members and join end lists, which are kept in
pieces by ranges of ids, so that neither a common node nor a long list meets in one task.  The way back up is a sum too: a node's
weight (its saved tokens, and one if it has no children) is put on the row of its smallest member; along each conversation the weights are summed from the last
turn upwards; and the sums of a node's members are the total of its subtree, again merged from partial sums.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchweave.llm.shared import Workspace, lean, utf8

#: Fixed values of the contract: a conversation takes its first turns, below ``SHARE`` of them, from the one whose id is the last multiple of ``FAMILY``.
FAMILY, SHARE = 100, 6
#: Bits of the places of a block along a conversation and of the ids of a piece of an end list; rows of a partial trie; salts of the merges.
BLOCK, RANGE, PARTIAL, SALTS = 12, 16, 200_000, (64, 1)
NODE = ["depth", "p1", "p2"]


def _numbered(batches):
    """Rows in order of conversation and turn: each with its place among the rows of its conversation in this partition, and the 128 bits and length of its turn."""
    from pyspark import TaskContext

    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(conv):
            continue
        new = np.ones(len(conv), bool)
        new[1:] = conv[1:] != conv[:-1]
        new[0] = last is None or conv[0] != last
        opened = np.maximum.accumulate(np.where(new, np.arange(len(conv)), -1))
        place = np.where(opened >= 0, np.arange(len(conv)) - opened, np.arange(len(conv)) + count) + 1
        last, count = conv[-1], int(place[-1])
        turns = bytearray()
        for role, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            head = utf8(role)
            turns += hashlib.blake2b(len(head).to_bytes(8, "little") + head + utf8(text), digest_size=16).digest()
        bits = np.frombuffer(bytes(turns), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(conv), part, np.int32)), pa.array(place), pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy()), batch.column(3)], names=["conv_id", "part", "place", "t1", "t2", "chars"])


def _before(df: DataFrame, key: str, block: str, sums: dict, later: bool = False) -> DataFrame:
    """Per (key, block): the totals of the blocks of its key before it (after it, if ``later``); only where there are any."""
    totals = df.groupBy(key, block).agg(*(f(x).alias(x) for x, f in sums.items()))
    order = Window.partitionBy(key).orderBy(F.desc(block) if later else block).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(key, block, *(f(x).over(order).alias(f"{x}_before") for x, f in sums.items()), F.count("*").over(order).alias("n_before")).filter("n_before > 0").drop("n_before")


def turns_in_order(conversations: DataFrame, space: Workspace) -> DataFrame:
    """Every turn with its number in its conversation (from 1), by turn (null first), then role and text."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", blank("role"), blank("text"))
    shards = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("conv_id", "role", "text", F.length("text").cast("long").alias("chars"))
    own = space.table(dealt.mapInArrow(lean(_numbered), "conv_id long, part int, place long, t1 long, t2 long, chars long"), "numbered")
    before = _before(own.withColumn("one", F.lit(1)), "conv_id", "part", {"one": F.sum})
    return own.join(before.hint("merge"), ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("one_before", F.lit(0))).alias("place"), "t1", "t2", "chars")


def rebuilt(turns: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """(turns of the rebuilt conversations: conv_id, place, t1, t2, chars, ends; conversations: conv_id, size).  ``turns`` is a written table."""
    sizes = space.table(turns.groupBy("conv_id").agg(F.count("*").alias("own")), "sizes")
    each = sizes.withColumns({"base": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": F.crc32(F.col("conv_id").cast("string")) % SHARE})
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    each = each.join(bases.hint("merge"), "base", "left").withColumn("shared", F.least("h", F.coalesce("base_own", F.lit(0))))
    each = space.table(each.select("conv_id", "base", "h", "shared", (F.col("shared") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")), "rebuilt-sizes")
    # a base has few rows here, and at most FAMILY conversations take them
    heads = turns.filter((F.col("place") < SHARE) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    heads = each.filter("shared > 0").join(heads.hint("merge"), "base").filter("place <= shared")
    tails = turns.join(each.hint("merge"), "conv_id").filter("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("shared"))
    columns = ["conv_id", "place", "t1", "t2", "chars", (F.col("place") == F.col("size")).alias("ends")]
    return heads.select(*columns).unionByName(tails.select(*columns)), each.select("conv_id", "size")


def prefixes(turns: DataFrame, conversations: DataFrame, space: Workspace) -> DataFrame:
    """Every prefix of every conversation, the empty one too: conv_id, depth, its name (p1, p2), its parent's (q1, q2), chars of the last turn, ends."""
    tagged = space.table(
        turns.select("conv_id", "place", "chars", "ends", *(F.xxhash64(F.lit(i), "place", "t1", "t2").alias(f"x{i}") for i in (1, 2))).withColumn("block", F.shiftright("place", BLOCK)), "tagged"
    )
    run = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    inside = tagged.withColumns({f"p{i}": F.bit_xor(f"x{i}").over(run) for i in (1, 2)})
    before = _before(tagged, "conv_id", "block", {"x1": F.bit_xor, "x2": F.bit_xor})
    # dealt by the same keys as the window, so nothing moves but the few totals
    found = inside.join(before.hint("merge"), ["conv_id", "block"], "left")
    whole = lambda i: F.col(f"p{i}").bitwiseXOR(F.coalesce(f"x{i}_before", F.lit(0)))
    rows = found.select("conv_id", F.col("place").alias("depth"), whole(1).alias("p1"), whole(2).alias("p2"), *(whole(i).bitwiseXOR(F.col(f"x{i}")).alias(f"q{i}") for i in (1, 2)), "chars", "ends")
    zero = F.lit(0).cast("long")
    roots = conversations.select("conv_id", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), zero.alias("q1"), zero.alias("q2"), zero.alias("chars"), (F.col("size") == 0).alias("ends"))
    return space.table(rows.unionByName(roots), "prefixes")


def _partial_tries(batches):
    """Partial tries of the rows at hand: node rows (members, smallest member, ends), and for each node and range of ids a row with those that end there."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def combined(held: list):
        rows = pa.Table.from_batches(held)
        rows = rows.append_column("n", pa.array(np.ones(len(rows), np.int64))).append_column("n_ends", rows.column("ends").cast(pa.int64()))
        nodes = rows.group_by(NODE).aggregate([("n", "sum"), ("n_ends", "sum"), ("conv_id", "min"), ("q1", "min"), ("q2", "min"), ("chars", "max")])
        yield from emitted({k: nodes.column(k) for k in NODE} | {k: nodes.column(f"{k}_{how}") for k, how in (("n", "sum"), ("n_ends", "sum"), ("conv_id", "min"), ("q1", "min"), ("q2", "min"), ("chars", "max"))})
        ends = rows.filter(rows.column("ends"))
        ends = ends.append_column("range", pa.array(ends.column("conv_id").to_numpy() >> RANGE))
        lists = ends.group_by([*NODE, "range"]).aggregate([("conv_id", "list")])
        yield from emitted({k: lists.column(k) for k in [*NODE, "range"]} | {"ids": lists.column("conv_id_list")})

    def emitted(columns: dict):
        size = len(columns["depth"])
        empty = lambda name: pa.nulls(size, pa.list_(pa.int64()) if name == "ids" else pa.int64())
        columns["part"] = pa.array(np.full(size, part, np.int64))
        yield from pa.table({name: columns[name] if name in columns else empty(name) for name in ("part", *NODE, "n", "n_ends", "conv_id", "q1", "q2", "chars", "range", "ids")}).to_batches()

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= PARTIAL:
            yield from combined(held)
            held, size = [], 0
    if size:
        yield from combined(held)


def _digests(batches):
    """SHA-256 of each node's ids in order, over rows of one node after another; memory of one row."""
    node, state = None, None
    for batch in batches:
        done = []
        for *own, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = own, hashlib.sha256()
            else:
                state.update(b",")
            state.update(",".join(map(str, ids)).encode())
        if done:
            yield _digest_rows(done)
    if node is not None:
        yield _digest_rows([(*node, state.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    *node, digest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in node), pa.array(digest)], names=[*NODE, "ends_sha256"])


def merged(partials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, end lists) of partial tries: rounds of merges with ever fewer salts; a list has the ids of one range, in order."""
    nodes, lists = partials.filter("range IS NULL"), partials.filter("range IS NOT NULL")
    for salts in SALTS:
        salt = F.pmod("part", F.lit(salts)).alias("part")
        nodes = nodes.groupBy(*NODE, salt).agg(*(F.sum(x).alias(x) for x in ("n", "n_ends")), *(F.min(x).alias(x) for x in ("conv_id", "q1", "q2", "chars")))
        lists = lists.groupBy(*NODE, "range", salt).agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))
    return nodes.drop("part"), lists.drop("part")


def rolled_up(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per node: n_leaves and saved_tokens of its subtree, as sums over its members of the weights from the node's depth on."""
    weights = nodes.select("conv_id", "depth", (F.col("n_ends") == F.col("n")).cast("long").alias("leaf"), ((F.col("n") - 1) * F.col("chars")).alias("saved"))
    own = rows.select("conv_id", *NODE).join(weights.hint("merge"), ["conv_id", "depth"], "left").fillna(0, ["leaf", "saved"]).withColumn("block", F.shiftright("depth", BLOCK))
    run = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    inside = own.withColumns({x: F.sum(x).over(run) for x in ("leaf", "saved")})
    beyond = _before(own, "conv_id", "block", {"leaf": F.sum, "saved": F.sum}, later=True)
    found = inside.join(beyond.hint("merge"), ["conv_id", "block"], "left")
    total = lambda x, name: F.sum(F.col(x) + F.coalesce(f"{x}_before", F.lit(0))).alias(name)
    return found.groupBy(*NODE).agg(total("leaf", "n_leaves"), total("saved", "saved_tokens"))


def trie(conversations: DataFrame, space: Workspace) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Columns conv_id, turn, role and text are read, others are not.  Null roles and texts are empty; a null turn comes first; turns with one number are in order of
    role and text, repeated rows stay; rows without conv_id are of no conversation and go.  No rows give no nodes, also no root.
    """
    turns = space.table(turns_in_order(conversations, space), "turns")
    rows = prefixes(*rebuilt(turns, space), space)
    partials = space.table(
        rows.select("conv_id", *NODE, "q1", "q2", "chars", "ends").mapInArrow(lean(_partial_tries), "part long, depth long, p1 long, p2 long, n long, n_ends long, conv_id long, q1 long, q2 long, chars long, range long, ids array<long>"), "partials"
    )
    nodes, lists = merged(partials)
    nodes = space.table(nodes, "nodes")
    sums = space.table(rolled_up(rows, nodes), "sums")
    digests = lists.repartition(*NODE).sortWithinPartitions(*NODE, "range").select(*NODE, "ids").mapInArrow(lean(_digests), "depth long, p1 long, p2 long, ends_sha256 string")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    # each node's parent before the joins by node: a parent may have very many children
    known = space.table(nodes.join(parents.hint("merge"), ["depth", "q1", "q2"], "left"), "known")
    out = known.join(sums.hint("merge"), NODE).join(children.hint("merge"), NODE, "left").join(digests.hint("merge"), NODE, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
