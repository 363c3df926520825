"""Time-ordered target encoding: rates of earlier rows of other folds, for ids and for the groups that they belong to.

Every row has a time, a fold, a weight ``n`` and a part ``s`` of it that counts.  For a value of a column the history of a row is what
all other folds hold of that value more than ``gap`` before the row's time.  It is a difference of two running sums:
that of the value, and that of the value within the row's fold.

``history`` finds both as DuckDB ASOF joins with a strict inequality.  The sums of (column, value, time, fold) are dealt by
ranges of (column, value, time), so a shard holds a span of time of a common value, or many rare values whole; rows
of one (column, value, time) never part.  A shard joins its rows to its own cumulative tables at time + gap.  Only the
first and the last value of a shard can lie in other shards too: for these it also emits its totals, and the prefix sums of
the totals of the shards before it are the opening balances.  So no value, however common, meets in one task, and
nothing is sent to the driver or broadcast.

``encode`` chains the rates: all rows give the prior of the groups, a row's group gives the prior of its id.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchweave.llm.shared import Workspace, lean, small_files

#: Fixed values of the contract: the prior of all history, the weight of a prior, the unit of rates, the folds.
PRIOR, WEIGHT, UNIT, FOLDS = 500_000, 50, 1_000_000, 5
#: Rows of a shard, about: what one task holds at once.  Rows that are summed before they move.
SHARD, TOGETHER = 400_000, 500_000
#: Stands for null among the ids.
NULL = -(1 << 63)

#: Each row (asks) of a shard with what its value, and its value and fold, had come to strictly before it (by_key, by_fold: running sums).
ASOF = """
SELECT q.row, coalesce(k.n, 0) - coalesce(f.n, 0) AS n, coalesce(k.s, 0) - coalesce(f.s, 0) AS s
FROM asks q ASOF LEFT JOIN by_key k ON q.key = k.key AND q.moment > k.moment ASOF LEFT JOIN by_fold f ON q.key_fold = f.key AND q.moment > f.moment
"""


class Encoded(NamedTuple):
    """A column to encode: its name in the result, the column of its ids, and the column of the group whose rate is the prior of its ids; both are long."""

    name: str
    key: str
    group: str


def rate(prior: str) -> Column:
    """The smoothed rate of ``n`` and ``s`` in whole units; the prior where there is no history."""
    return F.expr(f"CASE WHEN n < 1 THEN CAST({prior} AS BIGINT) ELSE ({UNIT}L * s + {WEIGHT}L * {prior}) div (n + {WEIGHT}L) END")


def _summed(columns: list[Encoded]):
    """Sums per (col, key, parent, moment, fold) of the rows that lie together."""
    wanted = [(0, None, None)] + [(i, c.group, None) for i, c in enumerate(columns, 1)] + [(i, c.key, c.group) for i, c in enumerate(columns, len(columns) + 1)]

    def sums(rows: pa.Table):
        none = pa.array(np.full(len(rows), NULL), pa.int64())
        whole = {c: pc.fill_null(rows.column(c), NULL) for c in {x for _, *two in wanted for x in two if x}}
        for col, key, parent in wanted:
            own = pa.table({"key": whole[key] if key else none, "parent": whole[parent] if parent else none, "moment": rows.column("moment"), "fold": rows.column("fold"), "n": rows.column("n"), "s": rows.column("s")})
            found = own.group_by(["key", "parent", "moment", "fold"], use_threads=False).aggregate([("n", "sum"), ("s", "sum")])
            named = {c: found.column(c) for c in ("key", "parent", "moment", "fold")} | {"n": found.column("n_sum"), "s": found.column("s_sum")}
            yield from pa.table({"col": pa.array(np.full(len(found), col, np.int32))} | named).to_batches()

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= TOGETHER:
                yield from sums(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield from sums(pa.Table.from_batches(held))

    return run


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows in order differ from the row before in any column."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _running(key: np.ndarray, moment: np.ndarray, n: np.ndarray, s: np.ndarray) -> pa.Table:
    """Running sums of rows in order of (key, moment): one row for each of these, with all that its key holds up to it."""
    ends = np.append(np.flatnonzero(_starts(key, moment))[1:], len(key)) - 1
    first = np.flatnonzero(_starts(key))[np.cumsum(_starts(key))[ends] - 1]
    up_to = lambda x: (c := np.cumsum(x))[ends] - (c - x)[first]
    return pa.table({"key": key[ends], "moment": moment[ends], "n": up_to(n), "s": up_to(s)})


def _joined(batches):
    """The rows of one shard with what its own rows give them, and the totals of its first and last value, which may have an opening balance."""
    import duckdb
    from pyspark import TaskContext

    got = list(batches)
    if not sum(b.num_rows for b in got):
        return
    shard = pa.Table.from_batches(got)
    number, time = TaskContext.get().partitionId(), shard.schema.field("moment").type
    value = {c: shard.column(c).cast(pa.int64()).to_numpy() for c in ("col", "key", "moment", "fold", "n", "s")}
    order = np.lexsort([value[c] for c in ("fold", "moment", "key", "col")])
    col, key, moment, fold, n, s = (x[order] for x in value.values())
    own = np.cumsum(_starts(col, key)) - 1  # values by number, and values with folds
    folds, place = np.unique(fold, return_inverse=True)
    both = own * len(folds) + place
    again = np.argsort(both, kind="stable")
    # who asks: each (value, parent, fold, time) once
    asked, parent = shard.column("asked").take(order), shard.column("parent").to_numpy()[order]
    asks = np.flatnonzero(asked.is_valid().to_numpy(zero_copy_only=False))
    if len(asks):
        asks = asks[np.lexsort([x[asks] for x in (parent, fold, moment, own)])]
        asks = asks[_starts(*(x[asks] for x in (own, moment, fold, parent)))]
    with duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""}) as base:
        base.register("asks", pa.table({"row": asks, "key": own[asks], "key_fold": both[asks], "moment": moment[asks]}))
        base.register("by_key", _running(own, moment, n, s))
        base.register("by_fold", _running(both[again], moment[again], n[again], s[again]))
        found = base.sql(ASOF).to_arrow_table()
    row = found.column("row").to_numpy()
    edge = (own == 0) | (own == own[-1])
    names = ["shard", "col", "key", "parent", "moment", "fold", "n", "s", "edge", "total"]
    arrays = [np.full(len(row), number, np.int32), col[row].astype(np.int32), key[row], parent[row], asked.take(row), fold[row].astype(np.int32), found.column("n").cast(pa.int64()), found.column("s").cast(pa.int64()), edge[row], np.zeros(len(row), bool)]
    yield from pa.table(dict(zip(names, arrays, strict=True))).to_batches(200_000)
    # their totals by fold
    every = again[edge[again]]
    first = np.flatnonzero(_starts(both[every]))
    at = every[first]
    total = lambda x: np.add.reduceat(x[every], first)
    none = lambda kind: pa.nulls(len(at), kind)
    arrays = [np.full(len(at), number, np.int32), col[at].astype(np.int32), key[at], none(pa.int64()), none(time), fold[at].astype(np.int32), total(n), total(s), np.ones(len(at), bool), np.ones(len(at), bool)]
    yield from pa.table(dict(zip(names, arrays, strict=True))).to_batches()


def history(facts: DataFrame, space: Workspace, gap: int = 0) -> tuple[DataFrame, DataFrame]:
    """For the rows of ``facts`` (col int, key, parent, moment, fold, n, s) the history: n and s of their (col, key) in other folds, more than ``gap`` seconds
    before their time.  Give it a written table; rows of one (col, key, moment, fold) may repeat.

    Two tables of one form: the rows whose shard held all of their value, and the others; each (col, key, parent, moment, fold) once.
    """
    time = facts.schema["moment"].dataType.simpleString()
    row = ["col", "key", "parent", "moment", "fold", "n", "s"]
    asks = facts.select(*row, F.col("moment").alias("asked"))
    if gap:  # what is known later, and who asks now
        later = facts.select(*row, F.lit(None).cast(time).alias("asked")).withColumn("moment", F.col("moment") + F.make_dt_interval(secs=F.lit(gap)))
        asks = later.unionByName(asks.withColumns({"n": F.lit(0).cast("long"), "s": F.lit(0).cast("long")}))
    shards = small_files(facts.sparkSession, facts.count() * (2 if gap else 1), SHARD)
    schema = f"shard int, col int, key long, parent long, moment {time}, fold int, n long, s long, edge boolean, total boolean"
    own = space.table(asks.repartitionByRange(shards, "col", "key", "moment").mapInArrow(lean(_joined), schema), "shards")
    before = lambda *of: Window.partitionBy("col", "key", *of).orderBy("shard").rangeBetween(Window.unboundedPreceding, -1)
    sums = lambda name, *of: [F.coalesce(F.sum(x).over(before(*of)), F.lit(0)).alias(f"{name}_{x}") for x in "ns"]
    opening = own.filter("total").select("shard", "col", "key", "fold", *sums("all"), *sums("fold", "fold")).filter("all_n > 0")
    opening = space.table(opening.select("shard", "col", "key", "fold", *(F.expr(f"all_{x} - fold_{x}").alias(f"open_{x}") for x in "ns")), "opening")
    rows, kept = own.filter("NOT total"), ["col", "key", "parent", "moment", "fold"]
    edge = rows.filter("edge").join(opening.hint("shuffle_hash"), ["shard", "col", "key", "fold"], "left").select(*kept, *(F.expr(f"{x} + coalesce(open_{x}, 0L)").alias(x) for x in "ns"))
    return rows.filter("NOT edge").select(*kept, "n", "s"), space.table(edge, "edges")


def encode(rows: DataFrame, columns: list[Encoded], space: Workspace, gap: int = 0) -> DataFrame:
    """``rows`` with ``<name>_n`` and ``<name>_rate`` of each column, from the rows' own times, folds, weights ``n`` and parts ``s``.

    ``rows`` must be a written table with the columns moment, fold, n, s and those of ``columns``; its other columns stay, but for names that start with ``x_``.
    Rows may repeat: they count each.  A null id or group is a value of its own (the least long stands for it).  Ids of one value should have one group;
    where they have several, each (id, group) has the id's history and its own prior.  No rows give no rows.
    """
    time = rows.schema["moment"].dataType.simpleString()
    taken = ["moment", "fold", "n", "s", *dict.fromkeys(x for c in columns for x in (c.key, c.group))]
    facts = space.table(rows.select(*taken).mapInArrow(lean(_summed(columns)), f"col int, key long, parent long, moment {time}, fold int, n long, s long"), "facts")
    parts = history(facts, space, gap)
    space.drop("facts")
    some = lambda keep: parts[0].filter(keep).unionByName(parts[1].filter(keep))
    every = some("col = 0").select("moment", "fold", rate(str(PRIOR)).alias("every"))
    groups = some(F.col("col").between(1, len(columns))).join(every.hint("shuffle_hash"), ["moment", "fold"])
    groups = groups.select((F.col("col") + len(columns)).alias("col"), F.col("key").alias("parent"), "moment", "fold", rate("every").alias("prior"))
    ids = some(F.col("col") > len(columns)).join(groups.hint("shuffle_hash"), ["col", "parent", "moment", "fold"])
    ids = space.table(ids.select("col", "key", "parent", "moment", "fold", "n", rate("prior").alias("rate")), "ids")
    out = rows
    for i, c in enumerate(columns, len(columns) + 1):
        own = ids.filter(F.col("col") == i).select(*(F.col(x).alias(f"x_{x}") for x in ("key", "parent", "moment", "fold")), F.col("n").alias(f"{c.name}_n"), F.col("rate").alias(f"{c.name}_rate"))
        same = lambda mine, x: F.coalesce(F.col(mine), F.lit(NULL)) == F.col(f"x_{x}")
        out = out.join(own.hint("shuffle_hash"), same(c.key, "key") & same(c.group, "parent") & (F.col("moment") == F.col("x_moment")) & (F.col("fold") == F.col("x_fold"))).drop("x_key", "x_parent", "x_moment", "x_fold")
    return out


def _groups(table: DataFrame, key: str, group: str, name: str, space: Workspace) -> DataFrame:
    """(<name>_key, <name>_group) of each id: a number for its group, that of the smallest where an id repeats; no number for null."""
    one = table.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias(f"{name}_key")).agg(F.min(group).alias("value"))
    one = space.table(one, f"{name}-one")
    values = space.table(one.filter("value IS NOT NULL").select("value").distinct(), f"{name}-values").withColumn(f"{name}_group", F.monotonically_increasing_id())
    return space.table(one.join(values, "value", "left").select(f"{name}_key", f"{name}_group"), f"{name}-groups")


def sale_rates(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, space: Workspace, gap: int = 0) -> DataFrame:
    """Return rates of items, vendors and clients before each sale: one row per sale_id, item_id and vendor_id of the lines.

    n_lines and n_returned (own lines; a null flag is none), and item_n, item_rate, vendor_n, vendor_rate, client_n, client_rate of the history.
    Lines without a sale or its sold_at go; repeated lines count each; null item_id and client_id become -1, a null vendor_id stays
    a value of its own; ids that ``items``, ``vendors`` or ``clients`` lack share the group of null, and so do null groups.  Equal times are no
    history of each other.  Sales should have one row for each id: a repeated one repeats its lines.  Other columns are not read;
    empty tables give an empty result.
    """
    id_or_own = lambda c: F.coalesce(F.col(c), F.lit(-1)).cast("long").alias(c)
    own = lines.filter("sale_id IS NOT NULL").groupBy("sale_id", id_or_own("item_id"), "vendor_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("flag") == "returned", 1)).alias("s"))
    sold = sales.filter("sold_at IS NOT NULL").select("sale_id", F.col("sold_at").alias("moment"), id_or_own("client_id"))
    # groups are written, so that both sides of each join can be split where a value is common; the last join leaves the rows of a sale together
    def grouped(rows: DataFrame, name: str, table: DataFrame, group: str) -> DataFrame:
        known = _groups(table, f"{name}_id", group, name, space)
        return rows.join(known.hint("shuffle_hash"), F.col(f"{name}_id") == F.col(f"{name}_key"), "left").drop(f"{name}_key")

    sold = space.table(grouped(sold, "client", clients, "segment").withColumn("fold", (F.crc32(F.col("sale_id").cast("string")) % FOLDS).cast("int")), "sold")
    found = grouped(grouped(own, "item", items, "kind"), "vendor", vendors, "nation_id").join(sold.hint("shuffle_hash"), "sale_id")
    rows = space.table(found, "rows")
    out = encode(rows, [Encoded(x, f"{x}_id", f"{x}_group") for x in ("item", "vendor", "client")], space, gap)
    return out.select("sale_id", "item_id", "vendor_id", F.col("n").alias("n_lines"), F.col("s").alias("n_returned"), *(f"{x}_{y}" for x in ("item", "vendor", "client") for y in ("n", "rate")))
