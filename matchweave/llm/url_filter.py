"""URL filters: a Bloom filter cascade that is exact over the corpus's own keys.

Level 0 encodes the listed keys.  Level 1 encodes the keys of the corpus that
are not listed and yet pass level 0, level 2 the listed ones that pass level 1,
and so on until nothing passes wrongly.  As every key that will ever be asked
for was in the universe, the first level that a key fails decides its
membership exactly; pages are then judged where they lie, without a join, or, where the
cascades are too large to be everywhere, in the tasks that hold them.

Keys are split into shards by their hash, and each shard's cascade is built by
one task from at most about ``PER_SHARD`` distinct keys, so memory is bounded
and a hot host, being one key, weighs no more than any other.

Listed keys are of two kinds: *rules* (host, path prefix -> allow or block; the
longest that fits wins) and *hosts* (blocked where no rule fits).  A null url
and one without ``://`` have an empty host and path: no rule fits, and an empty host is
never listed.  Repeated rows and null ids are judged row by row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchweave.llm.shared import MASK, Workspace, broadcast_if_small, mix

#: Distinct keys of a shard; shards at least, so that their tasks are even; bytes of cascades that may be broadcast; keys that a task asks beyond.
PER_SHARD, LEAST_SHARDS, BROADCAST, ASKED = 100_000, 256, 64 << 20, 2_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---------------------------------------------------------------- the cascade
def _slots(h1: np.ndarray, h2: np.ndarray, level: int, k: int, m) -> np.ndarray:
    """The k bit numbers of each key in a filter of m bits, one row for each of the k."""
    salt = np.uint64((0xA0761D6478BD642F * (level + 1)) & MASK)
    a, b = mix(h1 ^ salt), mix(h2 + salt) | np.uint64(1)
    return np.stack([(a + np.uint64(j) * b) % m for j in range(k)])


def build_cascade(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[tuple[int, int, bytes]]:
    """The levels (hash count, bits, bytes) of the cascade of distinct keys, given by two 64-bit hashes each."""
    inside, outside, levels = np.flatnonzero(listed), np.flatnonzero(~listed), []
    while len(inside):
        if len(levels) > 200:
            raise ValueError("keys of the two sides have equal hashes")
        rate = 0.5 if levels else min(0.5, max(2.0**-16, 0.7 * len(inside) / max(1, len(outside))))
        k = max(1, round(-np.log2(rate)))
        m = max(64, -(-int(1.45 * k * len(inside)) // 8) * 8)
        bits = np.zeros(m, bool)
        bits[_slots(h1[inside], h2[inside], len(levels), k, np.uint64(m)).ravel()] = True
        passing = bits[_slots(h1[outside], h2[outside], len(levels), k, np.uint64(m))].all(0) if len(outside) else np.zeros(0, bool)
        levels.append((k, m, np.packbits(bits, bitorder="little").tobytes()))
        inside, outside = outside[passing], inside
    return levels


class Cascade:
    """Cascades of all shards in one array of bits, asked for many keys at once."""

    def __init__(self, shards: int, rows):
        self.shards, depth = shards, max((len(r["levels"]) for r in rows), default=0)
        self.k, self.m, self.at = (np.zeros((depth + 1, shards), np.int64) for _ in range(3))
        blobs, size = [], 0
        for r in rows:
            for level, x in enumerate(r["levels"]):
                self.k[level, r["shard"]], self.m[level, r["shard"]], self.at[level, r["shard"]] = x["k"], x["m"], size
                blobs.append(x["bits"])
                size += len(x["bits"]) * 8
        self.bits = np.frombuffer(b"".join(blobs), np.uint8)

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact membership of keys of the universe: they fail an odd level first (counted from 0) if they are listed."""
        shard = h1.view(np.int64) % self.shards
        out, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
        for level in range(len(self.k)):
            k, m = self.k[level][shard[open_]], self.m[level][shard[open_]]
            passes = m > 0
            for n in np.unique(k[passes]):
                here = np.flatnonzero(k == n)
                x = open_[here]
                slots = _slots(h1[x], h2[x], level, int(n), m[here].astype(np.uint64)).astype(np.int64) + self.at[level][shard[x]]
                passes[here] = (self.bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).all(0)
            out[open_[~passes]] = level % 2 == 1
            open_ = open_[passes]
        return out


def _shard_cascade(pdf: pd.DataFrame) -> pd.DataFrame:
    levels = build_cascade(pdf["h1"].to_numpy(np.int64).view(np.uint64), pdf["h2"].to_numpy(np.int64).view(np.uint64), pdf["listed"].to_numpy(bool))
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "levels": [[{"k": k, "m": m, "bits": bits} for k, m, bits in levels]]})


CASCADE = "shard long, levels array<struct<k: int, m: long, bits: binary>>"


def hashes(key: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a key; together they stand for it (equal pairs of different keys are found and reported)."""
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def cascades(space: Workspace, keys: DataFrame) -> tuple[int, DataFrame]:
    """(shards, cascade of each shard) of ``keys`` (key string, listed boolean); a key is listed if any of its rows is."""
    h1, h2 = hashes(F.col("key"))
    distinct = keys.groupBy("key").agg(F.max("listed").alias("listed")).select("key", h1.alias("h1"), h2.alias("h2"), "listed")
    distinct = space.table(distinct, "keys")
    if distinct.groupBy("h1", "h2").agg((F.min("key") != F.max("key")).alias("clash")).filter("clash").limit(1).count():
        raise ValueError("two keys have equal hashes")
    shards = max(LEAST_SHARDS, -(-distinct.count() // PER_SHARD))
    universe = distinct.select("h1", "h2", F.pmod(F.col("h1"), F.lit(shards)).cast("long").alias("shard"), "listed")
    return shards, space.table(universe.groupBy("shard").applyInPandas(_shard_cascade, CASCADE), "cascades")


def membership(space: Workspace, pages: DataFrame, keys: Column, shards: int, built: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """``pages`` with ``hits``: for each of the row's ``keys`` (array of strings of the universe) whether it is listed.

    The cascades go to all executors while they are within ``broadcast`` bytes.  Beyond, the pages' keys go to the cascades: rows of
    a shard are dealt to as many tasks as they need, so that a hot host fills no task, each task asks its shard's cascade, and what
    is listed goes back by the row's number.  No key is ever joined with the listed ones.
    """
    spark = space.spark
    size = built.select(F.sum(F.expr("aggregate(levels, 0L, (a, x) -> a + octet_length(x.bits))"))).first()[0] or 0
    pages = pages.withColumn("keys", keys)
    if size <= broadcast:
        shared = spark.sparkContext.broadcast(Cascade(shards, built.collect()))
        space.clear()

        @F.arrow_udf("array<boolean>")
        def ask(h1: pa.Array, h2: pa.Array) -> pa.Array:
            a, b = (np.asarray(x.flatten()).view(np.uint64) for x in (h1, h2))
            lengths = np.asarray(h1.value_lengths().fill_null(0))
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(shared.value.listed(a, b)))

        return pages.withColumn("hits", ask(F.transform("keys", lambda k: hashes(k)[0]), F.transform("keys", lambda k: hashes(k)[1])))

    def answer(asked: pa.Table, cascade: pa.Table) -> pa.Table:
        own = Cascade(1, [row | {"shard": 0} for row in cascade.to_pylist()])
        a, b = (asked.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        return asked.filter(pa.array(own.listed(a, b))).select(["row", "at"])

    numbered = space.table(pages.withColumn("row", F.monotonically_increasing_id()), "numbered")
    asked = numbered.select("row", F.posexplode("keys").alias("at", "key")).select("row", "at", hashes(F.col("key"))[0].alias("h1"), hashes(F.col("key"))[1].alias("h2"))
    asked = asked.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("long"))
    parts = space.table(asked.groupBy("shard").agg(F.ceil(F.count("*") / ASKED).alias("parts")), "parts")
    dealt = asked.join(broadcast_if_small(parts), "shard").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    copies = built.join(broadcast_if_small(parts), "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "levels")
    hits = dealt.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(answer, "row long, at int")
    hits = hits.groupBy("row").agg(F.collect_set("at").alias("places"))  # at most one for each key of the row
    found = numbered.join(hits, "row", "left")
    return found.withColumn("hits", F.transform("keys", lambda k, i: F.coalesce(F.array_contains("places", i), F.lit(False)))).drop("row", "places")


# ---------------------------------------------------------------- urls
def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_candidates(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """All rule strings that could fit: suffixes of whole labels of the host, as many labels as some rule has, with prefixes of the path as long as some rule's."""
    labels = F.split(host, r"\.", -1)
    depths = sorted({h.count(".") + 1 for _, h, _ in rules})
    sizes = sorted({len(p) for _, _, p in rules})
    suffix = {d: F.when(F.size(labels) >= d, F.array_join(F.slice(labels, F.size(labels) - (d - 1), d), ".")) for d in depths}
    prefix = {n: F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sizes}
    return F.array_compact(F.array(*(F.concat(suffix[d], prefix[n]) for d in depths for n in sizes)))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], hosts: DataFrame, space: Workspace, page_id: str = "page_id", url: str = "url", broadcast: int = BROADCAST) -> DataFrame:
    """Per page: id, host, path, rule (host and path of the longest that fits, else null), verdict, listed_host.

    rules: (allow or block, host, path prefix); a rule fits its host and all subdomains.  hosts: one
    column ``host``, blocked where no rule fits.  Of two rules of equal length, the one with the longer host wins.
    """
    host, path = host_and_path(F.col(url))
    judged = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    # "r" and "h" keep the two kinds of keys apart
    keys = F.concat(F.transform(rule_candidates(F.col("host"), F.col("path"), rules), lambda x: F.concat(F.lit("r"), x)), F.array(F.concat(F.lit("h"), F.col("host"))))
    ruled = space.spark.createDataFrame([("r" + h + p, True) for _, h, p in rules], "key string, listed boolean")
    listed = hosts.filter("host != ''").select(F.concat(F.lit("h"), F.col("host")).alias("key"), F.lit(True).alias("listed"))
    asked = judged.select(F.explode(keys).alias("key"), F.lit(False).alias("listed"))
    shards, built = cascades(space, asked.unionByName(listed).unionByName(ruled))
    found = membership(space, judged, keys, shards, built, broadcast)
    size_of_host = F.create_map(*(F.lit(x) for _, h, p in rules for x in (h + p, len(h))))
    verdict_of = F.create_map(*(F.lit(x) for v, h, p in rules for x in (h + p, v)))
    hits = F.filter("keys", lambda k, i: F.get("hits", i))
    fitting = F.transform(F.filter(hits, lambda k: F.startswith(k, F.lit("r"))), lambda k: F.substring(k, 2, F.length(k)))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(F.length(r).alias("n"), size_of_host[r].alias("h"), r.alias("rule"))))
    ruled = found.select("page_id", "host", "path", best["rule"].alias("rule"), F.exists(hits, lambda k: F.startswith(k, F.lit("h"))).alias("listed_host"))
    verdict = F.coalesce(verdict_of[F.col("rule")], F.when(F.col("listed_host"), "block").otherwise("allow"))
    return ruled.select(F.col("page_id").alias(page_id), "host", "path", "rule", verdict.alias("verdict"), "listed_host")


def tracking_hosts(pages: DataFrame, url: str = "url", mark: str = "utm_source=") -> DataFrame:
    """The hosts that publish at least one url with a tracking mark: the block list of the registered query."""
    return pages.filter(F.contains(F.col(url), F.lit(mark))).select(host_and_path(F.col(url))[0].alias("host")).filter("host != ''").distinct()
