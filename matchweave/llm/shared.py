"""Helpers that several operators use: shared tables, block-wise tokenising, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: splitmix64's finaliser.
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
MASK = (1 << 64) - 1


# ---------------------------------------------------------------- shared tables
_SCOPES: list[list[Workspace]] = []


@contextlib.contextmanager
def scratch():
    """Deletes at its end the tables of all workspaces that were made inside it; what is kept must have been written elsewhere."""
    made: list[Workspace] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for space in made:
            space.clear()


class Workspace:
    """Tables in the folder that the cluster shares, to cut lineage and to survive lost executors.

    The folder is the session's ``spark.checkpoint.dir``.  Where that is unset a local temporary folder takes its
    place if the session is local too (tests, a laptop); a session on a cluster without it is refused.
    ``drop`` deletes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.gettempdir() + "/matchweave-checkpoints"
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.written: list[str] = []
        for scope in _SCOPES:
            scope.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and read back with its own schema."""
        path = f"{self.root}/{name}"
        self.written.append(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, *keep: str) -> None:
        """Deletes all tables written so far but those named."""
        names = dict.fromkeys(n for n in self.written if n not in keep)
        if names:
            self.drop(*names)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.written = [n for n in self.written if n != name]
        jvm.System.gc()  # lets Spark's cleaner remove the shuffle files that nothing refers to any more


def bounded_batches(spark: SparkSession, size: int = 2 << 20) -> SparkSession:
    """Bounds the bytes of a batch that goes to Python in this session, so that a worker's memory depends neither on how many
    rows fit a batch nor on how long their texts are (a single longer text is a batch by itself)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return spark


def broadcast_if_small(df: DataFrame, limit: int = 32 << 20, each: int = 64, binary: str | None = None) -> DataFrame:
    """``df`` marked for broadcast if its rows, at ``each`` bytes and those of the column ``binary``, are within the limit; else as it is, for a shuffled join.  Counts it: give it a table."""
    size = F.count("*") * each + (F.coalesce(F.sum(F.octet_length(binary)), F.lit(0)) if binary else F.lit(0))
    return F.broadcast(df) if df.agg(size).first()[0] <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """An order-sensitive 64-bit hash of two columns of hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + mix(b + np.uint64((0x632BE59BD9B4E019 + seed) & MASK)))


#: White space is these six characters and no others.
SPACE_CODES = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_SPACE = np.zeros(256, bool)
_SPACE[SPACE_CODES] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # A-Z as a-z
#: Spans of up to so many bytes are hashed by 8-byte blocks, longer ones by BLAKE2b.
SHORT = 64
#: Masks of the first 0 to 8 bytes of a block.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: The finaliser of another well-known hash, so that the two hashes of a span are independent.
_OTHER = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix_other(x: np.ndarray) -> np.ndarray:
    """A second bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * _OTHER[0]
    x = (x ^ (x >> np.uint64(29))) * _OTHER[1]
    return x ^ (x >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes; ``second`` gives another one, independent of it.

    Each 8-byte block is mixed into the hash by a bijection that is not linear, so for spans of one length up to eight
    bytes the hash is exact, and beyond it no structure of the bytes makes two spans equal; spans over ``SHORT`` bytes go through BLAKE2b.
    """
    blend, salt = (mix_other, 0x9FB21C651E98DF25) if second else (mix, 0xA24BAED4963EE407)
    size = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    with np.errstate(over="ignore"):
        h = blend((eight[starts] & _FIRST_BYTES[np.minimum(size, 8)]) ^ ((size.astype(np.uint64) + np.uint64(1)) * np.uint64(salt)))
        open_ = np.flatnonzero((size > 8) & (size <= SHORT))
        at = 8
        while len(open_):
            left = size[open_] - at
            h[open_] = blend((h[open_] + np.uint64(salt)) ^ (eight[starts[open_] + at] & _FIRST_BYTES[np.minimum(left, 8)]))
            at += 8
            open_ = open_[left > 8]
    for i in np.flatnonzero(size > SHORT).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        h[i] = int.from_bytes(digest[8:] if second else digest[:8], "little")
    return h


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte offsets of the words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes."""
    edge = np.diff(np.concatenate(([0], (~_SPACE[data]).view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, lower: bool = False, second: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of UTF-8 bytes (``span_hashes``); ``lower`` folds A-Z before hashing."""
    starts, ends = word_spans(data)
    return span_hashes(_FOLD[data] if lower else data, starts, ends, second), starts, ends


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def blocks(texts, limit: int = 1 << 18):
    """(first row, list of UTF-8 texts) of consecutive rows, about ``limit`` bytes together, so that vector work stays small."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = utf8(text)
        if held and size + len(raw) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, held


def text_groups(texts: list, limit: int = 1 << 17):
    """Consecutive texts of about ``limit`` characters together; null counts as empty."""
    group, size = [], 0
    for x in texts:
        x = x or ""
        if group and size + len(x) > limit:
            yield group
            group, size = [], 0
        group.append(x)
        size += len(x)
    if group:
        yield group


def block_words(raws: list[bytes], lower: bool = False, second: bool = False):
    """Words of several texts at once: (hashes, starts, ends, bytes, first word of each text and the end)."""
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    h, starts, ends = word_hashes(data, lower, second)
    offsets = np.cumsum([0] + [len(r) + 1 for r in raws])
    return h, starts, ends, data, np.searchsorted(starts, offsets)


def give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """A function of batches that gives memory back when a task ends, so that an idle worker keeps little beside those that work."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


@contextlib.contextmanager
def no_cycles():
    """Pauses the search for reference cycles, which is slow beside large tables of small objects; only for code that leaves no cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


# ---------------------------------------------------------------- columns
def let(value, body):
    """``body`` of a value that is computed once per row, whatever the optimiser does with the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small_files(spark: SparkSession, rows: int, each: int = 2_000_000) -> int:
    """Partitions for so many small rows: one for each ``each``, the session's shuffle partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))
