"""What several corpus operators share: sessions, shared tables, hashing of words, components.

Words are maximal runs of characters other than space and U+0009 to U+000D, unchanged.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 (DuckDB) read it alike.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
_BYTE_BASE = 0xD1342543DE82EF95
_WORD_BASE = 0xAF251AF3B0F025B5


# --------------------------------------------------------------------------- tables


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse where none is set. On a
    cluster a warehouse on the driver's own disk is not shared, so there ValueError asks for spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tesserae-shared"
        if folder.startswith(("file:", "/")) and not is_local(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tesserae-{name}-{uuid.uuid4().hex}"


#: Folders that stored() made in the run this context is in (see Stored) and that are not deleted; none outside of runs.
_made: ContextVar[list[str] | None] = ContextVar("tesserae_made", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: a lineage cut that outlives any executor."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._tesserae_folder = folder
    made = _made.get()
    if made is not None:
        made.append(folder)
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables made by stored() that nothing will read again."""
    for df in tables:
        folder = getattr(df, "_tesserae_folder", None)
        if folder:
            _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    made = _made.get()
    if made is not None and folder in made:
        made.remove(folder)


class Stored:
    """A run of tables that follow on one another: when one is stored, all that this run stored since the one before goes.

    The run is the context's (its thread's, unless copied) from here on until another begins in it. Tables of other runs,
    and tables stored outside of runs, are not its own and stay."""

    def __init__(self):
        self.made: list[str] = []
        _made.set(self.made)

    def next(self, df: DataFrame, name: str) -> DataFrame:
        old, out = list(self.made), stored(df, name)
        for folder in old:
            _delete(df.sparkSession, folder)
        release(df.sparkSession)
        return out


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of finished jobs: it acts on the driver's garbage collections only."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


# --------------------------------------------------------------------------- memory of Python workers

#: By operator, what its tasks keep in a worker.
_held: dict[str, dict] = {}


def held(name: str) -> dict:
    """What tasks of an operator keep from one to the next in this worker."""
    return _held.setdefault(name, {})


def _only(name: str | None) -> None:
    for other in [x for x in _held if x != name]:
        del _held[other]


def _give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task for mapInArrow whose worker, idle beside later stages, does not hold on to what the task has freed, nor to what
    tasks of operators other than `keeps` kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _only(keeps)
        try:
            yield from task(batches)
        finally:
            _give_back()

    return run


# --------------------------------------------------------------------------- hashing of words


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place on a copy)."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=_U64) * _U64(_ODD))


class Powers:
    """b**i and b**-i modulo 2**64 for odd b, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=_U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up), 4096)
            for name, base in (("up", self.base), ("down", self.inverse)):
                factors = np.full(size, base, dtype=_U64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=_U64))
        return self.up[: n + 1], self.down[: n + 1]


_BYTES, _WORDS = Powers(_BYTE_BASE), Powers(_WORD_BASE)


def word_edges(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words start and end."""
    a = np.frombuffer(data, dtype=np.uint8)
    gap = np.ones(len(a) + 2, dtype=np.int8)
    gap[1:-1] = (a == 32) | ((a >= 9) & (a <= 13))
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, by one prefix sum over the bytes."""
    a = np.frombuffer(data, dtype=np.uint8)
    up, down = _BYTES.upto(len(a))
    total = np.zeros(len(a) + 1, dtype=_U64)
    np.cumsum(_BYTE_VALUES[a] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U64))


class Grams:
    """Hashes of any run of consecutive words of one text."""

    def __init__(self, words: np.ndarray):
        up, self.down = _WORDS.upto(len(words))
        self.total = np.zeros(len(words) + 1, dtype=_U64)
        np.cumsum(words * up[:-1], out=self.total[1:])
        self.n = len(words)

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.down[starts] + (ends - starts).astype(_U64))

    def all(self, k: int) -> np.ndarray:
        if self.n < k:
            return np.zeros(0, dtype=_U64)
        return mix((self.total[k:] - self.total[: self.n - k + 1]) * self.down[: self.n - k + 1] + _U64(k))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """Each row's text as bytes; null is empty."""
    values = batch.column(batch.schema.get_field_index(column))
    for v in values.cast(pa.large_binary()) if not pa.types.is_large_binary(values.type) else values:
        yield v.as_py() or b""


#: Letters and numbers of Latin-1, as members of a character class.
LATIN_LETTERS, LATIN_NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"


def is_latin(text: str) -> bool:
    """Whether all characters are below U+0100, where every library sees the same letters, numbers and white space; but
    for U+001C to U+001F, which are white space to Python only."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not any(c in text for c in "\x1c\x1d\x1e\x1f")


class Recent:
    """A dictionary of bounded size in two halves: when the newer is full it becomes the older, and the older goes.
    Entries of `base` stay."""

    def __init__(self, limit: int, base: dict[str, bytes] | None = None, longest: int = 64):
        self.limit, self.longest, self.base = max(1, limit // 2), longest, base or {}
        self.new: dict[str, bytes] = dict(self.base)
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        value = self.new.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.new[key] = value
        return value

    def all(self, keys: list[str]) -> list[bytes | None]:
        found = list(map(self.new.get, keys))
        if None in found and self.old:
            get = self.get
            found = [get(k) if v is None else v for k, v in zip(keys, found, strict=True)]
        return found

    def add(self, items: dict[str, bytes]) -> None:
        if len(self.new) + len(items) > self.limit + len(self.base):
            self.old, self.new = self.new, dict(self.base)
        self.new.update((k, v) for k, v in items.items() if len(k) <= self.longest)


# --------------------------------------------------------------------------- connected components


def summary(edges: DataFrame) -> tuple:
    """The number of edges, and a sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of `edges`; component is the smallest node reachable.

    Alternates large-star and small-star steps until the edges no longer change, as after some steps they do: the number of
    steps grows with the square of the logarithm of the nodes at most, and none is set here. A step is a group minimum and an
    equi-join, so a node with very many neighbours is split like any skewed join key. Edges stay in the shared folder.
    """
    spark = edges.sparkSession
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    state, seen = summary(now), None
    while state != seen:
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = stored(small, "edges")
        drop_stored(now)
        now, state = after, summary(after)
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    release(spark)
    return out
