"""What the corpus operators share: tables between steps, Arrow batches, and words of UTF-8 buffers as numpy arrays."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests.
DEFAULT_SHARED = "file:///tmp/checkpoints"
#: Text bytes that one numpy step works on: a worker's arrays take about 60 times as many, beside the executor's heap.
BLOCK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; only a session on one machine may leave it out."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (folder or DEFAULT_SHARED).rstrip("/")


#: Shuffle files of an execution go when it ends, not when the driver's garbage is next collected.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and a lost executor loses nothing.

    What the write shuffled is of no use once the table stands, so those files are freed at once.
    """
    conf, path = df.sparkSession.conf, f"{shared_dir(df.sparkSession)}/graphmill-{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    before = conf.get(FREE_SHUFFLES, "false")
    conf.set(FREE_SHUFFLES, "true")
    try:
        (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    finally:
        conf.set(FREE_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key that holds more than one row in so many is hot; there are fewer hot keys than this.
HOT = 1000


def join_hot(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """left.join(right, key) where one key may hold a third of left. Read twice, so both should be written tables.

    right: one row a key, with column `n`, how many rows of left have the key. Hot keys (fewer than HOT rows,
    whatever the size of left) are broadcast, so their rows stay where they are; the others are shuffled.
    """
    total = right.agg(F.sum("n")).first()[0] or 0
    hot, rare = right.where(F.col("n") * HOT > total), right.where(F.col("n") * HOT <= total)
    # Below HOT rows in all, every key counts as hot and nothing is left to shuffle.
    met = left.join(F.broadcast(hot), key, "inner" if how == "left" else how)
    return met.unionByName(left.join(F.broadcast(hot.select(*key)), key, "left_anti").join(rare, key, how))


#: Stands for a null id inside joins, which would lose nulls.
NULL_ID = -(1 << 63)


def row_key(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id (NULL_ID for null), text, and row_hash, which tells rows of one doc_id apart; other columns cannot clash with ours."""
    return df.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text)).alias("row_hash"))


def real_id(column: str = "doc_id") -> F.Column:
    """The id as it was before row_key."""
    return F.nullif(F.col(column), F.lit(NULL_ID)).alias(column)


#: Rows that travel to a Python worker at a time, where the session has not chosen a number of its own.
BATCH_ROWS, _ROWS_KEY = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[dict[str, object]]], schema: str) -> DataFrame:
    """df.mapInArrow where f gives columns (by name, in any order) for each batch. What a batch took is given back after it,
    since workers live on beside the executor's heap."""
    if df.sparkSession.conf.get(_ROWS_KEY) == "10000":
        df.sparkSession.conf.set(_ROWS_KEY, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for cols in f(b):
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in cols.values()], names=list(cols))
                pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Rows of sizes[i] values each."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def text_blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them) for runs of rows of about limit bytes; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes of the inclusive ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Separators of the words [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _random_words(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, n, dtype=np.uint64)


_BYTE = _random_words(7, 256)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    old = _powers.get(int(base))
    if old is None or len(old) < n:
        p = np.full(max(n, 1024), base, np.uint64)
        p[0] = 1
        _powers[int(base)] = old = np.multiply.accumulate(p)
    return old[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all their bits (splitmix64's finisher)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the words of all rows, and where each row's words begin; words never span rows."""
    inside = ~separator[data]
    first, last = inside.copy(), inside.copy()
    if len(data) > 1:
        rows = offsets[1:-1]
        rows = rows[(rows > 0) & (rows < len(data))]
        first[1:] &= ~inside[:-1]
        first[rows] = inside[rows]
        last[:-1] &= ~inside[1:]
        last[rows - 1] = inside[rows - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK_BYTES, "right")))
        a, b = int(starts[at]), int(ends[to - 1])
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[data[a:b]] * powers(_BASE, b - a), out=sums[1:])
        s, e = starts[at:to] - a, ends[at:to] - a
        out[at:to] = mix((sums[e] - sums[s]) * powers(_BASE_INVERSE, b - a)[s])
        at = to
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words (given by their hashes); none if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out *= _BASE
        out += words[i : i + n]
    return mix(out)


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, .. for each run of the given size, one after another."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = sizes > 0
    starts, sizes = np.asarray(starts, np.int64)[keep], np.asarray(sizes, np.int64)[keep]
    at = np.cumsum(sizes)[:-1]
    out[0] = starts[0]
    out[at] = starts[1:] - (starts[:-1] + sizes[:-1] - 1)
    return np.cumsum(out)
