"""Training-order materialisation: token sequences at keyed random places in fixed-stride binary shards."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.llm.common import map_batches, mix, shared_dir, stage, text_blocks
from graphmill.llm.tokens import default_path, tokenizer

#: Tokens of a sequence, sequences of a shard (8 MB at two bytes a token), and the file names of shards.
SEQUENCE, SHARD_SEQUENCES, NAME = 2048, 2048, "shard-{:08d}.bin"
#: Shards that one task writes.
TASK_SHARDS = 8
#: Reading tasks (16 bytes each) whose first numbers are broadcast; beyond that they are joined by shuffle.
BROADCAST_TASKS = 1_000_000


class Feistel:
    """A keyed permutation of 0 .. n - 1: four rounds over the next even number of bits, walked on until the value is below n."""

    def __init__(self, n: int, key: int, rounds: int = 4):
        self.n, self.half = n, max(1, (max(1, n - 1).bit_length() + 1) // 2)
        self.keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % (1 << 64)))

    def _once(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        a, b = x >> half, x & mask
        for k in keys[::-1] if back else keys:
            a, b = (b ^ (mix(a ^ k) & mask), a) if back else (b, a ^ (mix(b ^ k) & mask))
        return a << half | b

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x).astype(np.uint64), self.keys, back)
        while len(far := np.flatnonzero(out >= self.n)):
            out[far] = self._once(out[far], self.keys, back)
        return out.astype(np.int64)

    def place(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, False)

    def index(self, slot: np.ndarray) -> np.ndarray:
        """The inverse of place."""
        return self._walk(slot, True)


class Shards(NamedTuple):
    """sequences: a row each; manifest: a row a shard; folder: of the files; stride: bytes of a sequence; n: sequences."""

    sequences: DataFrame
    manifest: DataFrame
    folder: str
    stride: int
    n: int


def _sequences(docs: DataFrame, length: int, path: str, dtype: str) -> DataFrame:
    """part, nth, first_doc_id, n_docs, n_tokens, ids_crc32, payload: each task's documents, each followed by id 0, one after
    another and cut every `length` ids; a task's last sequence is filled up with 0 (n_tokens doesn't count that)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth, width = TaskContext.get().partitionId(), 0, np.dtype(dtype).itemsize
        rest, owners = np.zeros(0, np.uint32), []  # ids not yet written; (place in them, doc_id) of the documents that begin there

        def rows(flush: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rest, owners, nth
            n = -(-len(rest) // length) if flush else len(rest) // length
            if not n:
                return
            ids = np.zeros(n * length, np.uint32)
            used = min(len(rest), n * length)
            ids[:used] = rest[:used]
            if used and int(ids.max()) > np.iinfo(np.dtype(dtype)).max:
                raise ValueError(f"id {int(ids.max())} does not fit {dtype}")
            raw = ids.astype(dtype).tobytes()
            payload = [raw[i * length * width : (i + 1) * length * width] for i in range(n)]
            at = np.array([o[0] for o in owners], np.int64)
            first = np.searchsorted(at, np.arange(n) * length, "right") - 1
            after = np.searchsorted(at, np.minimum((np.arange(n) + 1) * length, used), "left")
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part] * n, pa.int32()), "nth": pa.array(range(nth, nth + n), pa.int64()), "first_doc_id": pa.array([owners[i][1] for i in first], pa.int64()), "n_docs": pa.array(after - first, pa.int64()),
                "n_tokens": pa.array([min(length, used - i * length) for i in range(n)], pa.int64()), "ids_crc32": pa.array([zlib.crc32(p) for p in payload], pa.int64()), "payload": pa.array(payload, pa.binary()),
            })
            nth += n
            rest = rest[used:]
            last = int(np.searchsorted(at, used, "right")) - 1
            owners = [(max(0, p - used), d) for p, d in owners[(last if len(rest) else last + 1) :]] if owners else []

        for b in batches:
            for first, to, data, offsets in text_blocks(b.column(1)):
                ids, at = tokenizer(path).block(data, offsets)
                ends = at[1:] + np.arange(1, to - first + 1)
                out = np.zeros(len(ids) + to - first, np.uint32)
                keep = np.ones(len(out), bool)
                keep[ends - 1] = False
                out[keep] = ids
                base = len(rest)
                owners += zip((base + np.concatenate([[0], ends[:-1]])).tolist(), b.column(0)[first:to].to_pylist())
                rest = np.concatenate([rest, out])
                yield from rows(False)
        yield from rows(True)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "part int, nth long, first_doc_id long, n_docs long, n_tokens long, ids_crc32 long, payload binary")


def _write(placed: DataFrame, folder: str, per_shard: int) -> DataFrame:
    """shard, first_slot, n, bytes, crc32 of each file written. A file is written under a name of its own and then moved, so
    a task that runs twice leaves the same file once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        shard, stream, temp, done = None, None, "", []
        n = crc = size = first = 0

        def close() -> None:
            if stream is not None:
                stream.close()
                files.move(temp, f"{root}/{NAME.format(shard)}")
                done.append((shard, first, n, size, crc))

        for b in batches:
            for slot, payload in zip(b.column(0).to_pylist(), b.column(1)):
                if slot // per_shard != shard:
                    close()
                    shard, n, crc, size, first = slot // per_shard, 0, 0, 0, slot
                    files.create_dir(root, recursive=True)
                    temp = f"{root}/.{uuid.uuid4().hex}"
                    stream = files.open_output_stream(temp)
                raw = payload.as_py()
                stream.write(raw)
                n, crc, size = n + 1, zlib.crc32(raw, crc), size + len(raw)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64()) for i in range(5)], names=["shard", "first_slot", "n", "bytes", "crc32"])

    return placed.mapInArrow(run, "shard long, first_slot long, n long, bytes long, crc32 long")


def materialise(docs: DataFrame, key: int = 20240501, length: int = SEQUENCE, per_shard: int = SHARD_SEQUENCES, folder: str | None = None, tokenizer_path: str | None = None, dtype: str = "<u2") -> Shards:
    """Write all documents as token sequences in a keyed random order, in shards of per_shard sequences of the same bytes.

    docs: doc_id, text and any other columns; a null or empty text is the id 0 alone; repeated rows are written once
    each; a null doc_id stays null; an empty table gives no shard. The order is the permutation of the sequences'
    numbers under the key: the same input files, split sizes and key give the same shards. dtype: `<u2` holds ids below
    65,536 (a larger one is an error), `<u4` any. Slot s is in file s // per_shard at byte (s % per_shard) * stride, which is all a reader needs
    to go on after a stop. folder: shared by all executors (by default within the session's checkpoint folder).

    Shuffle: each payload once, to the task that writes its range of slots.
    """
    spark, path = docs.sparkSession, tokenizer_path or default_path()
    folder = folder or f"{shared_dir(spark)}/graphmill-shards-{uuid.uuid4().hex}"
    cut = stage(_sequences(docs, length, path, dtype), "sequences")
    counts = cut.groupBy("part").agg(F.count("*").alias("n"))
    # One row for each task that read documents.
    starts = counts.withColumn("base", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).select("part", "base")
    starts = stage(starts, "starts")
    located = cut.join(F.broadcast(starts) if starts.count() <= BROADCAST_TASKS else starts, "part")
    number = (F.col("base") + F.col("nth")).alias("number")
    n = cut.count()
    order = Feistel(max(1, n), key)

    def place(b: pa.RecordBatch):
        yield {name: b.column(i) for i, name in enumerate(b.schema.names)} | {"slot": pa.array(order.place(b.column(b.num_columns - 1).to_numpy()))}

    names = [c for c in cut.columns if c != "payload"]
    numbered = map_batches(located.select(*names, number), place, "part int, nth long, first_doc_id long, n_docs long, n_tokens long, ids_crc32 long, number long, slot long")
    numbered = stage(numbered, "slots")
    stride = length * np.dtype(dtype).itemsize
    shards = max(1, -(-n // per_shard))
    placed = map_batches(located.select("payload", number), place, "payload binary, number long, slot long")
    ranged = placed.select("slot", "payload", F.floor(F.col("slot") / per_shard).alias("shard")).repartitionByRange(-(-shards // TASK_SHARDS), "shard")
    manifest = stage(_write(ranged.sortWithinPartitions("slot").select("slot", "payload"), folder, per_shard), "manifest")
    sequences = numbered.select("slot", F.floor(F.col("slot") / per_shard).cast("long").alias("shard"), (F.col("slot") % per_shard * stride).alias("byte_offset"), "number", "first_doc_id", "n_docs", "n_tokens", "ids_crc32")
    return Shards(sequences, manifest, folder, stride, n)


def read(folder: str, from_slot: int, n: int, length: int = SEQUENCE, per_shard: int = SHARD_SEQUENCES, dtype: str = "<u2") -> Iterator[np.ndarray]:
    """Sequences from_slot .. from_slot + n - 1, read in order from where a reader stopped."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    stride, slot, end = length * np.dtype(dtype).itemsize, from_slot, from_slot + n
    while slot < end:
        with files.open_input_file(f"{root}/{NAME.format(slot // per_shard)}") as f:
            f.seek(slot % per_shard * stride)
            for _ in range(min(end - slot, per_shard - slot % per_shard)):
                yield np.frombuffer(f.read(stride), dtype)
                slot += 1


def check_manifest(spark: SparkSession, shards: Shards, per_shard: int = SHARD_SEQUENCES) -> bool:
    """Whether all slots were written, each shard but the last full."""
    m = shards.manifest.agg(F.count("*"), F.sum("n"), F.sum(F.when(F.col("first_slot") != F.col("shard") * per_shard, 1).otherwise(0)), F.sum(F.when(F.col("bytes") != F.col("n") * shards.stride, 1).otherwise(0))).first()
    return (m[0], m[1] or 0, m[2] or 0, m[3] or 0) == (-(-shards.n // per_shard), shards.n, 0, 0)
