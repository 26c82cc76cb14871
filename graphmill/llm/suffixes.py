"""Repeated byte strings by a suffix array that is dealt out in buckets: Spark forms the first buckets, and bucket-pointer refinement sorts each to the full depth."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import gather, join_hot, map_batches, mix, powers, real_id, row_key, stage, text_blocks
from graphmill.llm.phrases import sliding_min

#: Bytes of a string that counts as repeated, and of the grams that choose its first bucket.
DEPTH, GRAM = 100, 32
#: Strings in a bucket that one task refines at once; larger buckets are first split by more of their bytes.
TASK_STRINGS = 20_000
#: Window starts in a step of numpy: a longer text is taken in steps.
_STEP, _PLACE_BITS = 1 << 20, 21
_Q = 8
_TABLES = np.random.Generator(np.random.PCG64(13)).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = "doc_id long, row_hash long"


def _sums(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """From which _hash tells any stretch of data."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def _hash(sums: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts])


def _steps(texts: pa.Array, depth: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first row, row after the last, bytes, offsets, bytes before these in the row); only a row that is alone may come in several steps."""
    for at, to, data, offsets in text_blocks(texts):
        if len(data) <= _STEP or to - at > 1:
            yield at, to, data, offsets, 0
        else:
            for a in range(0, max(1, len(data) - depth + 1), _STEP):
                part = data[a : a + _STEP + depth - 1]
                yield at, to, part, np.array([0, len(part)]), a


def strings(rows: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """anchor, digest, doc_id, row_hash, at, wide, off: maximal runs of windows of one anchor, for every window of depth bytes of every row.

    A window's anchor is the gram within it of the smallest hash (of equal ones the leftmost), so equal windows have equal anchors at equal
    offsets. A run begins at byte `at`, has `wide` windows and its anchor `off` bytes from its start; digest: a hash of its wide + depth - 1 bytes.
    """
    width, low = depth - gram + 1, np.uint64((1 << _PLACE_BITS) - 1)

    def run(b: pa.RecordBatch) -> Iterator[dict[str, object]]:
        ids, hashes = (b.column(c).to_numpy() for c in ("doc_id", "row_hash"))
        for first, to, data, offsets, before in _steps(b.column("text"), depth):
            windows = np.maximum(np.diff(offsets) - depth + 1, 0)
            if not windows.any():
                continue
            sums, n = _sums(_TABLES[0], data), len(data) - gram + 1
            grams = _hash(sums, slice(0, n), slice(gram, None))
            best = sliding_min((grams & ~low) | np.arange(n, dtype=np.uint64), width) & low
            starts = gather(offsets[:-1], windows)
            chosen = best[starts]
            begins = np.ones(len(starts), bool)
            begins[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
            begins = np.flatnonzero(begins)
            wide = np.diff(np.append(begins, len(starts)))
            a, place = starts[begins], chosen[begins].astype(np.int64)
            row = np.searchsorted(offsets, a, "right") - 1
            digests = _hash(_sums(_TABLES[1], data), a, a + wide + depth - 1)
            yield {
                "anchor": grams[place].view(np.int64), "digest": digests.view(np.int64), "doc_id": ids[first + row], "row_hash": hashes[first + row],
                "at": a - offsets[row] + before, "wide": wide.astype(np.int16), "off": (place - a).astype(np.int16),
            }

    return map_batches(rows, run, f"anchor long, digest long, {_PLACE}, at long, wide short, off short")


def refine(data: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """For each place of data a bucket that it shares with the places where the same depth bytes begin, in order of those bytes; -1 where there is no
    other, or fewer than depth bytes before the end of its string (ends: for each place, where its string ends).

    First buckets are those of q-grams. A bucket's places are then sorted by the buckets that lie h bytes further on, which are known for h bytes,
    so that each refinement doubles what the next one reads. A bucket of one place is done, and so is whatever points into it.
    """
    n = len(data)
    out = np.full(n, -1, np.int64)
    if n < depth:
        return out
    padded = np.concatenate([data, np.zeros(_Q, np.uint8)])
    keys = np.zeros(n, np.uint64)
    for i in range(_Q):
        keys = (keys << np.uint64(8)) | padded[i : i + n].astype(np.uint64)
    known, place = min(_Q, depth), np.arange(n)
    keys >>= np.uint64(8 * (_Q - known))
    live = np.flatnonzero(place + known <= ends)
    first = True
    while first or known < depth:
        # The last refinement overlaps what is known, so that exactly depth bytes are compared.
        step = 0 if first else min(known, depth - known)
        if not first:
            live = live[place[live] + known + step <= ends[live]]
            live = live[out[live + step] >= 0]
        pairs = keys[live] if first else out[live] * n + out[live + step]
        _, bucket, count = np.unique(pairs, return_inverse=True, return_counts=True)
        out[:] = -1
        keep = count[bucket] > 1
        live = live[keep]
        out[live] = bucket[keep]
        known, first = known + step, False
    return out


def _repeats(doc: np.ndarray, row: np.ndarray, at: np.ndarray, wide: np.ndarray, texts: list[bytes], depth: int) -> dict[str, np.ndarray]:
    """doc_id, row_hash, from, to: bytes of the strings' windows that also begin at an earlier place among these strings."""
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    bucket = refine(np.frombuffer(b"".join(texts), np.uint8), np.repeat(begin + sizes, sizes), depth)
    starts, string = gather(begin, wide), np.repeat(np.arange(len(texts)), wide)
    b = bucket[starts]
    some = np.flatnonzero(b >= 0)
    b, string = b[some], string[some]
    byte = starts[some] - begin[string] + at[string]
    order = np.lexsort((byte, row[string], doc[string], b))
    later = np.zeros(len(order), bool)
    later[1:] = b[order][1:] == b[order][:-1]
    gone = np.sort(order[later])
    s, x = string[gone], byte[gone]
    new = np.ones(len(gone), bool)
    new[1:] = (s[1:] != s[:-1]) | (x[1:] != x[:-1] + 1)
    cut = np.flatnonzero(new)
    last = np.append(cut[1:], len(gone)) - 1 if len(cut) else cut
    return {"doc_id": doc[s[cut]], "row_hash": row[s[cut]], "from": x[cut], "to": x[last] + depth}


def _refined(buckets: DataFrame, depth: int) -> DataFrame:
    """doc_id, row_hash, from, to of the repeats within each bucket. A task takes whole buckets, some thousands of strings at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> pa.RecordBatch:
            doc, row, at, wide = (t.column(c).to_numpy() for c in ("doc_id", "row_hash", "at", "wide"))
            return pa.RecordBatch.from_pydict(_repeats(doc, row, at, wide.astype(np.int64), t.column("piece").to_pylist(), depth))

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= TASK_STRINGS:
                t = pa.Table.from_batches(held)
                ids = t.column("bucket").to_numpy()
                # All but the last bucket, of which more may follow; it is smaller than what is held at a time.
                cut = int(np.flatnonzero(ids != ids[-1])[-1]) + 1 if (ids != ids[-1]).any() else 0
                if cut:
                    yield done(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield done(pa.Table.from_batches(held))

    return buckets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, f"{_PLACE}, from long, to long")


def _pieces(rows: DataFrame, mixed: DataFrame, depth: int) -> DataFrame:
    """bucket, lo, hi, doc_id, row_hash, at, wide, off, piece: the bytes of the strings that mixed lists, read from their rows. lo, hi: how far from its start a window's anchor may lie in the bucket."""
    lists = mixed.groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("at", "wide", "off", "anchor")).alias("cuts"))
    met = rows.join(lists.hint("shuffle_hash"), ["doc_id", "row_hash"])

    def run(b: pa.RecordBatch) -> Iterator[dict[str, object]]:
        cuts = b.column("cuts")
        row = np.repeat(np.arange(b.num_rows), np.diff(cuts.offsets.to_numpy()))
        flat = cuts.flatten()
        at, wide = flat.field("at").to_numpy(), flat.field("wide").to_numpy()
        raw = [t.as_buffer() for t in b.column("text")]
        pieces = [raw[i][s : s + w + depth - 1].to_pybytes() for i, s, w in zip(row.tolist(), at.tolist(), wide.tolist())]
        same = {c: b.column(c).to_numpy()[row] for c in ("doc_id", "row_hash")}
        n = len(row)
        yield {"bucket": flat.field("anchor"), "lo": np.zeros(n, np.int16), "hi": np.full(n, depth, np.int16), **same, "at": at, "wide": wide, "off": flat.field("off"), "piece": pa.array(pieces, pa.binary())}

    return map_batches(met, run, f"bucket long, lo short, hi short, {_PLACE}, at long, wide short, off short, piece binary")


def _split(big: DataFrame, depth: int) -> DataFrame:
    """Each string of buckets that are too large, cut in two by how far a window's anchor lies from its start. All windows of a half have more
    bytes in common places, and those bytes choose the half's bucket, as a later offset does in the sort itself."""

    def run(b: pa.RecordBatch) -> Iterator[dict[str, object]]:
        out: list[tuple] = []
        for r in b.to_pylist():
            mid = (r["lo"] + r["hi"]) // 2
            for lo, hi in ((r["lo"], mid), (mid + 1, r["hi"])):
                # Windows begin `off` to off - wide + 1 bytes before the anchor.
                far, near = min(hi, r["off"]), max(lo, r["off"] - r["wide"] + 1)
                if near > far:
                    continue
                skip, wide = r["off"] - far, far - near + 1
                a = r["off"] - lo
                common = r["piece"][a : r["off"] - hi + depth] if hi - lo < depth else b""
                h = hashlib.blake2b(common, digest_size=8, key=f"{r['bucket']},{lo}".encode()).digest()
                out.append((int.from_bytes(h, "little", signed=True), lo, hi, r["doc_id"], r["row_hash"], r["at"] + skip, wide, far, r["piece"][skip : skip + wide + depth - 1]))
        names = ("bucket", "lo", "hi", "doc_id", "row_hash", "at", "wide", "off", "piece")
        types = (pa.int64(), pa.int16(), pa.int16(), pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.binary())
        if out:
            yield {n: pa.array(x, t) for n, t, x in zip(names, types, zip(*out))}

    return map_batches(big, run, f"bucket long, lo short, hi short, {_PLACE}, at long, wide short, off short, piece binary")


def repeats(rows: DataFrame, depth: int = DEPTH, gram: int = GRAM, task_strings: int = TASK_STRINGS) -> DataFrame:
    """doc_id, row_hash, from, to: bytes that lie in a string of depth bytes which also begins at an earlier place (smaller doc_id, then row_hash,
    then byte). rows: as row_key gives them, text not null. Stretches may overlap.

    Of strings that are alike (by 128 bits), all but the first are repeats as a whole, and only the first is sorted, if its anchor has other strings too.
    """
    found = stage(strings(rows, depth, gram), "strings")
    often = stage(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    known = stage(join_hot(found, often, ["anchor"]).drop("n"), "repeated")
    place = F.struct("doc_id", "row_hash", "at")
    firsts = known.groupBy("anchor", "digest", "wide", "off").agg(F.min(place).alias("place"))
    firsts = stage(firsts.select("anchor", "wide", "off", "place.*"), "firsts")
    later = known.join(firsts.select("doc_id", "row_hash", "at"), ["doc_id", "row_hash", "at"], "left_anti")
    out = later.select("doc_id", "row_hash", F.col("at").alias("from"), (F.col("at") + F.col("wide") + depth - 1).alias("to"))
    shared = stage(firsts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    open_ = stage(_pieces(rows, join_hot(firsts, shared, ["anchor"]), depth), "pieces")
    while True:
        size = stage(open_.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        met = stage(join_hot(open_, size, ["bucket"]), "buckets")
        out = out.unionByName(_refined(met.where(F.col("n") <= task_strings).drop("n"), depth))
        big = met.where(F.col("n") > task_strings).drop("n")
        # Where the anchor's offset is the same, a string is one window, and the same ones are counted, not sorted.
        alone = big.where("lo = hi")
        first = alone.groupBy("piece").agg(F.min(place).alias("place")).select("place.*")
        again = alone.join(first, ["doc_id", "row_hash", "at"], "left_anti")
        out = out.unionByName(again.select("doc_id", "row_hash", F.col("at").alias("from"), (F.col("at") + depth).alias("to")))
        if size.where(F.col("n") > task_strings).isEmpty():
            return out
        open_ = stage(_split(big.where("lo < hi"), depth), "halves")


def dedup_bytes(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, task_strings: int = TASK_STRINGS) -> DataFrame:
    """doc_id, n_bytes, spans (array of from, to: maximal stretches of removed bytes), kept (binary): each row of docs, whose text is taken as UTF-8 bytes.

    A byte goes if a string of depth bytes over it also begins earlier: at a smaller doc_id, or further up in the same text; a null doc_id comes first.
    Different texts of one doc_id go by a hash of theirs; rows alike in both count as one place, so neither empties the other. Null and empty
    texts have no bytes. What is kept may cut a character in two, hence binary. Other columns are dropped, whatever their names.

    Shuffles: a row of numbers for about every 35 bytes, twice; texts twice, to read the strings that are sorted and to take out the repeats.
    gram is at most depth; a gram of 8 bytes or more.
    """
    if not 1 <= gram <= depth:
        raise ValueError("gram is 1 to depth")
    rows = row_key(docs)
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("row_hash", F.coalesce("row_hash", F.lit(0).cast("long")))
    long_ones = rows.where(F.octet_length("text") >= depth)
    gone = repeats(long_ones, depth, gram, task_strings).groupBy("doc_id", "row_hash").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("gone"))
    met = rows.join(stage(gone, "gone").hint("shuffle_hash"), ["doc_id", "row_hash"], "left")

    def run(b: pa.RecordBatch) -> Iterator[dict[str, object]]:
        kept, spans, sizes = [], [], []
        for text, gone in zip(b.column("text"), b.column("gone")):
            raw, cut = text.as_buffer(), []
            for r in gone.as_py() or ():
                if cut and r["from"] <= cut[-1]["to"]:
                    cut[-1]["to"] = max(cut[-1]["to"], r["to"])
                else:
                    cut.append(r)
            ends = [0, *(x for r in cut for x in (r["from"], r["to"])), len(raw)]
            kept.append(b"".join(raw[a:z].to_pybytes() for a, z in zip(ends[::2], ends[1::2])))
            spans.append(cut)
            sizes.append(len(raw))
        spans_type = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        yield {"doc_id": b.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "spans": pa.array(spans, spans_type), "kept": pa.array(kept, pa.binary())}

    out = map_batches(met.select("doc_id", "text", "gone"), run, "doc_id long, n_bytes long, spans array<struct<from: long, to: long>>, kept binary")
    return out.withColumn("doc_id", real_id())


def digest(found: DataFrame) -> DataFrame:
    """A row a document of dedup_bytes with the contract's columns."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
