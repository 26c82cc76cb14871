"""Substring dedup: recurring passages are confirmed, compiled into sharded Aho-Corasick automata, and found in every document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import SPACE, gram_hashes, lists, map_batches, mix, powers, real_id, row_key, stage, text_blocks, word_bounds, word_hashes

#: Words of a window; of the grams whose smallest hash stands for a window; passages in one automaton and stretches of text in one task.
WINDOW, GRAM, SHARD_PASSAGES, TASK_STRETCHES = 50, 10, 4_000, 20_000
#: Windows in one stretch at most.
LONGEST = 64
_WINDOW_BASE = np.uint64(0xA24BAED4963EE407)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each width consecutive values."""
    n, have, out = len(x) - width + 1, 1, x
    if n <= 0:
        return x[:0]
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[width - have : width - have + n])


class Words:
    """The words of a block of rows, and their windows of `window` words within one row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
        self.data, self.starts_at = data, None
        self.starts, self.ends, self.rows = word_bounds(data, offsets, SPACE)
        self.window = window
        hashes = word_hashes(data, self.starts, self.ends)
        sizes = np.diff(self.rows)
        n = np.maximum(sizes - window + 1, 0)
        self.window_rows = np.concatenate([[0], np.cumsum(n)])
        if n.sum():
            self.first = np.repeat(self.rows[:-1] - self.window_rows[:-1], n) + np.arange(self.window_rows[-1])
            #: Smallest gram of each window: equal windows have equal anchors.
            self.anchors = sliding_min(gram_hashes(hashes, gram), window - gram + 1)[self.first].view(np.int64)
            self._hashes = hashes
        else:
            self.first, self.anchors = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def window_hashes(self) -> np.ndarray:
        if not len(self.first):
            return np.zeros(0, np.int64)
        p = powers(_WINDOW_BASE, self.window)[::-1]
        h, out, at = self._hashes, np.zeros(len(self.first), np.uint64), self.first
        for i in range(self.window):
            out += h[at + i] * p[i]
        return mix(out).view(np.int64)

    def text(self, first: int, after: int) -> bytes:
        """Words first .. after - 1 of the block, joined by one space."""
        raw = self.data[self.starts[first] : self.ends[after - 1]].tobytes()
        return b" ".join(raw.split())


def blocks(b: pa.RecordBatch, column: int, window: int, gram: int) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for at, to, data, offsets in text_blocks(b.column(column)):
        yield b.slice(at, to - at), Words(data, offsets, window, gram)


def survey(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, row_hash, n_words, sha256 (of all words joined by one space), anchors (distinct) of every document."""

    def run(b: pa.RecordBatch):
        for part, w in blocks(b, 1, window, gram):
            found = [np.unique(w.anchors[a:z]) for a, z in zip(w.window_rows[:-1], w.window_rows[1:])]
            digests = [hashlib.sha256(b" ".join(t.as_buffer().to_pybytes().split()) if t.is_valid else b"").hexdigest() for t in part.column(1)]
            yield {"doc_id": part.column(0), "row_hash": part.column(2), "n_words": pa.array(np.diff(w.rows)), "sha256": pa.array(digests), "anchors": lists(np.concatenate(found) if found else np.zeros(0, np.int64), np.array([len(x) for x in found]))}

    return map_batches(rows, run, "doc_id long, row_hash long, n_words long, sha256 string, anchors array<long>")


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values the sorted array known holds."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _list(column: pa.Array, i: int) -> np.ndarray:
    x = column[i]
    return np.sort(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else np.zeros(0, np.int64)


def candidate_windows(candidates: DataFrame, window: int, gram: int) -> DataFrame:
    """win, doc_id: hashes of the windows whose anchor stands in more than one document; each once a document."""

    def run(b: pa.RecordBatch):
        for part, w in blocks(b, 2, window, gram):
            hashes, out = w.window_hashes(), []
            for i, (a, z) in enumerate(zip(w.window_rows[:-1], w.window_rows[1:])):
                out.append(np.unique(hashes[a:z][_among(w.anchors[a:z], _list(part.column(3), i))]))
            yield {"win": pa.array(np.concatenate(out)), "doc_id": pa.array(np.repeat(part.column(0).to_numpy(), [len(x) for x in out]))}

    return map_batches(candidates.select("doc_id", "row_hash", "text", "anchors"), run, "win long, doc_id long")


def stretches(candidates: DataFrame, window: int, gram: int) -> DataFrame:
    """anchor, doc_id, row_hash, at, text, passage: runs of windows with one anchor, as their words joined by one space.

    passage: windows that start here first of all documents and in another one too (their hashes are in `own`), the
    text to compile; the others are text to search. at: the run's first word.
    """

    def run(b: pa.RecordBatch):
        for part, w in blocks(b, 2, window, gram):
            hashes, out = w.window_hashes(), []
            for i, (a, z) in enumerate(zip(w.window_rows[:-1].tolist(), w.window_rows[1:].tolist())):
                if a == z:
                    continue
                anchors = w.anchors[a:z]
                kind = np.where(_among(hashes[a:z], _list(part.column(4), i)), 2, _among(anchors, _list(part.column(3), i)).astype(np.int64))
                cut = np.concatenate([[0], np.flatnonzero((np.diff(anchors) != 0) | (np.diff(kind) != 0)) + 1, [z - a]])
                row = int(w.rows[i])
                for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    if kind[s]:
                        for f in range(s, e, LONGEST):
                            out.append((int(anchors[s]), i, f, w.text(row + f, row + min(e, f + LONGEST) - 1 + window), bool(kind[s] == 2)))
            if out:
                anchor, i, at, text, passage = zip(*out)
                take = pa.array(i, pa.int32())
                yield {"anchor": pa.array(anchor, pa.int64()), "doc_id": part.column(0).take(take), "row_hash": part.column(1).take(take), "at": pa.array(at, pa.int64()), "text": pa.array(text, pa.binary()).cast(pa.string()), "passage": pa.array(passage)}

    return map_batches(candidates.select("doc_id", "row_hash", "text", "anchors", "own"), run, "anchor long, doc_id long, row_hash long, at long, text string, passage boolean")


def occurrences(passages: list[tuple[int, str]], texts: list[tuple[int, str]], window: int) -> Iterator[tuple[int, int, int]]:
    """(index of a text, first word, after the last) wherever windows of passages with a smaller document stand in it, joined where they
    overlap. passages and texts: (doc_id, words joined by one space).

    Every passage is cut into blocks of half a window, at least one of which lies whole in every window; one pass of the automaton finds the
    blocks. Each window of the text around a found block is then looked up whole, once, so what a text costs does not grow with the number of
    passages that share its blocks (near copies by the thousand do).
    """
    import ahocorasick

    half = max(1, (window + 1) // 2)
    number: dict[str, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    words = [tuple([number.setdefault(w, len(number) + 1) for w in text.split(" ")]) for _, text in passages]
    #: By the hash of a window: its passage and place, of equal windows in the smallest document; one for each different window.
    places: dict[int, list[tuple[int, int]]] = {}
    for p, seq in enumerate(words):
        for at in range(0, len(seq) - half + 1, half):
            automaton.add_word(seq[at : at + half])
        for at in range(len(seq) - window + 1):
            key = seq[at : at + window]
            same = places.setdefault(hash(key), [])
            i = next((i for i, (q, b) in enumerate(same) if words[q][b : b + window] == key), None)
            if i is None:
                same.append((p, at))
            elif passages[p][0] < passages[same[i][0]][0]:
                same[i] = (p, at)
    if not len(automaton):
        return
    automaton.make_automaton()
    get = number.get
    for t, (doc, text) in enumerate(texts):
        seq = tuple([get(w, 0) for w in text.split(" ")])
        began = after = tried = 0
        for end, _ in automaton.iter(seq):
            # Windows that hold the block; those before `tried` were looked up for an earlier block.
            for i in range(max(tried, end + 1 - window), min(end + 1 - half, len(seq) - window) + 1):
                key = seq[i : i + window]
                if any(passages[p][0] < doc and words[p][at : at + window] == key for p, at in places.get(hash(key), ())):
                    if i > after:
                        if after:
                            yield t, began, after
                        began = i
                    after = i + window
            tried = max(tried, end + 2 - half)
        if after:
            yield t, began, after


def repeats(rows: DataFrame, surveyed: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(candidates: rows that hold an anchor of another document; found: doc_id, row_hash, from, to in words)."""
    key = ["doc_id", "row_hash"]
    anchors = surveyed.select(*key, F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    mine = anchors.join(shared, "anchor", "left_semi").distinct().groupBy(*key).agg(F.collect_list("anchor").alias("anchors"))
    candidates = stage(rows.join(mine, key), "candidates")
    confirmed = candidate_windows(candidates, window, gram).groupBy("win").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")).where("doc_id < last")
    own = confirmed.groupBy("doc_id").agg(F.collect_list("win").alias("own"))
    cut = stage(stretches(candidates.join(own, "doc_id", "left"), window, gram), "stretches")
    passages, texts = cut.where("passage").select("anchor", F.col("doc_id").alias("source"), F.col("text").alias("words")).distinct(), cut.where("not passage")
    shards = max(1, -(-cut.where("passage").count() // SHARD_PASSAGES))
    dealt = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    # A hot shard's texts are dealt to several tasks, each of which compiles the shard's (bounded) automaton.
    tasks = texts.select(dealt).groupBy("shard").agg(F.ceil(F.count("*") / TASK_STRETCHES).cast("int").alias("tasks"))
    left = passages.select("*", dealt).join(F.broadcast(tasks) if shards <= 10_000 else tasks, "shard").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    right = texts.select("*", dealt).join(F.broadcast(tasks) if shards <= 10_000 else tasks, "shard").withColumn("task", F.pmod(F.xxhash64("doc_id", "row_hash", "at"), F.col("tasks")).cast("int"))

    def search(passages: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        found = list(occurrences(list(zip(passages["source"], passages["words"])), list(zip(texts["doc_id"], texts["text"])), window)) if len(passages) and len(texts) else []
        t = np.array([x[0] for x in found], np.int64)
        at = texts["at"].to_numpy()[t] if len(t) else t
        return pd.DataFrame({"doc_id": texts["doc_id"].to_numpy()[t] if len(t) else t, "row_hash": texts["row_hash"].to_numpy()[t] if len(t) else t, "from": at + np.array([x[1] for x in found], np.int64), "to": at + np.array([x[2] for x in found], np.int64)})

    grouped = left.select(F.col("shard").alias("s"), F.col("task").alias("t"), "source", "words").groupBy("s", "t").cogroup(right.select("shard", "task", "doc_id", "row_hash", "at", "text").groupBy("shard", "task"))
    return candidates, grouped.applyInPandas(search, "doc_id long, row_hash long, from long, to long")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def dedup_phrases(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, row_hash, n_words, n_removed, kept_sha256, removed (array of first word, after the last) of every document.

    Words are runs without ASCII white space. A word goes if a window of `window` consecutive words that covers it
    also starts in a document with a smaller doc_id; windows are judged on the input. kept_sha256 is of the kept
    words joined by one space. Null or short texts lose nothing; a null doc_id comes before all others; rows of one
    doc_id are told apart by a hash of their texts and never lose words to each other; other columns are left out.

    Scale: each window has an anchor, the smallest hash of its grams, of which there is about one in 20 words; only
    windows with anchors of two documents are hashed whole, and only confirmed passages are compiled. All of these
    meet by hash, combined before the shuffle, so copies by the thousand cost a row a task.
    """
    rows = row_key(docs)
    surveyed = stage(survey(rows, window, gram), "survey")
    candidates, found = repeats(rows, surveyed, window, gram)
    key = ["doc_id", "row_hash"]
    spans = found.groupBy(*key).agg(F.collect_set(F.struct("from", "to")).alias("spans"))

    def cut(b: pa.RecordBatch):
        removed, digests = [], []
        for text, spans in zip(b.column(2), b.column(3).to_pylist()):
            gone = merged([(s["from"], s["to"]) for s in spans])
            words, kept, at = text.as_buffer().to_pybytes().split(), [], 0
            for a, z in gone:
                kept += words[at:a]
                at = z
            kept += words[at:]
            removed.append([{"from": a, "to": z} for a, z in gone])
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield {"doc_id": b.column(0), "row_hash": b.column(1), "kept": pa.array(digests), "removed": pa.array(removed, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))}

    done = map_batches(candidates.select(*key, "text").dropDuplicates(key).join(spans, key), cut, "doc_id long, row_hash long, kept string, removed array<struct<from:long,to:long>>")
    none = F.array().cast("array<struct<from:long,to:long>>")
    out = surveyed.drop("anchors").join(done, key, "left").withColumn("removed", F.coalesce("removed", none))
    return out.select(real_id(), "row_hash", "n_words", F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["to"] - r["from"]).alias("n_removed"), F.coalesce("kept", "sha256").alias("kept_sha256"), "removed")
