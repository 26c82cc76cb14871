"""Benchmark decontamination over a positional inverted index of the training text."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.common import LOWER, NOT_ALNUM, gather, lists, map_batches, real_id, row_key, stage, text_blocks, word_bounds, word_hashes

#: Words of a phrase, and distinct benchmark words that travel to the tasks at a time (16 bytes each).
WINDOW, BLOCK_TERMS = 10, 1_000_000
#: A place is near a phrase if this share of its words stands within so many words of their offsets.
LEAST, SLACK = 0.8, 4
#: Parts into which the postings of every word are dealt by document, so that a common word is no one task's burden.
TERM_BLOCKS = 64
_WINDOW_KEY = ["doc_id", "row_hash", "win_id", "item_id", "size", "start"]


def hashed_words(texts: pa.Array):
    """(first row, rows' numbers of words, word hashes) of blocks of rows; ASCII letters are lower-cased."""
    for at, _, data, offsets in text_blocks(texts):
        data = LOWER[data]
        starts, ends, rows = word_bounds(data, offsets, NOT_ALNUM)
        yield at, np.diff(rows), word_hashes(data, starts, ends).view(np.int64)


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """win_id, item_id, terms, first: each window of consecutive words of each item (from its word `first`, the least of equal
    windows); an item of fewer words, but not none, is one. Items whose id or text is null have none; repeated items count once."""

    def run(b: pa.RecordBatch):
        for at, sizes, words in hashed_words(b.column(1)):
            ids, out, first = b.column(0)[at : at + len(sizes)].to_pylist(), [], 0
            for item, n in zip(ids, sizes.tolist()):
                out += [(item, words[first + i : first + min(n, i + window)], i) for i in range(max(1, n - window + 1) if n else 0)]
                first += n
            yield {"item_id": pa.array([x[0] for x in out], pa.int64()), "terms": pa.array([x[1] for x in out], pa.list_(pa.int64())), "first": pa.array([x[2] for x in out], pa.int32())}

    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    found = map_batches(rows, run, "item_id long, terms array<long>, first int").groupBy("item_id", "terms").agg(F.min("first").alias("first"))
    return found.withColumn("win_id", F.xxhash64("item_id", "terms"))


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """term, n: how many documents hold each of the terms (sorted hashes); counts meet after each task has summed its own."""

    def run(batches):
        total = np.zeros(len(terms), np.int64)
        for b in batches:
            for _, sizes, words in hashed_words(b.column(0)):
                at = np.minimum(np.searchsorted(terms, words), len(terms) - 1)
                hit = np.flatnonzero(terms[at] == words)
                row = np.repeat(np.arange(len(sizes)), sizes)[hit]
                total += np.bincount(np.unique(row * len(terms) + at[hit]) % len(terms), minlength=len(terms))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms[seen]), pa.array(total[seen])], names=["term", "n"])

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Support(NamedTuple):
    """What tells where the index needs postings for near places: as much as a block of windows has words.

    terms: hashes of all words, sorted; begins, item, off: the places in items of each one that is among a window's rarest;
    every: the places of all words, as sorted numbers; need: how many words of an item a near place has at least.
    """

    terms: np.ndarray
    begins: np.ndarray
    item: np.ndarray
    off: np.ndarray
    every: np.ndarray
    need: np.ndarray

    @staticmethod
    def of(rows: list, least: float) -> Support:
        """rows: (term, item_id, place in the item, size of its windows, whether it is among the rarest of one)."""
        term, item, off, size = (np.array([r[i] for r in rows], np.int64) for i in range(4))
        rare = np.array([r[4] for r in rows], bool)
        terms, t = np.unique(term, return_inverse=True)
        ids, item = np.unique(item, return_inverse=True)
        need = np.zeros(len(ids), np.int64)
        np.maximum.at(need, item, np.ceil(size * least - 1e-9).astype(np.int64))
        order = np.flatnonzero(rare)[np.argsort(t[rare], kind="stable")]
        return Support(terms, np.searchsorted(t[order], np.arange(len(terms) + 1)), item[order], off[order], np.sort((item * len(terms) + t << 24) + off), need)

    def spots(self, words: np.ndarray, row: np.ndarray, slack: int, reach: int) -> np.ndarray:
        """Places of words (whose documents are in row) with another rare word of an item in line with it, give or take slack, and
        around it as many of the item's words in line as it needs. Never too few: a word counts for every place it fits."""
        if not len(self.terms) or not len(words):
            return np.zeros(0, np.int64)
        t = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        known = self.terms[t] == words
        hit = np.flatnonzero(known)
        n = self.begins[t[hit] + 1] - self.begins[t[hit]]
        entry, place = gather(self.begins[t[hit]], n), np.repeat(hit, n)
        item, shift = self.item[entry], place - self.off[entry]
        # One number that sorts by row, item and shift.
        key = (row[place] * np.int64(len(self.need)) + item << np.int64(32)) + (shift + (1 << 24))
        order = np.argsort(key, kind="stable")
        close = np.flatnonzero(np.diff(key[order]) <= slack)
        pair = np.unique(order[np.concatenate([close, close + 1])])
        around, out = np.arange(-reach, reach + 1), []
        for at in range(0, len(pair), 20_000):
            x = pair[at : at + 20_000]
            q = place[x][:, None] + around
            inside = (q >= 0) & (q < len(words))
            q = np.clip(q, 0, len(words) - 1)
            inside &= known[q] & (row[q] == row[place[x]][:, None])
            low = (item[x][:, None] * len(self.terms) + t[q] << 24) + np.maximum(q - shift[x][:, None] - slack, 0)
            high = (item[x][:, None] * len(self.terms) + t[q] << 24) + np.maximum(q - shift[x][:, None] + slack + 1, 0)
            count = np.where(inside, np.searchsorted(self.every, high) - np.searchsorted(self.every, low), 0).sum(1)
            out.append(place[x[count >= self.need[item[x]]]])
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def postings(docs: DataFrame, terms: np.ndarray, leads: np.ndarray, reach: int, support: Support | None = None, slack: int = SLACK) -> DataFrame:
    """The positional inverted index, written by word: a row for each word and document with the word's places there in order.

    Columns term, block (of documents), close, doc_id, row_hash, places, n_words; and for each document one row of null term
    with its number of words. terms: sorted hashes of all benchmark words; of these, postings are stored where a lead (the
    rarest word of a window) stands within reach words, since every place of a window holds its lead; and (close)
    around the spots of the support, since every near place has them.
    """

    def entries(words: np.ndarray, rows: np.ndarray, lead: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of all indexed words within reach of the leads, sorted by document and word; where each entry begins; its document)"""
        row = np.searchsorted(rows, lead, "right") - 1
        near = np.zeros(len(words) + 1, np.int64)
        np.add.at(near, np.maximum(lead - reach, rows[row]), 1)
        np.add.at(near, np.minimum(lead + reach + 1, rows[row + 1]), -1)
        near = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        at = np.minimum(np.searchsorted(terms, words[near]), len(terms) - 1)
        near = near[terms[at] == words[near]]
        row = np.searchsorted(rows, near, "right") - 1
        order = np.lexsort((near, words[near], row))
        near, row = near[order], row[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(words[near]) != 0)])) if len(near) else near
        return near, new, row

    def run(b: pa.RecordBatch):
        for first, sizes, words in hashed_words(b.column(1)):
            part, rows = b.slice(first, len(sizes)), np.concatenate([[0], np.cumsum(sizes)])
            none = np.zeros(len(sizes), np.int64)
            yield {
                "term": pa.nulls(len(sizes), pa.int64()), "close": pa.array(none.astype(bool)), "doc_id": part.column(0), "row_hash": part.column(2),
                "n_words": pa.array(sizes.astype(np.int64)), "places": lists(np.zeros(0, np.int32), none),
            }
            at = np.minimum(np.searchsorted(leads, words), max(0, len(leads) - 1))
            found = [(False, np.flatnonzero(leads[at] == words) if len(leads) else none[:0], reach)]
            if support:
                found.append((True, support.spots(words, np.repeat(np.arange(len(sizes)), sizes), slack, reach + slack), reach + slack))
            for close, lead, wide in found:
                near, new, row = entries(words, rows, lead, wide)
                take = pa.array(row[new])
                yield {
                    "term": pa.array(words[near[new]]), "close": pa.array(np.full(len(new), close)), "doc_id": part.column(0).take(take), "row_hash": part.column(2).take(take),
                    "n_words": pa.nulls(len(new), pa.int64()), "places": lists((near - rows[row]).astype(np.int32), np.diff(np.append(new, len(near)))),
                }

    rows = map_batches(docs, run, "term long, close boolean, doc_id long, row_hash long, n_words long, places array<int>").withColumn("block", F.pmod(F.xxhash64("doc_id", "row_hash"), F.lit(TERM_BLOCKS)).cast("int"))
    return stage(rows.repartition("term", "block").sortWithinPartitions("close", "term", "doc_id", "row_hash"), "index")


def _holding(found: DataFrame, posts: DataFrame, slack: int = 0) -> DataFrame:
    """The rows of found (with term and off) whose document has the word at start + off, give or take slack words."""
    f, p = found.alias("f"), posts.select("term", "doc_id", "row_hash", "places").alias("p")
    place = F.col("f.start") + F.col("f.off")
    stands = F.array_contains("p.places", place) if slack == 0 else F.exists("p.places", lambda x: F.abs(x - place) <= slack)
    same = [F.col(f"f.{c}") == F.col(f"p.{c}") for c in ("doc_id", "row_hash", "term")]
    return f.join(p, [*same, stands], "left_semi").select("f.*")


def _led(posts: DataFrame, leads: DataFrame) -> DataFrame:
    """Where windows would begin by the places of the leads (a bounded table: so many windows make a block)."""
    met = posts.join(F.broadcast(leads.select("term", "off", "win_id", "item_id", "size")), "term")
    return met.select("doc_id", "row_hash", "win_id", "item_id", "size", F.explode(F.transform("places", lambda x: x - F.col("off"))).alias("start"))


def _matches(posts: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, row_hash, item_id, start, size: where all words of a window stand at their offsets.

    windows: win_id, item_id, term, off, size, rank (0: the window's rarest word). Lists are intersected from
    the rarest: its places give candidates, the second rarest thins them, the others confirm what is left.
    """
    found = _led(posts, windows.where("rank = 0")).where("start >= 0")
    second = _holding(found.where("size > 1").join(windows.where("rank = 1").select("win_id", "term", "off"), "win_id"), posts)
    second = second.select(*_WINDOW_KEY)
    rest = second.where("size > 2").join(windows.where("rank > 1").select("win_id", "term", "off"), "win_id")
    # A set, since repeated rows give each place several times; it holds no more than a window's words.
    whole = _holding(rest, posts).groupBy(*_WINDOW_KEY).agg(F.size(F.collect_set("off")).alias("n")).where("n = size - 2").select(*_WINDOW_KEY)
    return found.where("size = 1").select(*_WINDOW_KEY).unionByName(second.where("size = 2")).unionByName(whole).drop("win_id").distinct()


def _spare(least: float) -> F.Column:
    """How many of a window's words a near place may lack."""
    return F.col("size") - F.ceil(F.col("size") * least - 1e-9)


def _support(windows: DataFrame, least: float) -> DataFrame:
    """term, item_id, item_off, size, rare: the places in items of all words; rare: a near place of some window holds two of these."""
    placed = windows.where("size > 1").groupBy("term", "item_id", (F.col("first") + F.col("off")).alias("item_off"))
    return placed.agg(F.max("size").alias("size"), F.max(F.col("rank") <= _spare(least) + 1).alias("rare"))


def _near(posts: DataFrame, windows: DataFrame, slack: int, least: float) -> DataFrame:
    """doc_id, row_hash, item_id, start, share: near places of windows, start as each of their leads would have it.

    A place may lack `spare` words, so one of the spare + 1 rarest leads to it, and of the spare + 2 rarest it holds two.
    Those two are looked for first, for all windows of an item at once: lists are shifted by the words' places in the
    item, and only entries that have another within slack go on. Then the rarest are counted, and the others for what is left.
    """
    spare = _spare(least)
    item_off = F.col("first") + F.col("off")
    # Both tables are bounded by the words of a block.
    support = _support(windows, least).where("rare").select("term", "item_id", "item_off")
    leads = windows.where(F.col("rank") <= spare).where("size > 1").select("item_id", item_off.alias("item_off"), "win_id", "size", "first")
    spots = posts.join(F.broadcast(support), "term").select("doc_id", "row_hash", "item_id", "item_off", F.explode(F.transform("places", lambda x: x - F.col("item_off"))).alias("shift"))
    order = Window.partitionBy("doc_id", "row_hash", "item_id").orderBy("shift")
    gap = F.least(F.col("shift") - F.lag("shift").over(order), F.lead("shift").over(order) - F.col("shift"))
    pairs = spots.withColumn("gap", gap).where(F.col("gap") <= slack)
    found = pairs.join(F.broadcast(leads), ["item_id", "item_off"]).select("doc_id", "row_hash", "win_id", "item_id", "size", (F.col("shift") + F.col("first")).alias("start"))
    found = stage(found.distinct(), "near")
    terms = windows.select("win_id", "term", "off", "rank")
    count = lambda df, name: df.groupBy(*_WINDOW_KEY).agg(F.size(F.collect_set("off")).alias(name))
    first = stage(count(_holding(found.join(terms, "win_id").where(F.col("rank") <= spare + 1), posts, slack), "few").where(F.col("few") >= F.least("size", spare + 2) - spare), "nearer")
    other = count(_holding(first.drop("few").join(terms, "win_id").where(F.col("rank") > spare + 1), posts, slack), "more")
    share = (F.col("few") + F.coalesce("more", F.lit(0))) / F.col("size")
    return first.join(other, _WINDOW_KEY, "left").select("doc_id", "row_hash", "item_id", "start", share.alias("share")).where(F.col("share") >= least - 1e-9)


def _blocks(windows: DataFrame) -> list[DataFrame]:
    """The windows in parts of about BLOCK_TERMS words each, so that what travels to the tasks stays bounded."""
    words = windows.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    n = -(-int(words) // BLOCK_TERMS)
    return [windows.where(F.pmod(F.xxhash64("win_id"), F.lit(n)) == i) for i in range(n)]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: bool = False, slack: int = SLACK, least: float = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: doc_id, row_hash, n_words; exact matches: doc_id, row_hash, item_id, start, size; near ones, if asked for:
    doc_id, row_hash, item_id, start, share). Ids are those of row_key; an index is built for each block of windows."""
    rows, parts = row_key(docs), []
    for block in _blocks(windows := stage(item_windows(benchmark, window), "windows")) or [windows]:
        exploded = block.select("win_id", "item_id", "first", F.size("terms").alias("size"), F.posexplode("terms").alias("off", "term"))
        terms = np.array(sorted(r[0] for r in exploded.select("term").distinct().collect()) or [0], np.int64)
        df = stage(document_frequencies(rows, terms), "df")
        order = Window.partitionBy("win_id").orderBy(F.coalesce("n", F.lit(0)), "term", "off")
        ranked = stage(exploded.join(df, "term", "left").withColumn("rank", F.row_number().over(order) - 1).drop("n"), "ranked")
        leads = np.array(sorted(r[0] for r in ranked.where("rank = 0").select("term").distinct().collect()), np.int64)
        support = Support.of(_support(ranked, least).collect(), least) if near else None
        index = postings(rows, terms, leads, window - 1, support, slack)
        exact, close = (index.where("term is not null").where(F.col("close") == x) for x in (False, True))
        matches = _matches(exact, ranked)
        # A place of a one-word window is exact or none.
        one = matches.where("size = 1").select("doc_id", "row_hash", "item_id", "start", F.lit(1.0).alias("share"))
        parts.append((index.where("term is null").select("doc_id", "row_hash", "n_words"), matches, _near(close, ranked, slack, least).union(one) if near else None))
    every = lambda i: reduce(DataFrame.unionByName, (p[i] for p in parts))
    return parts[0][0], every(1), every(2) if near else None


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: bool = False) -> DataFrame:
    """doc_id, row_hash, n_words, n_hit, n_items, items (ids), spans (word positions) of every document; and where near is
    asked for near_items, the ids of the items of which a place comes near (as `proximity` tells; exact places are near).

    A window is `window` consecutive words of an item ([0-9a-z] and non-ASCII runs, ASCII letters lower-cased);
    an item of fewer words is one window. A word of a document inside any place of a window is hit. Null texts
    have no words; rows of one doc_id are told apart by a hash of their texts; an empty benchmark hits nothing.
    """
    counted, matches, close = find(docs, benchmark, window, near)
    order = Window.partitionBy("doc_id", "row_hash").orderBy("start", "to")
    places = matches.select("doc_id", "row_hash", "start", (F.col("start") + F.col("size")).alias("to")).distinct()
    reach = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(order)
    spans = places.withColumn("reach", reach).withColumn("run", run).groupBy("doc_id", "row_hash", "run").agg(F.min("start").alias("from"), F.max("to").alias("to"))
    spans = spans.groupBy("doc_id", "row_hash").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans"), F.sum(F.col("to") - F.col("from")).alias("n_hit"))
    items = matches.groupBy("doc_id", "row_hash").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    hits = spans.join(items, ["doc_id", "row_hash"])
    out = counted.join(hits, ["doc_id", "row_hash"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    out = out.select("doc_id", "row_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans")
    if near:
        around = close.groupBy("doc_id", "row_hash").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("near_items"))
        out = out.join(around, ["doc_id", "row_hash"], "left").withColumn("near_items", F.coalesce("near_items", F.array().cast("array<string>")))
    return out.withColumn("doc_id", real_id())


def digest(found: DataFrame) -> DataFrame:
    """The items as one hash, and whether anything was hit; how many items come near, if that was asked for."""
    more = [F.size("near_items").cast("long").alias("n_near_items")] if "near_items" in found.columns else []
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), *more)


def proximity(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = SLACK, least: float = LEAST) -> DataFrame:
    """doc_id, row_hash, item_id, start, share: places where at least `least` of a window's words stand within slack words of
    their offsets from one of its rarest words; start is where an exact match would begin.

    So many of the rarest words lead that a place which holds a share of `least` holds one of them. Nulls, repeats
    and empty tables as in `contaminated`; other columns are left out.
    """
    close = find(docs, benchmark, window, True, slack, least)[2]
    return close.groupBy(real_id(), "row_hash", "item_id", "start").agg(F.max("share").alias("share"))
