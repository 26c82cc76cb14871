"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.common import LOWER, SPACE, gram_hashes, join_hot, lists, map_batches, mix, real_id, row_key, stage, text_blocks, word_bounds, word_hashes

#: Two sets of similarity 0.8 share no band with probability (1 - 0.8 ** 10) ** 100 = 1.2e-5; at 0.6 they share one with 0.45.
BANDS, BAND_ROWS = 100, 10
#: Centres of a bucket whose classes its first star has not brought together, and tasks among which a centre's pairs are dealt.
MORE_CENTRES, SPREAD = 4, 256


def shingle_sets(texts: pa.Array, size: int):
    """(row, sorted distinct hashes of its shingles of `size` words); the whole sequence is one if it is shorter."""
    for at, _, data, offsets in text_blocks(texts):
        data = LOWER[data]
        starts, ends, rows = word_bounds(data, offsets, SPACE)
        words = word_hashes(data, starts, ends)
        grams = gram_hashes(words, size)
        for i, (a, z) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist())):
            if z - a >= size:
                yield at + i, np.unique(grams[a : z - size + 1])
            elif z > a:
                yield at + i, gram_hashes(words[a:z], z - a) ^ np.uint64(z - a)
            else:
                yield at + i, np.zeros(0, np.uint64)


#: Empty bins of a set with at least so many filled ones look for theirs step by step, others among all at once; both find the same.
STEPWISE, STEPS = 128, 64


@functools.lru_cache(4)
def _orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin its own order of all bins to borrow from: the first STEPS of them, and the place of each bin in it."""
    i = np.arange(bins, dtype=np.uint64)
    order = np.argsort(mix((i[:, None] + np.uint64(1 << 40)) * np.uint64(1_000_003) + i), axis=1, kind="stable")
    place = np.empty((bins, bins), np.int32)
    np.put_along_axis(place, order, np.arange(bins, dtype=np.int32)[None, :], 1)
    return np.ascontiguousarray(order[:, :STEPS].T), place


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """The smallest hash of each bin of the one permutation; an empty bin borrows from the first filled bin in its own
    order of bins, so that all pairs of sets agree in each bin with the probability of their similarity."""
    where = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(where, prepend=-1))  # hashes are sorted
    filled = where[first]
    out = np.zeros(bins, np.uint64)
    out[filled] = hashes[first]
    if len(filled) == bins:
        return out
    tried, place = _orders(bins)
    full = np.zeros(bins, bool)
    full[filled] = True
    empty, source = np.flatnonzero(~full), np.arange(bins)
    if len(filled) >= STEPWISE:
        for t in range(STEPS):
            s = tried[t, empty]
            ok = full[s]
            source[empty[ok]] = s[ok]
            empty = empty[~ok]
            if not len(empty):
                break
    if len(empty):
        source[empty] = filled[place[empty[:, None], filled].argmin(1)]
    return out[source]


def survey(rows: DataFrame, size: int, bands: int, band_rows: int) -> DataFrame:
    """doc_id, row_hash, n_shingles, cls (a hash of the set; equal sets are one class), buckets (one a band)."""

    def run(b: pa.RecordBatch):
        n, cls, keys = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.uint64), []
        base = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for i, hashes in shingle_sets(b.column(1), size):
            n[i] = len(hashes)
            if len(hashes):
                cls[i] = mix(mix(hashes ^ np.uint64(0x51ED270B)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(hashes)))[0]
                keys.append(base ^ gram_rows(signature(hashes, bands * band_rows).reshape(bands, band_rows)))
        size_of = np.where(n > 0, bands, 0)
        yield {"doc_id": b.column(0), "row_hash": b.column(2), "n_shingles": pa.array(n), "cls": pa.array(cls.view(np.int64)), "buckets": lists(np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64), size_of)}

    return map_batches(rows, run, "doc_id long, row_hash long, n_shingles long, cls long, buckets array<long>")


def gram_rows(values: np.ndarray) -> np.ndarray:
    """One hash of each row of a matrix."""
    out = np.zeros(len(values), np.uint64)
    for j in range(values.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[:, j])
    return out


def full_sets(rows: DataFrame, size: int) -> DataFrame:
    """cls, shingles: the whole set of each given row."""

    def run(b: pa.RecordBatch):
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            found = [h for _, h in shingle_sets(part.column(1), size)]
            yield {"cls": part.column(0), "shingles": lists(np.concatenate(found).view(np.int64), np.array([len(h) for h in found]))}

    return map_batches(rows.select("cls", "text"), run, "cls long, shingles array<long>")


def similar(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """a, b: those of the distinct pairs of classes (a written table) whose full sets are similar enough.

    A centre can have any number of partners: its pairs are dealt by partner to SPREAD parts, and its set is sent once
    to each part that has pairs, so no part grows with the group and no set is sent more often than it has pairs.
    """
    num, den = share
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SPREAD)).alias("part"))
    centres = dealt.select("a", "part").distinct().join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")).hint("merge"), "a")
    met = dealt.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")).hint("merge"), "b").join(centres.hint("merge"), ["a", "part"])
    # intersection / (sum - intersection) >= num / den
    linked = F.size(F.array_intersect("sa", "sb")).cast("long") * (num + den) >= (F.size("sa") + F.size("sb")).cast("long") * num
    return stage(met.where(linked).select("a", "b"), "links")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of the component of each node of the edges (a, b); alternating stars.

    Each step joins neighbours with the smallest of theirs; a written table ends each step. Nodes of
    many neighbours are a combined minimum and a join that Spark can split, never a gathered list.
    """
    e = stage(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = now


def _star_pairs(members: DataFrame, centres: DataFrame, share: tuple[int, int], apart: bool) -> DataFrame:
    """a, b (a < b): each member with its bucket's centres, if their sizes let them be similar and (apart) their components differ."""
    num, den = share
    met = members.join(centres.hint("merge"), "bucket").where("cls != a").where(F.least("size", "a_size") * den >= F.greatest("size", "a_size") * num)
    met = met.where("root != a_root") if apart else met
    return met.select(F.least("a", "cls").alias("a"), F.greatest("a", "cls").alias("b")).distinct()


def linked_classes(members: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """a, b: links between classes that share a bucket, by stars, so that pairs grow with the members and never with their square.

    members: bucket, cls, size (of its set). First every bucket has one star, around the class whose buckets have
    most members: of a group of near copies that is the least altered one, in all bands the same, so most members
    are brought together by one comparison each. Buckets that still hold classes of several components then have
    MORE_CENTRES stars each, around classes drawn by a hash of bucket and class, so that the bands draw different
    ones; only pairs of components still apart are compared. A bucket of up to MORE_CENTRES + 1 classes is so compared
    whole, a larger one by as many centres as all its members' bands draw. Every link is confirmed on full sets.
    """
    crowd = members.groupBy("bucket").agg(F.count("*").alias("crowd"))
    weight = members.join(crowd.hint("merge"), "bucket").groupBy("cls").agg(F.sum("crowd").alias("weight"))
    most = members.join(weight.hint("merge"), "cls").groupBy("bucket").agg(F.max(F.struct("weight", "cls", "size")).alias("c"))
    centres = most.select("bucket", F.col("c.cls").alias("a"), F.col("c.size").alias("a_size"))
    first = stage(_star_pairs(members, centres, share, False), "pairs")
    links = similar(first, sets, share)
    root = components(links).withColumnRenamed("node", "cls")
    named = stage(members.join(root.hint("merge"), "cls", "left").withColumn("root", F.coalesce("root", "cls")), "members")
    apart = named.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("bucket")
    left = stage(named.join(apart.hint("merge"), "bucket", "left_semi"), "members")
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("bucket", "cls"), "cls"))
    more = left.withColumn("nth", nth).where(F.col("nth") <= MORE_CENTRES).select("bucket", F.col("cls").alias("a"), F.col("size").alias("a_size"), F.col("root").alias("a_root"))
    second = _star_pairs(left, more, share, True).join(first.hint("merge"), ["a", "b"], "left_anti")
    return links.union(similar(stage(second, "pairs"), sets, share))


def near_duplicates(docs: DataFrame, size: int = 5, share: tuple[int, int] = (4, 5), bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, row_hash, n_shingles, component_id, kept of every document.

    A document's set: distinct shingles of `size` words (runs without ASCII white space, A-Z lower-cased), or the whole
    sequence if there are fewer; null, empty and blank texts have an empty set and link with nothing. Documents link
    if |intersection| / |union| >= share, confirmed on full sets; component_id is the smallest doc_id reachable and kept
    tells that it is the document's own. Equal sets are one class from the start, however many rows have them. Rows of
    one doc_id are told apart by a hash of their texts. A null doc_id comes first. Other columns are left out.
    """
    rows = row_key(docs)
    surveyed = stage(survey(rows, size, bands, band_rows), "minhash")
    some = surveyed.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "row_hash")).alias("one"), F.count("*").alias("n"))
    classes = stage(some.select("cls", "least", "one.*", "n"), "classes")
    # One row of each class speaks for it, so a bucket that counts two rows has two classes; a count is all that is shuffled to tell.
    key = ["cls", "doc_id", "row_hash"]
    speakers = surveyed.join(classes.select(*key).hint("merge"), key).dropDuplicates(key)
    members = speakers.select("cls", F.col("n_shingles").alias("size"), F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").count().where("count > 1").select("bucket")
    members = stage(members.join(shared.hint("merge"), "bucket", "left_semi"), "members")
    wanted = members.select("cls").distinct().join(classes.hint("merge"), "cls").select("cls", "doc_id", "row_hash")
    texts = rows.join(wanted.hint("merge"), ["doc_id", "row_hash"]).dropDuplicates(["doc_id", "row_hash"])
    sets = stage(full_sets(texts, size), "sets")
    root = components(linked_classes(members, sets, share)).withColumnRenamed("node", "cls")
    named = classes.select("cls", "least", F.col("n").alias("rows")).join(root.hint("merge"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = stage(named, "named")
    ids = stage(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "roots")
    found = stage(join_hot(named, ids, ["root"]).select("cls", "component_id", F.col("rows").alias("n")), "components")
    bare = surveyed.drop("buckets")
    out = join_hot(bare.where("n_shingles > 0"), found, ["cls"]).select("doc_id", "row_hash", "n_shingles", "component_id")
    out = out.union(bare.where("n_shingles = 0").select("doc_id", "row_hash", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select(real_id(), "row_hash", "n_shingles", real_id("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))
