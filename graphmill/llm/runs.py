"""Runs (maximal periodic stretches) of words, from Lyndon words whose extensions are found in linear time, as Ellert and Fischer do.

Words are only ever compared: there are no hashes, suffix arrays or suffix trees. Each text is one row of one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import map_batches

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def lyndon_edges(x: list[int]) -> tuple[list[int], list[int]]:
    """For each place i, where the next smaller suffix begins (len(x) if none does), and how far the two suffixes agree.

    x[i : next[i]] is the longest Lyndon word at i. Places are visited from left to right; those whose next smaller suffix is
    still to come form a chain (`below`). The match that reaches furthest to the right is kept: x[b : end] repeats the words d
    places earlier. Whatever is compared within it was compared d places earlier, so its extension is taken from there, and words
    are compared anew only from `end` on. Each such comparison moves `end` or settles a place, so the work is linear.
    """
    n = len(x)
    after, agree, below, shared = [n] * n, [0] * n, [-1] * n, [0] * n
    b = d = end = 0
    for r in range(1, n):
        left, k = r - 1, 0
        while left >= 0:
            k = 0
            if r < end:
                s, m = r - d, left - d if left >= b else left
                if after[m] == s:
                    k = agree[m]
                elif below[s] == m:
                    k = shared[s]
            if r + k >= end or not k:
                k = max(0, min(k, end - r))
                while r + k < n and x[left + k] == x[r + k]:
                    k += 1
                if r + k >= end:
                    b, d, end = r, r - left, r + k
            if r + k < n and x[left + k] < x[r + k]:
                break
            after[left], agree[left] = r, k
            left = below[left]
        below[r], shared[r] = left, k
    return after, agree


def maximal_runs(x: list[int], min_length: int = 1, min_periods: int = 2) -> set[tuple[int, int, int]]:
    """{(start, length, smallest period)} of the runs of x with length >= max(min_length, min_periods * period).

    In one of the two orders of the alphabet, every run has a Lyndon word of one period as the longest one at its place; the first such place of
    the run lies less than a period from its start, so a run is extended to the left by less than that.
    """
    out = set()
    for y in (x, [-v for v in x]):
        after, agree = lyndon_edges(y)
        n = len(y)
        for i, j in enumerate(after):
            p, k = j - i, agree[i]
            if j == n or k <= (min_periods - 2) * p:
                continue
            if i >= p and after[i - p] == i and agree[i - p] >= p:
                continue
            t = 0
            while t < i and y[i - 1 - t] == y[j - 1 - t]:
                t += 1
            if (size := t + p + k) >= max(min_length, min_periods * p):
                out.add((i - t, size, p))
    return out


def word_runs(words: list[bytes], min_length: int, min_periods: int) -> list[tuple[int, int, int]]:
    """Runs of words in order of start, then period. A run of m periods holds each of its words m times or more, so a word
    that is rarer in the text lies in none, ends those beside it, and cuts the text into parts that have their own runs."""
    n, out = len(words), []
    if n < max(min_length, min_periods):
        return out
    order = sorted(range(n), key=words.__getitem__)
    ranks, at = [-1] * n, 0
    while at < n:
        to, word = at + 1, words[order[at]]
        while to < n and words[order[to]] == word:
            to += 1
        if to - at >= min_periods:
            for i in order[at:to]:
                ranks[i] = at
        at = to
    ranks.append(-1)
    begin = 0
    while begin < n:
        stop = ranks.index(-1, begin)
        if stop - begin >= max(min_length, min_periods):
            out += [(begin + s, size, p) for s, size, p in maximal_runs(ranks[begin:stop], min_length, min_periods)]
        begin = stop + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def find_runs(docs: DataFrame, min_length: int = 24, min_periods: int = 3, arrange: Callable[[int | None, int], list[int] | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, in words, by start, then period), collapsed: each row of docs.

    Words are `[^\\x20\\x09-\\x0D]+`. A run has length >= max(min_length, min_periods * period) (min_periods: 2 or more) and ends where a
    neighbour would break its smallest period. collapsed: the text without the words that any run holds after its first period, joined by one
    space. arrange(doc_id, number of words) may give the words' numbers in another order to be read instead; None leaves them.
    Null and empty texts have no words and no runs, and an empty collapsed text. A null doc_id stays null. Repeated rows give
    repeated rows. Other columns are dropped, whatever their names. No shuffle; a task holds one batch of texts.
    """
    if min_periods < 2 or min_length < 1:
        raise ValueError("min_periods is 2 or more, min_length 1 or more")

    def batch(b: pa.RecordBatch) -> Iterator[dict[str, object]]:
        ids = b.column("doc_id").to_pylist()
        counts, runs, left = [], [], []
        for doc, text in zip(ids, b.column("text")):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            order = arrange(doc, len(words)) if arrange and words else None
            words = words if order is None else [words[i] for i in order]
            found = word_runs(words, min_length, min_periods)
            counts.append(len(words))
            runs.append([{"start": s, "length": size, "period": p} for s, size, p in found])
            # `from_` is where the words that are known to be kept or dropped end.
            kept, from_ = [], 0
            for a, z in sorted((s + p, s + size) for s, size, p in found):
                kept += words[from_:a]
                from_ = max(from_, z)
            left.append(b" ".join(kept + words[from_:]))
        text = pa.array(left, pa.binary()).cast(pa.string())
        yield {"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(counts, pa.int64()), "runs": pa.array(runs, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), "collapsed": text}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), batch, SCHEMA)


def planted_order(doc_id: int | None, n: int) -> list[int] | None:
    """Of documents whose crc32 of the decimal id ends in 0, a tail is made to repeat; a null id stands for no such document."""
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*range(a), *(a + (i - a) % p for i in range(a, n))]


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; of equal ones the first by start, then period; null if there is none."""
    larger = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(larger(best, r), r).otherwise(best))


def digest(found: DataFrame) -> DataFrame:
    """A row a document of find_runs: n_runs, the strongest run and its exponent in thousandths, and hashes of all runs and of what is kept."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = found.withColumn("best", strongest(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
