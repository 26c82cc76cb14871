"""Language ID: a linear-chain conditional random field labels every word; a text takes the language of its words."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.common import LOWER, SPACE, byte_set, gather, map_batches, mix, powers, text_blocks, word_bounds, word_hashes

#: Words are parted by white space, ASCII digits and ASCII signs.
_SEPARATOR = SPACE | byte_set((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_LETTER = re.compile(r"[^\W\d_]")
_GRAM_BASE = np.uint64(0xD6E8FEB86659FD93)
#: Words of one chain; longer texts are several chains, all of which count.
CHAIN = 256
#: Bytes of text, and words not seen before, that one step works on: both bound a worker's arrays, neither changes a result.
STEP_BYTES, STEP_WORDS = 1 << 18, 4096


class Model(NamedTuple):
    """labels: languages; weights[feature slot, label]; transitions[from, to]; start[label]; lexicon: sorted hashes of known words."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    lexicon: np.ndarray


def lower_latin(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals to small letters."""
    data = LOWER[data]
    if len(data) > 1:
        lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97))
        data[lead + 1] += 0x20
    return data


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, lexicon: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of each word (one run after another) and how many each has: byte 1- to 4-grams with the
    word's edges marked (those at an edge are the affixes), and the word itself where the lexicon has it."""
    size = ends - starts + 2
    total = int(size.sum())
    first = np.cumsum(size) - size
    chars = np.full(total, 0x5E, np.uint64)
    inner = gather(first + 1, ends - starts)
    chars[inner] = data[gather(starts, ends - starts)]
    word = np.repeat(np.arange(len(starts)), size)
    left = np.repeat(first + size, size) - np.arange(total)  # characters from here to the word's end mark
    values, owner = [], []
    h = np.zeros(total, np.uint64)
    for k in range(1, 5):
        n = total - k + 1
        if n <= 0:
            break
        h = h[:n] * _GRAM_BASE + chars[k - 1 : k - 1 + n]
        ok = np.flatnonzero(left[:n] >= k)
        if k == 1:
            ok = inner
        values.append(mix(h[ok] + np.uint64(k << 40)))
        owner.append(word[ok])
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
        known = np.flatnonzero(lexicon[at] == hashes)
        values.append(mix(hashes[known] + np.uint64(99)))
        owner.append(known)
    values, owner = np.concatenate(values), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (values[order] % np.uint64(slots)).astype(np.int64), np.bincount(owner, minlength=len(starts))


def emissions(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Score of each label for each word, without its neighbours; the mean weight of its features times their root."""
    out = np.empty((len(starts), len(model.labels)))
    for a in range(0, len(starts), STEP_WORDS):
        z = a + STEP_WORDS
        slots, n = features(data, starts[a:z], ends[a:z], hashes[a:z], model.lexicon, len(model.weights))
        sums = np.zeros((len(slots) + 1, len(model.labels)))
        np.cumsum(model.weights[slots], axis=0, out=sums[1:])
        at = np.concatenate([[0], np.cumsum(n)])
        out[a:z] = (sums[at[1:]] - sums[at[:-1]]) / np.sqrt(np.maximum(n, 1))[:, None]
    return out


def chains(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of each chain, for rows of the given numbers of words."""
    n = -(-sizes // CHAIN)
    row = np.repeat(np.arange(len(sizes)), n)
    nth = gather(np.zeros(len(n), np.int64), n)
    first = np.repeat(np.cumsum(sizes) - sizes, n) + nth * CHAIN
    return first, np.minimum(CHAIN, sizes[row] - nth * CHAIN)


def forward_backward(e: np.ndarray, first: np.ndarray, size: np.ndarray, transitions: np.ndarray, start: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Posterior of each label for each word of all chains at once; and, for training, the expected transitions."""
    out = np.zeros_like(e)
    if not len(e):
        return out, np.zeros_like(transitions) if pairs else None
    p = np.exp(e - e.max(1, keepdims=True))
    t = np.exp(transitions)
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    alive = [int(np.searchsorted(-size, -k, "left")) for k in range(int(size[0]))]  # chains longer than k words
    alpha = np.empty_like(p)
    a = p[first] * np.exp(start)
    for k, n in enumerate(alive):
        if k:
            a = (a[:n] @ t) * p[first[:n] + k]
        a = a / a.sum(1, keepdims=True)
        alpha[first[:n] + k] = a
    expected = np.zeros_like(t) if pairs else None
    b = np.ones((alive[-1], e.shape[1]))
    for k in range(len(alive) - 1, -1, -1):
        n = alive[k]
        if n > len(b):
            b = np.concatenate([b, np.ones((n - len(b), e.shape[1]))])
        at = first[:n] + k
        g = alpha[at] * b
        out[at] = g / g.sum(1, keepdims=True)
        if k:
            pb = p[at] * b
            if pairs:
                joint = alpha[at - 1][:, :, None] * t * pb[:, None, :]
                expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            b = pb @ t.T
            b /= b.max(1, keepdims=True)
    return out, expected


def word_arrays(texts: pa.Array):
    """(first row, rows' numbers of words, bytes, starts, ends, hashes) for blocks of rows."""
    for at, _, data, offsets in text_blocks(texts, STEP_BYTES):
        data = lower_latin(data)
        starts, ends, rows = word_bounds(data, offsets, _SEPARATOR)
        yield at, np.diff(rows), data, starts, ends, word_hashes(data, starts, ends)


def fit(texts: list[str], langs: list[str], slots: int = 1 << 16, lexicon_words: int = 2000, sequences: int = 3000, rounds: int = 3, seed: int = 11) -> Model:
    """A model from labelled texts (a bounded sample).

    Training chains are code-switched: runs of 4 to 24 consecutive words of texts of random
    languages, joined, so that transitions between languages are learned along with staying.
    AdaGrad on the exact log-likelihood; its gradient is observed minus expected counts.
    """
    labels = sorted(set(langs))
    n_labels, rng = len(labels), np.random.default_rng(seed)
    if not labels:
        return Model([], np.zeros((1, 0)), np.zeros((0, 0)), np.zeros(0), np.zeros(0, np.uint64))
    words: list[list[tuple]] = [[] for _ in labels]  # per language: arrays of each text
    counts: dict[int, np.ndarray] = {}
    for text, lang in zip(texts, langs):
        for _, _, data, starts, ends, hashes in word_arrays(pa.array([text])):
            if len(starts):
                y = labels.index(lang)
                words[y].append((data, starts, ends, hashes))
                for h in np.unique(hashes).tolist():
                    counts.setdefault(h, np.zeros(n_labels))[y] += 1
    sure = sorted(counts, key=lambda h: (-(2 * counts[h].max() - counts[h].sum()), h))[:lexicon_words]
    lexicon = np.sort(np.array(sure, np.uint64))
    model = Model(labels, np.zeros((slots, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels), lexicon)
    have = [y for y in range(n_labels) if words[y]]
    if not have:
        return model
    made = []
    for _ in range(sequences):
        parts, truth = [], []
        for _ in range(rng.integers(1, 6)):
            y = have[rng.integers(len(have))]
            data, starts, ends, hashes = words[y][rng.integers(len(words[y]))]
            a = int(rng.integers(0, max(1, len(starts) - 4)))
            z = min(len(starts), a + int(rng.integers(4, 25)))
            s, n = features(data, starts[a:z], ends[a:z], hashes[a:z], lexicon, slots)
            parts.append((s, n))
            truth += [y] * (z - a)
        made.append((np.concatenate([s for s, _ in parts]), np.concatenate([n for _, n in parts]), np.array(truth)))
    g2 = [np.full_like(x, 1e-6) for x in (model.weights, model.transitions, model.start)]
    rate, eye = 0.5, np.eye(n_labels)
    for _ in range(rounds):
        order = rng.permutation(len(made))
        for at in range(0, len(order), 32):
            batch = [made[i] for i in order[at : at + 32]]
            slot, n, y = (np.concatenate([b[k] for b in batch]) for k in range(3))
            size = np.array([len(b[2]) for b in batch])
            first = np.cumsum(size) - size
            owner, scale = np.repeat(np.arange(len(n)), n), 1 / np.sqrt(np.maximum(n, 1))
            e = np.stack([np.bincount(owner, model.weights[slot, k], len(n)) for k in range(n_labels)], 1) * scale[:, None]
            post, expected = forward_backward(e, first, size, model.transitions, model.start, True)
            d = (eye[y] - post) * scale[:, None]
            inside = np.ones(len(y), bool)
            inside[first] = False
            seen = np.zeros_like(expected)
            np.add.at(seen, (y[np.flatnonzero(inside) - 1], y[inside]), 1)
            used, back = np.unique(slot, return_inverse=True)
            gw = np.stack([np.bincount(back, d[owner, k], len(used)) for k in range(n_labels)], 1) - 1e-4 * model.weights[used]
            g2[0][used] += gw * gw
            model.weights[used] += rate * gw / np.sqrt(g2[0][used])
            for x, g, acc in ((model.transitions, seen - expected, g2[1]), (model.start, (eye[y[first]] - post[first]).sum(0), g2[2])):
                acc += g * g
                x += 0.1 * g / np.sqrt(acc)
    return model


def sample(docs: DataFrame, per_label: int) -> DataFrame:
    """At most per_label labelled documents of each language, by the order of a hash of doc_id; of rows alike in doc_id,
    language and text one counts.

    The choice looks at ids, languages and hashes of texts only; Spark keeps per_label rows of a language in each
    task before it shuffles them, so a language that holds most rows is no burden.
    """
    rows = docs.where("lang is not null and text is not null and doc_id is not null")
    ids = rows.select("doc_id", "lang", F.xxhash64("text").alias("row_hash"), F.xxhash64("doc_id", F.lit("crf")).alias("h"))
    rank = F.dense_rank().over(Window.partitionBy("lang").orderBy("h", "doc_id", "row_hash"))
    picked = ids.withColumn("rank", rank).where(F.col("rank") <= per_label).select("doc_id", "lang", "row_hash").distinct()
    return rows.withColumn("row_hash", F.xxhash64("text")).join(F.broadcast(picked), ["doc_id", "lang", "row_hash"]).dropDuplicates(["doc_id", "lang", "row_hash"])


def train(docs: DataFrame, per_label: int = 300, longest: int = 20_000, **options) -> Model:
    """Fit on at most per_label documents of each language (per_label x languages rows meet in one task), and of a longer text on its
    first `longest` characters, so a language of long texts only is learned too. docs: the rows that may be learned from, with doc_id, text and lang.

    Only the model comes to the driver, so that neither the texts nor what fitting takes is added to its memory.
    """
    rows = sample(docs, per_label).select("doc_id", "lang", F.left("text", F.lit(longest)).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = sorted(r for b in batches for r in zip(b["doc_id"].tolist(), b["lang"], b["text"]))
        yield pd.DataFrame({"model": [pickle.dumps(tuple(fit([r[2] for r in found], [r[1] for r in found], **options)))]})

    made = rows.repartition(1).mapInPandas(run, "model binary").collect()
    return Model(*pickle.loads(bytes(made[0]["model"]))) if made else fit([], [], **options)


class Labels:
    """Emission scores of words already seen, in one worker."""

    def __init__(self, model: Model, memory: int = 60_000):
        self.model, self.memory = model, memory
        self.index: dict[int, int] = {}
        self.scores = np.zeros((1024, len(model.labels)), np.float32)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        codes, unique = pd.factorize(hashes)
        if len(self.index) + len(unique) > self.memory:
            self.index.clear()
        get, where, new = self.index.get, np.empty(len(unique), np.int64), []
        for i, h in enumerate(unique.tolist()):
            at = get(h, -1)
            if at < 0:
                self.index[h] = at = len(self.index)
                new.append(i)
            where[i] = at
        if new:
            while len(self.index) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            some = np.empty(len(unique), np.int64)
            some[codes[::-1]] = np.arange(len(codes))[::-1]
            pick = some[new]
            self.scores[where[new]] = emissions(self.model, data, starts[pick], ends[pick], hashes[pick])
        return self.scores[where[codes]] if len(codes) else np.zeros((0, self.scores.shape[1]), np.float32)


def predict(docs: DataFrame, model: Model, unknown: str = "und", keep: list[str] | None = None) -> DataFrame:
    """docs (or only its columns keep) with lang_pred, score, n_words and shares (label and share of the words' posterior, largest first).

    Every whole text is labelled word by word (chains of 256 words, all of them). lang_pred is the
    label with the largest mean posterior and score that mean; texts that are null or have no letter
    get `unknown` and 0. Rows are kept as they are, repeated ones too; result columns replace columns
    of the same names. Nothing is shuffled; the model (slots x labels numbers) travels with the tasks.
    """
    import pyspark.sql.types as T

    mine = {"lang_pred", "score", "n_words", "shares"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in mine]
    shares = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType()), T.StructField("shares", shares)])
    made: list[Labels] = []

    def run(b: pa.RecordBatch):
        if not made:
            made.append(Labels(model))
        texts = b.column(b.num_columns - 1)
        mean, n_words = np.zeros((b.num_rows, len(model.labels))), np.zeros(b.num_rows, np.int64)
        for at, sizes, data, starts, ends, hashes in word_arrays(texts) if model.labels else ():
            e = made[0].of(data, starts, ends, hashes).astype(np.float64)
            post, _ = forward_backward(e, *chains(sizes), model.transitions, model.start)
            row = np.repeat(np.arange(len(sizes)), sizes)
            for k in range(len(model.labels)):
                mean[at : at + len(sizes), k] = np.bincount(row, post[:, k], len(sizes))
            n_words[at : at + len(sizes)] = sizes
        mean /= np.maximum(n_words, 1)[:, None]
        known = np.array([n > 0 and t.is_valid and _LETTER.search(t.as_py()) is not None for n, t in zip(n_words, texts)]) if model.labels else np.zeros(b.num_rows, bool)
        best = mean.argmax(1) if model.labels else np.zeros(b.num_rows, np.int64)
        out = [[{"lang": model.labels[k], "share": float(m[k])} for k in np.argsort(-m, kind="stable")] if ok else [] for m, ok in zip(mean, known)]
        yield {c: b.column(i) for i, c in enumerate(keep)} | {
            "lang_pred": pa.array([model.labels[k] if ok else unknown for k, ok in zip(best, known)], pa.string()),
            "score": pa.array([min(1.0, max(0.0, float(mean[i, best[i]]))) if ok else 0.0 for i, ok in enumerate(known)], pa.float64()),
            "n_words": pa.array(n_words),
            "shares": pa.array(out, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
        }

    return map_batches(docs.select(*keep, F.col("text").cast("string").alias("graphmill_text")), run, schema)


def held_out(doc_id: F.Column) -> F.Column:
    """Documents that may not be learned from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))
