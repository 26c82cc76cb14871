"""Operators 11 to 13 against plain versions of their contracts."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from graphmill.llm import prefixes, registry, runs, suffixes

RUNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
BYTES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
#: Columns that have names the operators use themselves.
CLASHING = ", row_hash int, n_words string, runs string, at string, name int, part int, digest int, n_bytes int, pos int, number int, gone int, spans int"
OTHERS = (7, "x", "y", "z", 1, 2, 3, 4, 5, 6, 7, 8)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def key(row):
    return tuple((x is None, x) for x in row)


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def plain_runs(words, min_length, min_periods):
    out, n = [], len(words)
    for p in range(1, n // min_periods + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            size = i - s + p
            smaller = any(words[s : s + size - q] == words[s + q : s + size] for q in range(1, p)) if size >= max(min_length, min_periods * p) else True
            if not smaller:
                out.append((s, size, p))
            i = max(i, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_run_rows(docs, planted=True):
    out = []
    for d, t in docs:
        words = (t or "").encode().split()
        n = len(words)
        if planted and d is not None and n and (h := zlib.crc32(str(d).encode())) % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        found = plain_runs(words, 24, 3)
        gone = {i for s, size, p in found for i in range(s + p, s + size)}
        best = min(found, key=lambda r: (-(r[1] / r[2]), r[0], r[2]), default=None)
        four = (*best, best[1] * 1000 // best[2]) if best else (None,) * 4
        out.append((d, len(found), *four, sha("".join(f"{s},{size},{p}\n" for s, size, p in found)), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))))
    return sorted(out, key=key)


RUN_EDGES = [
    (1, None), (2, ""), (3, " \t\n\v\f\r "), (4, "a " * 23), (5, "a " * 24), (6, "b " + "a " * 30 + "b"), (7, "x y z " * 8), (8, "x y z " * 8 + "x y"), (8, "x y z " * 8 + "x y"),
    (9, "p q " * 12 + "p r " * 12), (10, " ".join(f"w{i % 40}" for i in range(120))), (11, " ".join(f"w{i % 41}" for i in range(120))), (None, "n " * 50), (12, "é ß " * 20 + " x " * 9),
    (13, ("a " * 5 + "b ") * 9), (14, "m" * 200_000), (15, " ".join(f"t{i % 700}" for i in range(2_500))), (16, "Z " * 30 + "z " * 30), *((100 + i, " ".join(f"v{j % (5 + i)}" for j in range(60))) for i in range(40)),
]


def test_runs_of_the_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(registry.QUERIES["op11_word_runs"](spark, sf), RUNS) == plain_run_rows(docs)


def test_runs_of_edges(spark):
    df = spark.createDataFrame([(*r, *OTHERS) for r in RUN_EDGES], "doc_id long, text string" + CLASHING).repartition(3)
    assert rows(runs.digest(runs.find_runs(df, arrange=runs.planted_order)), RUNS) == plain_run_rows(RUN_EDGES)
    assert rows(runs.digest(runs.find_runs(df)), RUNS) == plain_run_rows(RUN_EDGES, planted=False)
    assert runs.find_runs(df.limit(0)).count() == 0


def test_the_strongest_run_is_compared_exactly(spark):
    docs = [(1, " ".join(["a"] * 24 + ["x"] + ["b", "c"] * 24)), (2, " ".join(["a", "b"] * 13 + ["y"] + ["c"] * 24 + ["z"] + ["d"] * 24))]
    got = {r["doc_id"]: r for r in runs.digest(runs.find_runs(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    assert (got[1]["start"], got[1]["length"], got[1]["period"], got[1]["exponent_milli"]) == (0, 24, 1, 24000)
    assert (got[2]["start"], got[2]["n_runs"]) == (27, 3)


@pytest.mark.parametrize("seed", range(4))
def test_lyndon_edges_and_runs_of_random_words(seed):
    rng = np.random.default_rng(seed)
    for _ in range(400):
        n = int(rng.integers(1, 50))
        x = rng.integers(0, rng.integers(1, 5), n).tolist()
        if rng.random() < 0.5:
            a, p = int(rng.integers(0, n)), int(rng.integers(1, n + 1))
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
        after, agree = runs.lyndon_edges(x)
        for i in range(n):
            j = next((j for j in range(i + 1, n) if x[j:] < x[i:]), n)
            k = next((k for k in range(n - j) if x[i + k] != x[j + k]), n - j)
            assert (after[i], agree[i] if j < n else 0) == (j, k)
        for least, periods in ((1, 2), (1, 3), (6, 3)):
            assert sorted(runs.maximal_runs(x, least, periods), key=lambda r: (r[0], r[2])) == plain_runs(x, least, periods)


class Counted(int):
    """A word that counts how often it is compared."""

    n = 0

    def __eq__(self, other):
        Counted.n += 1
        return int(self) == int(other)

    def __lt__(self, other):
        Counted.n += 1
        return int(self) < int(other)

    __hash__ = int.__hash__


@pytest.mark.parametrize("words", [[0] * 5000, [0] * 2500 + [1] + [0] * 2501 + [2], [i % 7 for i in range(5000)], [5000 - i for i in range(5000)]])
def test_words_are_compared_a_constant_number_of_times(words):
    Counted.n = 0
    runs.lyndon_edges([Counted(w) for w in words])
    assert Counted.n < 6 * len(words)


def plain_trie(turns):
    """turns: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, t, role, text in sorted(turns, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0)):
        if c is not None:
            own[c].append((role or "", text or ""))
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = own.get(base, [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out = []
    for node, cs in members.items():
        below = [k for k in members if k[: len(node)] == node]
        leaves = sum(not any(len(m) == len(k) + 1 and m[: len(k)] == k for m in below) for k in below)
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ends = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), sum(len(k) == len(node) + 1 for k in below), leaves, saved, sha(ends)))
    return sorted(out, key=key)


def trie_rows(df):
    return rows(prefixes.digest(prefixes.trie(*prefixes.rebuilt(prefixes.ordered_turns(df)))), TRIE)


TURNS = "conv_id long, turn long, role string, text string"


def test_trie_of_the_table(spark, sf):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows(registry.QUERIES["op12_conversation_trie"](spark, sf), TRIE) == plain_trie(turns)


def test_trie_of_long_alike_and_odd_conversations(spark):
    rng = np.random.default_rng(2)
    turns = []
    for c in [*range(24), 101, 203, 304, 9999999999, -3, -7]:
        n = int(rng.integers(1, 75)) if c % 3 == 0 else int(rng.integers(1, 12))
        same = rng.random() < 0.6
        turns += [(c, t, ("user", None)[t % 2], f"é{t % 5}" if same else ("x", "y", None, "")[int(rng.integers(0, 4))]) for t in range(n)]
    # A null turn comes first, equal turns that are alike, no conv_id, gaps.
    turns += [(3, None, "user", "first"), (7, 500, "user", "twice"), (7, 500, "user", "twice"), (None, 0, "user", "nobody"), (None, None, None, None), (9, 10**12, "user", "t" * 100_000), (500, None, None, None)]
    df = spark.createDataFrame([(*r, *OTHERS) for r in turns], TURNS + CLASHING).repartition(3)
    assert trie_rows(df) == plain_trie(turns)


def test_trie_of_nothing(spark):
    assert trie_rows(spark.createDataFrame([], TURNS)) == []
    assert trie_rows(spark.createDataFrame([(None, 1, "a", "b")], TURNS)) == []


def test_trie_of_a_hot_conversation_and_a_conversation_without_turns(spark):
    # 3 takes the first turns of 0, which is not there, and has no turns beyond those, so only the root has it.
    only = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0][:1]
    turns = [(c, t, "user", f"same {t}") for c in range(1000, 1300) for t in range(3)] + [(only[0], 0, "user", "gone")]
    assert trie_rows(spark.createDataFrame(turns, TURNS).repartition(3)) == plain_trie(turns)


def plain_bytes(docs, depth):
    first, out = set(), []
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - depth + 1):
            if b[i : i + depth] in first:
                gone[i : i + depth] = [True] * depth
            first.add(b[i : i + depth])
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out, key=key)


def random_docs():
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcdefgh éß"), 400))
    docs = []
    for d in range(60):
        a = int(rng.integers(0, 300))
        t = base[a : a + int(rng.integers(0, 200))]
        t += "".join(rng.choice(list("ab"), int(rng.integers(0, 60)))) if rng.random() < 0.5 else ""
        t += "a" * int(rng.integers(0, 300)) if rng.random() < 0.3 else ""
        docs.append((d, t + (base[: int(rng.integers(0, 150))] if rng.random() < 0.3 else "")))
    return [*docs, (1000, None), (1001, ""), (None, base[:180]), (1002, "x" * 99), (1003, "x" * 99), (1004, "y" * 101), (1005, base[50:] + base[:250])]


@pytest.mark.parametrize("depth, gram, strings", [(100, 32, 20_000), (100, 32, 2), (40, 16, 3), (12, 8, 2), (5, 3, 1)])
def test_suffixes_of_random_texts(spark, depth, gram, strings):
    """Small tasks make every bucket one that must be split, down to one window a string."""
    docs = random_docs()
    df = spark.createDataFrame([(*r, *OTHERS) for r in docs], "doc_id long, text string" + CLASHING).repartition(3)
    assert rows(suffixes.digest(suffixes.dedup_bytes(df, depth, gram, strings)), BYTES) == plain_bytes(docs, depth)


def test_suffixes_of_the_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(registry.QUERIES["op13_suffix_dedup"](spark, sf), BYTES) == plain_bytes(docs, 100)


def test_suffixes_of_repeated_rows_very_long_texts_and_nothing(spark):
    long = "".join(f"{i * i % 9973:05d}" for i in range(260_000))
    docs = [(1, long), (2, "k" * 3 + long[500_000:500_400]), (3, "short"), (3, "short")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    assert rows(suffixes.digest(suffixes.dedup_bytes(df)), BYTES) == plain_bytes(docs, 100)
    # Rows alike in id and text are one place: neither is emptied. Different texts of one id go by their hashes.
    same = spark.createDataFrame([(5, long[:300]), (5, long[:300])], "doc_id long, text string")
    assert [r["n_removed"] for r in suffixes.digest(suffixes.dedup_bytes(same)).collect()] == [0, 0]
    two = spark.createDataFrame([(5, long[:300]), (5, long[:300] + "!")], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in suffixes.digest(suffixes.dedup_bytes(two)).collect()) in ([0, 300],)
    assert suffixes.dedup_bytes(df.limit(0)).count() == 0


def test_buckets_of_the_sort_are_in_order_and_to_the_depth():
    rng = np.random.default_rng(1)
    for depth in (1, 3, 8, 13, 20, 33):
        data = rng.integers(97, 99, 300).astype(np.uint8)
        sizes = [100, 0, 150, 50]
        ends = np.repeat(np.cumsum(sizes), sizes)
        got, raw = suffixes.refine(data, ends, depth), data.tobytes()
        text = {i: raw[i : i + depth] for i in range(300) if i + depth <= ends[i]}
        shared = [i for i in text if sum(text[i] == x for x in text.values()) > 1]
        assert [i for i in range(300) if got[i] >= 0] == shared
        assert all((got[i] < got[j]) == (text[i] < text[j]) for i in shared for j in shared)
