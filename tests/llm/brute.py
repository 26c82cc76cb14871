"""Plain Python versions of the contracts, for small inputs. Documents are (doc_id, text)."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def phrases(docs, window=50):
    first = {}
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out)


def near(docs, size=2, share=(80, 100)):
    sets = []
    for d, t in docs:
        w = WORD.findall((t or "").translate(UPPER))
        sets.append((d, {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            at[x].append(i)
    for i, (d, s) in enumerate(sets):
        both = defaultdict(int)
        for x in s:
            for j in at[x]:
                if j < i:
                    both[j] += 1
        for j, n in both.items():
            if share[1] * n >= share[0] * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((find(d), find(sets[j][0])))
                root[b] = a
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def leaks(docs, items, window=10):
    grams = defaultdict(set)
    for item, t in items:
        w = ALNUM.findall((t or "").translate(UPPER))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            grams[tuple(w[i : i + window])].add(item)
    sizes = {len(k) for k in grams}
    out = []
    for d, t in docs:
        w = ALNUM.findall((t or "").translate(UPPER))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in grams:
                    hit[i : i + n] = [True] * n
                    found |= grams[k]
        out.append((d, len(w), sum(hit), len(found), sha(",".join(sorted(map(str, found)))), any(hit)))
    return sorted(out)


def near_items(docs, items, window=10, least=0.8):
    """{(doc_id, item_id)} where that share of a window's words stands at their offsets from some place."""
    windows = []
    for item, t in items:
        w = ALNUM.findall((t or "").translate(UPPER))
        windows += [(item, w[i : i + window]) for i in range(max(1, len(w) - window + 1) if w else 0)]
    out = set()
    for d, t in docs:
        at = dict(enumerate(ALNUM.findall((t or "").translate(UPPER))))
        known = set(at.values())
        for item, w in windows:
            if sum(x in known for x in w) >= least * len(w) - 1e-9:
                if any(sum(at.get(s + i) == x for i, x in enumerate(w)) >= least * len(w) - 1e-9 for s in range(-len(w), len(at))):
                    out.add((d, item))
    return out


RULES = [
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]


def secrets(docs):
    out = []
    for d, t in docs:
        spans = []
        for k, (kind, rule, group, least) in enumerate(RULES):
            spans += [(m.start(), k, kind, m.end()) for m in rule.finditer(t or "") if len(m[group]) >= least]
        spans.sort()
        out.append((d, *(sum(s[2] == kind for s in spans) for kind in ("assign", "access", "hex")), sha(",".join(f"{k}:{a}:{z}" for a, _, k, z in spans))))
    return sorted(out)


def lines(docs, run=3, long_words=20):
    """(doc_id, text, lines, deleted) with each repeated run of lines, and each repeated long line, deleted."""
    blank = " \t\r\f\v"
    texts = {d: t.split("\n") for d, t in docs if t is not None}
    kept = {d: [(i, x.strip(blank)) for i, x in enumerate(ls) if x.strip(blank)] for d, ls in texts.items()}
    first, gone = {}, defaultdict(set)
    for d in sorted(kept):
        for n in range(len(kept[d]) - run + 1):
            key = tuple(x for _, x in kept[d][n : n + run])
            if key in first:
                gone[d] |= {i for i, _ in kept[d][n : n + run]}
            first.setdefault(key, (d, n))
        for i, x in kept[d]:
            if len(re.split(r"[ \t\r\f\v]+", x)) >= long_words:
                if (x,) in first:
                    gone[d].add(i)
                first.setdefault((x,), (d, i))
    return sorted((d, None if t is None else "\n".join(x for i, x in enumerate(texts[d]) if i not in gone[d]), len(kept.get(d, ())), len(gone[d])) for d, t in docs)
