"""Secret scans: all rules in one deterministic automaton, one step a byte."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import map_batches


class Rule(NamedTuple):
    """A kind of secret. Its matches end where a run of characters ends; group: the part of at least `least` characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    #: Pattern of the automaton, where it is narrower: it may leave out only matches that `least` drops.
    narrow: str | None = None


# The three base rules, and formats that issuers of credentials publish.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16, narrow=r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)
RULES = BASE_RULES + MORE_RULES


class Positions:
    """The positions of a regular expression: their byte sets, which come first, last and after which.

    Syntax: literals, \\x.. and \\. escapes, [classes], (groups), (?i:groups), |, and ? * + {m} {m,} {m,n}.
    backward: the positions of the reversed words.
    """

    def __init__(self, pattern: str, backward: bool = False):
        self.text, self.at, self.backward = pattern, 0, backward
        self.sets: list[int] = []
        self.after: list[set[int]] = []
        self.nullable, self.first, self.last = self._union(False)
        if self.at < len(pattern):
            raise ValueError(f"{pattern!r}: unexpected {pattern[self.at]!r}")

    def _take(self, s: str) -> bool:
        if self.text.startswith(s, self.at):
            self.at += len(s)
            return True
        return False

    def _union(self, fold: bool) -> tuple[bool, set[int], set[int]]:
        null, first, last = self._sequence(fold)
        while self._take("|"):
            n, f, l = self._sequence(fold)
            null, first, last = null or n, first | f, last | l
        return null, first, last

    def _join(self, a: tuple, b: tuple) -> tuple:
        a, b = (b, a) if self.backward else (a, b)
        for p in a[2]:
            self.after[p] |= b[1]
        return a[0] and b[0], a[1] | b[1] if a[0] else a[1], a[2] | b[2] if b[0] else b[2]

    def _sequence(self, fold: bool) -> tuple:
        out: tuple = (True, set(), set())
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            out = self._join(out, self._repeat(fold))
        return out

    def _repeat(self, fold: bool) -> tuple:
        began = self.at
        self._atom(fold, dry := Positions.__new__(Positions), began)
        if self._take("?"):
            least, most = 0, 1
        elif self._take("*"):
            least, most = 0, None
        elif self._take("+"):
            least, most = 1, None
        elif m := re.compile(r"\{(\d+)(,?)(\d*)\}").match(self.text, self.at):
            self.at = m.end()
            least, most = int(m[1]), int(m[3]) if m[3] else None if m[2] else int(m[1])
        else:
            least, most = 1, 1
        ended, out = self.at, (True, set(), set())
        for i in range(max(least, 1) if most is None else most):
            part = self._atom(fold, self, began)
            if most is None and i == max(least, 1) - 1:
                for p in part[2]:
                    self.after[p] |= part[1]
            out = self._join(out, (True, part[1], part[2]) if i >= least else part)
        self.at = ended
        return out

    def _atom(self, fold: bool, into: Positions, began: int) -> tuple:
        """Parse what begins there; its positions go into `into` (a throw-away for a look ahead)."""
        if into is not self:
            into.text, into.backward, into.sets, into.after = self.text, self.backward, [], []
        into.at = began
        try:
            return into._one(fold)
        finally:
            self.at = into.at

    def _one(self, fold: bool) -> tuple:
        if self._take("(?i:"):
            out = self._union(True)
        elif self._take("(?:") or self._take("("):
            out = self._union(fold)
        else:
            members = self._class() if self._take("[") else {self._char()}
            if fold:
                members |= {c ^ 32 for c in members if chr(c).isalpha()}
            self.sets.append(sum(1 << c for c in members))
            self.after.append(set())
            p = {len(self.sets) - 1}
            return False, p, set(p)
        if not self._take(")"):
            raise ValueError(f"{self.text!r}: no end of a group")
        return out

    def _char(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c == "\\":
            c = self.text[self.at]
            self.at += 1
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def _class(self) -> set[int]:
        out: set[int] = set()
        while not self._take("]"):
            a = self._char()
            if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                out |= set(range(a, self._char() + 1))
            else:
                out.add(a)
        return out


class Automaton(NamedTuple):
    """table[state, byte]: the next state; accepts[state]: bits of the rules whose matches may end there. State 0 begins."""

    table: np.ndarray
    accepts: np.ndarray


def compile_rules(patterns: list[str], anywhere: bool, backward: bool = False) -> Automaton:
    """Subset construction over all patterns at once, then minimisation. anywhere: a match may begin at every byte."""
    sets, after, first, ends = [], [], set(), []
    for bit, pattern in enumerate(patterns):
        part, base = Positions(pattern, backward), len(sets)
        sets += part.sets
        after += [{q + base for q in a} for a in part.after]
        first |= {p + base for p in part.first}
        ends += [(1 << bit) if p in part.last else 0 for p in range(len(part.sets))]
    kinds: dict[tuple, int] = {}
    byte_kind = [kinds.setdefault(tuple(s >> b & 1 for s in sets), len(kinds)) for b in range(256)]
    of_kind = [{p for p, has in enumerate(k) if has} for k in kinds]
    begin = frozenset() if anywhere else frozenset([-1])  # the empty set is dead where a match begins once only
    states: dict[frozenset, int] = {begin: 0}
    todo, rows = [begin], []
    for state in todo:
        ahead = set().union(*(after[p] for p in state if p >= 0)) | (first if anywhere or -1 in state else set())
        row = []
        for members in of_kind:
            to = frozenset(ahead & members)
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            row.append(states[to])
        rows.append(row)
    table = np.array(rows)
    accepts = np.array([int(np.bitwise_or.reduce([0, *(ends[p] for p in s if p >= 0)])) for s in todo])
    label = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([label, label[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == label.max():
            break
        label = finer
    order = np.full(label.max() + 1, -1)
    order[label[0]] = 0
    for x in label:
        if order[x] < 0:
            order[x] = order.max() + 1
    label = order[label]
    small = np.zeros((label.max() + 1, table.shape[1]), np.uint16)
    small[label] = label[table]
    accept = np.zeros(label.max() + 1, np.int64)
    accept[label] = accepts
    return Automaton(small[:, byte_kind], accept)


class Scanner:
    """Spans of all rules in a text. Build it once in each worker."""

    def __init__(self, rules: tuple[Rule, ...], forward: Automaton, backward: list[Automaton]):
        self.rules = rules
        self.regexes = [re.compile(r.pattern.encode()) for r in rules]
        self.start = self._rows(forward)
        self.back = [self._rows(a) for a in backward]

    @staticmethod
    def _rows(a: Automaton) -> list:
        """Rows that hold their next rows; item 256 is the accept mask, item 257 tells that no way leads on."""
        rows = [[*r] for r in a.table.tolist()]
        dead = [all(x == i for x in r) and not a.accepts[i] for i, r in enumerate(rows)]
        for i, r in enumerate(rows):
            r[:] = [rows[x] for x in r]
            r += [int(a.accepts[i]), dead[i]]
        return rows[0]

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(end, rule) of every run of bytes after which a match of the rule may end; one pass over the bytes."""
        out, row, n, it = [], self.start, len(data), iter(data)
        last = [-1] * len(self.rules)
        for b in it:
            row = row[b]
            if row[256]:
                mask, at, r = row[256], n - it.__length_hint__(), 0
                while mask:
                    if mask & 1:
                        if last[r] >= 0 and last[r] != at - 1:
                            out.append((last[r], r))
                        last[r] = at
                    mask >>= 1
                    r += 1
        out += [(at, r) for r, at in enumerate(last) if at >= 0]
        return sorted(out)

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes: leftmost, not overlapping within a rule, without those that are too short."""
        out, free = [], [0] * len(self.rules)
        for end, r in self.ends(data):
            row, at, start = self.back[r], end, -1
            while at > free[r]:
                at -= 1
                row = row[data[at]]
                if row[256]:
                    start = at
                if row[257]:
                    break
            if start >= 0:
                free[r] = end
                m, rule = self.regexes[r].fullmatch(data, start, end), self.rules[r]
                if m and m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out.append((start, end, r))
        return sorted(out)


def build(rules: tuple[Rule, ...] = RULES) -> tuple:
    """What a Scanner is made from; small enough to travel with the tasks."""
    return rules, compile_rules([r.narrow or r.pattern for r in rules], True), [compile_rules([r.pattern], False, True) for r in rules]


_scanners: dict[tuple, Scanner] = {}


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (array of kind, start, end in code points, end exclusive) of every document, in start and rule order.

    A null text is empty; repeated rows are scanned once each; a null doc_id stays null; other columns
    are left out. Texts are read once and never shuffled; time is linear in their bytes.
    """
    made = build(rules)

    def run(b: pa.RecordBatch):
        if rules not in _scanners:
            _scanners[rules] = Scanner(*made)
        scanner = _scanners[rules]
        found = []
        for text in b.column(1):
            data = text.as_buffer()
            data = data.to_pybytes() if data is not None else b""
            spans = scanner.spans(data)
            if spans and not data.isascii():
                places = sorted({x for s in spans for x in s[:2]})
                points, before, n = {}, 0, 0
                for p in places:
                    n += len(data[before:p].decode())
                    points[p], before = n, p
                spans = [(points[a], points[z], r) for a, z, r in spans]
            found.append([{"kind": rules[r].kind, "start": a, "end": z} for a, z, r in spans])
        yield {"doc_id": b.column(0), "spans": pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))}

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, and base and all spans as text."""
    base = [r.kind for r in BASE_RULES]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *(of(k).alias(f"n_{k}") for k in base),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
