"""Token ids of whole texts: runs of letters, digits and signs are looked up in a bounded memory of runs already seen."""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd

from graphmill.llm.common import LOWER, SPACE, byte_set, gather, word_hashes

_LETTER, _DIGIT, _SIGN, _OTHER, _BLANK = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[byte_set((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))] = _SIGN
_CLASS[byte_set((0x30, 0x39))] = _DIGIT
_CLASS[byte_set((0x41, 0x5A), (0x61, 0x7A))] = _LETTER
_CLASS[SPACE] = _BLANK
_APOSTROPHE = 0x27


def _byte_letters() -> dict[int, str]:
    """The printable characters that byte-level vocabularies use for bytes 0..255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class RunTokenizer:
    """Ids as Tokenizer.encode(text, add_special_tokens=False) gives them, a block of texts at a time.

    For lower-casing word-end vocabularies that drop white space and take runs of letters, single
    digits and runs of other signs apart: a text is cut only where such runs surely end (ASCII and
    Latin-1 letters, digits, white space, signs other than the apostrophe), so ids of the cuts joined
    are ids of the text. path: the tokenizer's JSON; memory: cuts remembered by each worker.
    """

    def __init__(self, path: str, memory: int = 100_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.memory = Tokenizer.from_file(path), memory
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.special = any(self.tokenizer.get_added_tokens_decoder())
        self._forget()

    def _forget(self) -> None:
        self.index: dict[int, int] = {}
        self.ids, self.ends = array("I"), array("q", [0])

    def _learn(self, run: bytes, plain: bool) -> None:
        self.ids.extend([t.id for t in self.tokenizer.model.tokenize(run.decode("latin-1").translate(self.letters))] if plain else self.tokenizer.encode(run.decode("utf-8", "replace"), add_special_tokens=False).ids)
        self.ends.append(len(self.ids))

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a block of common.text_blocks, and where each row's ids begin."""
        raw, data = data, LOWER[data]
        kind = _CLASS[data]
        if len(data) > 1:  # two-byte letters of Latin-1: lead 0xC3, but for the signs × and ÷
            lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
            kind[lead] = kind[lead + 1] = _LETTER
            data[lead[data[lead + 1] <= 0x9E] + 1] += 0x20
        first = kind != _BLANK
        last = first.copy()
        if len(data) > 1:
            a, b = kind[:-1], kind[1:]
            cut = (a == _BLANK) | (b == _BLANK) | (a == _DIGIT) | (b == _DIGIT)
            cut |= (a == _LETTER) & (b == _SIGN) & (data[1:] != _APOSTROPHE)
            cut |= (a == _SIGN) & (b == _LETTER) & (data[:-1] != _APOSTROPHE)
            if self.special:  # <|names|> of added tokens stay whole, with what touches them
                for at in np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)):
                    a, b = at, at
                    while a and kind[a - 1] != _BLANK:
                        a -= 1
                    while b + 1 < len(data) and kind[b + 1] != _BLANK:
                        b += 1
                    cut[a:b] = False
                    data[a : b + 1] = raw[a : b + 1]
                    kind[a : b + 1] = _OTHER
            rows = offsets[1:-1]
            cut[rows[(rows > 0) & (rows < len(data))] - 1] = True
            first[1:] &= cut
            last[:-1] &= cut
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        plain = np.ones(len(data) + 1, np.int64)
        np.cumsum(kind != _LETTER, out=plain[1:])
        plain[0] = 0
        plain = plain[ends] == plain[starts]
        codes, unique = pd.factorize(word_hashes(data, starts, ends))
        if len(self.index) + len(unique) > self.memory:
            self._forget()
        where = np.empty(len(unique), np.int64)
        get, new = self.index.get, []
        for i, h in enumerate(unique.tolist()):
            at = get(h, -1)
            if at < 0:
                new.append(i)
                self.index[h] = at = len(self.index)
            where[i] = at
        if new:
            sample = np.empty(len(unique), np.int64)
            sample[codes[::-1]] = np.arange(len(codes))[::-1]
            text = data.tobytes()
            for s, e, p in zip(starts[sample[new]].tolist(), ends[sample[new]].tolist(), plain[sample[new]].tolist()):
                self._learn(text[s:e], p)
        known, at = np.frombuffer(self.ids, np.uint32), np.frombuffer(self.ends, np.int64)
        mine = where[codes] if len(codes) else np.zeros(0, np.int64)
        sizes = at[mine + 1] - at[mine]
        out = known[gather(at[mine], sizes)]
        totals = np.zeros(len(mine) + 1, np.int64)
        np.cumsum(sizes, out=totals[1:])
        del known, at  # else the arrays could not grow
        return out, totals[np.searchsorted(starts, offsets)]


_loaded: dict[str, RunTokenizer] = {}


def tokenizer(path: str) -> RunTokenizer:
    """One for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = RunTokenizer(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
