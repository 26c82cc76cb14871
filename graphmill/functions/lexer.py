"""Blanking comments and strings of source texts, so that patterns see code only; every offset and line stays where it is."""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What a scanner may meet in code, tried in order at each place: (state, pattern). `comment` and `doc` are blanked, `string` is passed over
# (its inside is blanked on request), `nested` is a comment that may hold others.
_LINE, _HASH, _BLOCK = ("comment", r"//[^\n]*"), ("comment", r"#[^\n]*"), ("comment", r"/\*(?:[\s\S]*?\*/|[\s\S]*)")
#: A quoted string that ends at its quote or, unterminated, before the end of the line.
_ESCAPE = r"\\(?:[\s\S]|\Z)"
_quoted = lambda q: ("string", rf"{q}(?:{_ESCAPE}|[^{q}\\\n])*(?:{q}|(?=\n)|\Z)")
#: One that may span lines; and one without escapes.
_spanning = lambda q: ("string", rf"{q}(?:{_ESCAPE}|[^{q}\\])*(?:{q}|\Z)")
_raw = lambda q: ("string", rf"{q}[^{q}]*(?:{q}|\Z)")
_triple = lambda q: ("doc", rf"{q * 3}(?:{_ESCAPE}|(?!{q * 3})[\s\S])*(?:{q * 3}|\Z)")
_C = (_BLOCK, _LINE, _quoted('"'), _spanning("`"))
STATES = {
    "python": (_triple('"'), _triple("'"), _quoted('"'), _quoted("'"), _HASH),
    "ruby": (("comment", r"(?m:^[ \t]*=begin)(?:[\s\S]*?\n[ \t]*=end[^\n]*|[\s\S]*)"), _quoted('"'), _quoted("'"), _HASH),
    "rust": (("nested", r"/\*"), _LINE, _spanning('"'), _quoted("'")),
    "php": (_BLOCK, _LINE, _HASH, _quoted('"'), _quoted("'"), _quoted("`")),
    "go": (_BLOCK, _LINE, _raw("`"), _quoted('"'), _quoted("'")),
    "javascript": (_BLOCK, _LINE, _quoted('"'), _quoted("'"), _spanning("`")),
    "java": _C,
}
# Languages whose comments and strings are those of another.
for _like, _others in (("javascript", "jsx typescript tsx vue svelte astro"), ("java", "kotlin scala dart csharp swift c cpp objc objcpp")):
    STATES |= dict.fromkeys(_others.split(), STATES[_like])


@cache
def _scanner(language: str) -> re.Pattern:
    return re.compile("|".join(f"(?P<{state}_{i}>{pattern})" for i, (state, pattern) in enumerate(STATES[language])))


_NOT_BREAK = re.compile(r"[^\n]")
_NEST = re.compile(r"/\*|\*/")
_STRING = re.compile("|".join(pattern for _, pattern in (_quoted('"'), _quoted("'"), _spanning("`"))))


def without_comments(text: str, language: str) -> str:
    """text with the comments (and Python's triple-quoted strings) turned into blanks; line breaks stay. Unknown languages stay as they are."""
    if language not in STATES:
        return text
    scanner, out, done, at = _scanner(language), [], 0, 0
    while m := scanner.search(text, at):
        state, at = m.lastgroup.split("_")[0], max(m.end(), m.start() + 1)
        if state == "nested":
            depth = 1
            while depth:
                step = _NEST.search(text, at)
                at = step.end() if step else len(text)
                depth = depth + (1 if step[0] == "/*" else -1) if step else 0
        if state != "string":
            out += [text[done : m.start()], _NOT_BREAK.sub(" ", text[m.start() : at])]
            done = at
    return "".join([*out, text[done:]])


def without_strings(text: str) -> str:
    """text with what stands between quotes turned into blanks; the quotes stay. To be used on what without_comments gives."""
    def inside(m: re.Match) -> str:
        closed = len(m[0]) > 1 and m[0][-1] == m[0][0]
        return m[0][0] + _NOT_BREAK.sub(" ", m[0][1 : -1 if closed else None]) + (m[0][0] if closed else "")

    return _STRING.sub(inside, text)


def code_only(text: str, language: str) -> str:
    return without_strings(without_comments(text, language))


def blanked(text: Column, language: Column, strings: bool = False) -> Column:
    """The column text without comments, and without the insides of strings too; null stays null. In Arrow batches; no shuffle."""
    blank = code_only if strings else without_comments

    def run(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else blank(t, x) for t, x in zip(texts, languages)], dtype=object)

    return F.pandas_udf(run, "string")(text, language)
