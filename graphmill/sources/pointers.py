"""What C sources say of function pointers: types, fields, tables, assignments and calls, a row each; what they mean is left to joins."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from graphmill.functions.lexer import code_only

SCHEMA = (
    "what string, file_path string, line int, scope string, owner string, field string, pos int, value string, form string, types array<string>, "
    "from_field string, from_types array<string>, chain array<string>"
)
# Words that stand where a type would, but are none.
KEYWORDS = frozenset("return if else for while do switch case goto sizeof const static struct union enum extern register volatile unsigned signed typedef".split())
_QUALIFIERS = r"(?:(?:static|const|extern|register|volatile)\s+)*"
_POINTER_TYPEDEF = re.compile(r"\btypedef\b[^;{}]*?\(\s*\*\s*(\w+)\s*\)\s*\(")
_FUNCTION_TYPEDEF = re.compile(r"\btypedef\b[^;{}()]*?\b(\w+)\s*\([^;{}]*\)\s*;")
_STRUCT = re.compile(r"\b(typedef\s+)?struct\s+(\w+)?\s*\{")
_TABLE = re.compile(rf"(?:^|[;{{}}])\s*{_QUALIFIERS}(?:struct\s+)?(\w+)\s+(\*\s*)?(\w+)\s*(\[[^\]]*\])?\s*=\s*\{{")
_FUNCTION = re.compile(r"(?:^|[;}])\s*(?:[\w*]+[\s*]+)+?\**(\w+)\s*\(([^;{}]*)\)\s*\{")
_DECLARED = re.compile(r"(?:struct\s+)?\b(\w+)(?:\s*\*+\s*|\s+)(\w+)\s*(?=[,)=;]|\[)")
_ASSIGN = re.compile(r"(\w+)\s*(?:->|\.)\s*(\w+)\s*=\s*&?\s*(\w+)\s*;")
_COPY = re.compile(r"(\w+)\s*(?:->|\.)\s*(\w+)\s*=\s*(\w+)\s*(?:->|\.)\s*(\w+)\s*;")
_CALL = re.compile(r"((?:\w+(?:\s*\[[^\][]*\])?\s*(?:->|\.)\s*)+)(\w+)\s*\)?\s*\(")
_ARRAY_CALL = re.compile(r"(?:\(\s*\*\s*)?(?<![\w.>])(\w+)\s*\[[^\][]*\]\s*\)?\s*\(")
_CLOSERS = {"{": "}", "(": ")", "[": "]"}


def _close(text: str, at: int) -> int:
    """Where the bracket at `at` is closed, or the end of the text."""
    depth, a, z = 0, text[at], _CLOSERS[text[at]]
    for m in re.compile(f"[{re.escape(a + z)}]").finditer(text, at):
        depth += 1 if m[0] == a else -1
        if not depth:
            return m.start()
    return len(text)


def _parts(text: str, separator: str) -> list[str]:
    """text split where no bracket is open."""
    out, depth, at = [], 0, 0
    for m in re.finditer(rf"[{{}}()\[\]{separator}]", text):
        if m[0] in "{([":
            depth += 1
        elif m[0] in "})]":
            depth -= 1
        elif not depth:
            out.append(text[at : m.start()])
            at = m.end()
    return [*out, text[at:]]


def _fields(body: str) -> Iterator[tuple]:
    """(name, place, type, whether it is a pointer by its own form) of a struct's fields. One that is not understood takes its place too."""
    place = 0
    for statement in _parts(body, ";"):
        if not statement.strip():
            continue
        shared = ""
        for i, part in enumerate(_parts(statement, ",")):
            pointer = re.search(r"\(\s*\*\s*(\w+)\s*\)\s*\(", part)
            if pointer:
                yield pointer[1], place, "", True
            elif i == 0 and (m := re.fullmatch(r"\s*(?:(?:const|volatile|unsigned|signed)\s+)*(?:struct\s+|union\s+|enum\s+)?(\w+)[\s*]+(?:const\s+)?(\w+)\s*(?:\[[^\]]*\]|:\s*\d+|\s)*", part)):
                shared = m[1]
                yield m[2], place, shared, False
            elif i and (m := re.match(r"[\s*]*(\w+)", part)):
                yield m[1], place, shared, False
            place += 1


def _entries(body: str) -> Iterator[tuple]:
    """(field or None, place or None, function) of a struct's value."""
    place = 0
    for item in filter(None, (x.strip() for x in _parts(body, ","))):
        if m := re.fullmatch(r"\.\s*(\w+)\s*=\s*(?:\([\w\s*]+\)\s*)?&?\s*(\w+)", item):
            yield m[1], None, m[2]
        elif not item.startswith("."):
            if m := re.fullmatch(r"&?\s*(\w+)", item):
                yield None, place, m[1]
            place += 1


def _values(body: str, is_array: bool) -> Iterator[str]:
    if not is_array:
        yield body
        return
    for item in (x.strip() for x in _parts(body, ",")):
        item = re.sub(r"^\[[^\]]*\]\s*=\s*", "", item)
        if item:
            yield item[1 : _close(item, 0)] if item.startswith("{") else item


def _elements(body: str) -> Iterator[str]:
    """Functions of an array of pointers: plain, by address, by index, or cast."""
    for item in _parts(body, ","):
        item = re.sub(r"^\s*\[[^\]]*\]\s*=", "", item).strip()
        item = re.sub(r"^\([\w\s*]+\)\s*", "", item).lstrip("& \n\t")
        if re.fullmatch(r"\w+", item):
            yield item


def facts_of(path: str, text: str) -> Iterator[dict]:
    code = code_only(text, "c")
    line = lambda at: code.count("\n", 0, at) + 1
    fact = lambda what, at, **k: {"what": what, "file_path": path, "line": line(at), **k}
    for m in _POINTER_TYPEDEF.finditer(code):
        yield fact("typedef", m.start(), owner=m[1], form="pointer")
    for m in _FUNCTION_TYPEDEF.finditer(code):
        yield fact("typedef", m.start(), owner=m[1], form="type")

    def table(type_: str, name: str, is_array: bool, open_: int) -> Iterator[dict]:
        body = code[open_ + 1 : _close(code, open_)]
        yield fact("variable", open_, owner=name, value=type_)
        for value in _values(body, is_array):
            for field, place, function in _entries(value):
                yield fact("entry", open_, owner=type_, field=field, pos=place, value=function)

    for m in _STRUCT.finditer(code):
        open_ = m.end() - 1
        close = _close(code, open_)
        after = re.compile(r"\s*(\w+)\s*(\[[^\]]*\])?\s*(=\s*\{)?").match(code, close + 1)
        names = {x for x in (m[2], after[1] if after and m[1] else None) if x}
        for name in sorted(names):
            for field, place, type_, pointer in _fields(code[open_ + 1 : close]):
                yield fact("field", m.start(), owner=name, field=field, pos=place, value=type_, form="pointer" if pointer else None)
        if after and m[2] and not m[1]:
            yield fact("variable", m.start(), owner=after[1], value=m[2])
            if after[3]:
                yield from table(m[2], after[1], after[2] is not None, after.end() - 1)
    for m in _TABLE.finditer(code):
        yield from table(m[1], m[3], m[4] is not None, m.end() - 1)
        if m[4]:
            for function in _elements(code[m.end() : _close(code, m.end() - 1)]):
                yield fact("element", m.start(), owner=m[3], value=function, types=[m[1]], form="star" if m[2] else "plain")
    for m in _FUNCTION.finditer(code):
        if m[1] in KEYWORDS:
            continue
        close = _close(code, m.end() - 1)
        yield fact("function", m.start(1), value=m[1], pos=line(close))
        begin, whole = m.start(2), code[m.start(2) : close]
        declared: dict[str, list[str]] = {}
        for d in _DECLARED.finditer(whole):
            if d[1] not in KEYWORDS:
                declared.setdefault(d[2], []).append(d[1])
        for x in _ASSIGN.finditer(whole):
            yield fact("assign", begin + x.start(), scope=m[1], types=declared.get(x[1], []), field=x[2], value=x[3])
        for x in _COPY.finditer(whole):
            yield fact("copy", begin + x.start(), scope=m[1], types=declared.get(x[1], []), field=x[2], from_types=declared.get(x[3], []), from_field=x[4])
        for x in _CALL.finditer(whole):
            chain = [s for s in re.split(r"\s*(?:->|\.)\s*", re.sub(r"\s*\[[^\]]*\]", "", x[1])) if s]
            yield fact("call", begin + x.start(), scope=m[1], owner=chain[0], chain=chain[1:], field=x[2], types=declared.get(chain[0], []), from_types=declared.get(chain[-1], []))
        for x in _ARRAY_CALL.finditer(whole):
            yield fact("array_call", begin + x.start(), scope=m[1], owner=x[1])


def facts(files: DataFrame) -> DataFrame:
    """The facts of each C file (path, text; null has none), from code outside comments and strings. One pass in batches, no shuffle.

    what: typedef (owner, form: pointer or type), field (owner, field, pos, value: its type), variable (owner, value: its type), entry of a table (owner: its type,
    field or pos, value), element of an array (owner, types, form, value), function (value, line, pos: last line), assign, copy, call, array_call (scope: the function).
    """

    kinds = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in SCHEMA.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [f for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist()) if text for f in facts_of(path, text)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "text").mapInArrow(run, SCHEMA)
