"""Where calls leave what can be followed in the text: computed members, reflection, buses, dynamic imports."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.lexer import code_only
from graphmill.operators.intervals import enclosing

_SCRIPT = ("typescript", "javascript", "tsx", "jsx", "vue", "svelte", "astro")
#: How much of the line after a match may hold its key.
_WINDOW = 80
#: Characters of the arguments of getattr, and of a line that is shown.
_ARGUMENTS, _SHOWN = 300, 120

# Fixed values, in their order: form, label, languages (none: all), pattern on code, pattern of the key on the text (the one literal of what is
# matched where it is `literal`), and whether the key may follow within the window.
FORMS = [
    ("computed-call", "computed member call", None, r"[\w$)\]]\s*\[([^[\]\n]{1,80})\]\s*\(", "index", False),
    ("dynamic-import", "dynamic import", _SCRIPT, r"\b(?:import|require)\s*\(\s*(?![\s'\"`)])", None, False),
    ("dynamic-import", "dynamic import", ("python",), r"\bimportlib\.import_module\s*\(|\b__import__\s*\(", None, False),
    ("ruby-send", "send dispatch", ("ruby",), r"\.(?:public_)?send\s*\(\s*:?\w+|\bmethod\s*\(\s*:\w+\s*\)", r":(\w+)", False),
    ("php-dynamic", "dynamic call", ("php",), r"\bcall_user_func(?:_array)?\s*\(|\$this\s*->\s*\$\w+\s*\(|\$\w+\s*\(", "literal", True),
    ("reflection", "reflective dispatch", ("java", "kotlin", "scala", "csharp", "go"), r"\.invoke\s*\(|\.get(?:Declared)?Method\s*\(|\.GetMethod\s*\(|MethodByName\s*\(|Activator\.CreateInstance|Class\.forName\s*\(", "literal", True),
    ("proxy-reflect", "Proxy/Reflect dispatch", _SCRIPT, r"\bnew\s+Proxy\s*\(|\bReflect\.(?:get|apply|construct)\s*\(", None, False),
    ("typed-bus", "typed message dispatch", None, r"\.(?:[Ss]end|[Pp]ublish|[Dd]ispatch|[Ee]xecute|[Pp]ost|[Ee]mit)(?:Async)?\s*(?:<[^<>\n]{0,80}>)?\s*\(\s*new\s+([A-Z]\w*)", r"new\s+([A-Z]\w*)$", False),
    ("var-key-dispatch", "string-keyed dispatch (runtime key)", None, r"\.(?:emit|dispatch|trigger|fire|publish|broadcast)\s*\(\s*[A-Za-z_$][\w$]*(?:\.[\w$]+){0,3}\s*[,)]", None, False),
    ("selector", "selector dispatch", ("swift", "objc", "objcpp", "objective-c"), r"#selector\s*\(\s*([\w.]+)|NSClassFromString\s*\(", r"#selector\s*\(\s*(?:\w+\.)*(\w+)", False),
]
_LITERAL = re.compile(r"[^'\"`]*(['\"`])([\w.:-]{2,64})\1[^'\"`]*")
_INDEX = re.compile(r"\[([^[\]\n]{1,80})\]\s*\($")


def _literal(text: str) -> str | None:
    """The one quoted literal of text."""
    m = _LITERAL.fullmatch(text)
    return m and m[2]


def _closing(code: str, at: int) -> int:
    """Where the bracket at `at` is closed, near by; -1 if it isn't."""
    depth = 0
    for i in range(at, min(len(code), at + _ARGUMENTS)):
        depth += (code[i] == "(") - (code[i] == ")")
        if not depth:
            return i
    return -1


def sites_of(text: str, language: str) -> Iterator[tuple]:
    """(rank of the form, form, label, offset, key, key_is_type, offset of a later call that is needed or None) of each site in a text."""
    code = code_only(text, language)
    if language == "python":
        for m in re.finditer(r"\bgetattr\s*\(", code):
            close = _closing(code, m.end() - 1)
            if close < 0:
                continue
            key = _literal(text[m.end() : close])
            if re.match(r"\s*\(", code[close + 1 : close + 8]):
                yield 0, "getattr-call", "getattr dispatch", m.start(), key, False, None
            elif given := re.search(r"(\w+)\s*=\s*$", code[code.rfind("\n", 0, m.start()) + 1 : m.start()]):
                if call := re.compile(rf"\b{given[1]}\s*\(").search(code, close + 1):
                    yield 0, "getattr-assign", "getattr dispatch (assigned, called later)", m.start(), key, False, call.start()
    for rank, (form, label, languages, pattern, key_of, follows) in enumerate(FORMS, 1):
        if languages and language not in languages:
            continue
        for m in re.finditer(pattern, code):
            end = m.end()
            if follows:
                line = text.find("\n", end)
                end = min(len(text), end + _WINDOW, line if line >= 0 else len(text))
            part, key = text[m.start() : end], None
            if key_of == "literal":
                key = _literal(part)
            elif key_of == "index":
                key = _literal(inner[1]) if (inner := _INDEX.search(part)) else None
            elif key_of:
                key = found[1] if (found := re.search(key_of, part)) else None
            yield rank, form, label, m.start(), key, bool(key) and form == "typed-bus", None


def _shown(text: str, at: int) -> str:
    end = text.find("\n", at)
    line = text[text.rfind("\n", 0, at) + 1 : end if end >= 0 else None].strip()
    return line if len(line) <= _SHOWN else line[: _SHOWN - 3] + "..."


def sites(files: DataFrame) -> DataFrame:
    """file_path, at, rank, form, label, key, key_is_type, line, needs_line, snippet of every dynamic call in whole files, outside comments and strings.
    files: path, text, language; a null text has none. One pass in batches, no shuffle."""
    schema = "file_path string, at int, rank int, form string, label string, key string, key_is_type boolean, line int, needs_line int, snippet string"
    columns = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text, language in zip(b["path"], b["text"], b["language"]):
                line = lambda at: text.count("\n", 0, at) + 1  # noqa: B023, E731
                for rank, form, label, at, key, is_type, needs in sites_of(text, language) if text else ():
                    rows.append((path, at, rank, form, label, key, is_type, line(at), None if needs is None else line(needs), _shown(text, at)))
            yield pd.DataFrame(rows, columns=columns).astype({"needs_line": "Int32"})

    return files.select("path", "text", "language").mapInPandas(run, schema)


def boundaries(files: DataFrame, scopes: DataFrame, most: int | None = 3) -> DataFrame:
    """scope, form, label, key, key_is_type, file_path, line, snippet, more_sites: the first sites of each function, one for each form and key.

    scopes: scope, file_path, start, end (lines). A site belongs to the tightest scope around it; sites of one form and key count as one, with how
    many more there are. Forms go in their fixed order, sites of one form in the text's order; at most `most` a scope (None: all). A name that getattr
    was assigned to must be called within the same scope.
    """
    found = sites(files).withColumn("id", F.concat_ws(":", "file_path", "rank", "at"))
    held = enclosing(found, scopes.select("scope", "file_path", "start", "end"), "file_path", "line").where("scope is not null")
    ends = scopes.select("scope", F.col("end").alias("_end"))
    held = held.join(ends, "scope").where("needs_line is null or needs_line <= _end")
    first = F.min(F.struct("rank", "at", "label", "line", "snippet", "key_is_type", "file_path")).alias("first")
    one = held.groupBy("scope", "form", "key").agg(first, (F.count("*") - 1).alias("more_sites")).select("scope", "form", "key", "first.*", "more_sites")
    if most is not None:
        one = one.withColumn("_nth", F.row_number().over(Window.partitionBy("scope").orderBy("rank", "at"))).where(F.col("_nth") <= most)
    return one.select("scope", "form", "label", "key", "key_is_type", "file_path", "line", "snippet", "more_sites")


def candidates(found: DataFrame, nodes: DataFrame, most: int = 4) -> DataFrame:
    """scope, form, key, target: callable symbols that a visible key may stand for: of its name, of its name after `on` or `handle`, or (for a type) its handler;
    at most `most` of each, exact names first."""
    name = F.lower("name")
    keyed = found.where("key is not null").select("scope", "form", "key", "key_is_type").distinct()
    last = F.lower(F.element_at(F.split("key", r"[.:]"), -1))
    wanted = F.when(F.col("key_is_type"), F.array(F.concat(last, F.lit("handler")), last)).otherwise(F.array(last, *(F.concat(F.lit(p), last) for p in ("on", "on_", "handle", "handle_"))))
    wants = keyed.select("*", F.posexplode(wanted).alias("_rank", "_name"))
    met = wants.join(nodes.where(F.col("kind").isin("function", "method", "class")).select(F.col("id").alias("target"), name.alias("_name")), "_name")
    nth = F.row_number().over(Window.partitionBy("scope", "form", "key").orderBy("_rank", "target"))
    return met.withColumn("_nth", nth).where(F.col("_nth") <= most).select("scope", "form", "key", "target")
