"""Web frameworks as plug-ins: each tells whether a project uses it, gives routes and what handles them, claims references and resolves its own."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.lexer import code_only, without_comments
from graphmill.operators.resolve import top_per_group
from graphmill.store import settled

#: Of a route: file_path, language, line, verb (null: none), url, ref_name (null: no handler), ref_kind.
ROUTE = "file_path string, language string, line int, verb string, url string, ref_name string, ref_kind string"


class Framework(NamedTuple):
    """A plug-in; every part is a stage over DataFrames.

    used: whether a file (path, text) shows that the project uses it. routes: files (path, text, language) and their nodes to rows of ROUTE. claims: names that it
    resolves though no node is so named. resolve: refs and nodes to ref_id, target, confidence. finish: all routes and all files to the same
    routes, where one file says what holds in another; their number and places must stay.
    """

    name: str
    languages: tuple[str, ...]
    used: Callable[[Column, Column], Column]
    routes: Callable[[DataFrame, DataFrame], DataFrame]
    claims: Callable[[Column], Column] = lambda name: F.lit(False)
    resolve: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    finish: Callable[[DataFrame, DataFrame], DataFrame] | None = None


def calls_in(files: DataFrame, pattern: str) -> DataFrame:
    """file_path, language, line, what, args: where a pattern (what: its group 1) stands outside comments, and, if it ends with a bracket, what it holds up to
    the bracket that closes it. files: path, text, language; null texts have none. One pass, no shuffle."""

    def found(text: str, language: str) -> Iterator[tuple]:
        clean = without_comments(text, language)
        closes, bare = {}, None
        for m in re.finditer(pattern, clean):
            if bare is None:  # the insides of strings hold no brackets; offsets stay
                bare, open_ = code_only(text, language), []
                for b in re.finditer(r"[()]", bare):
                    if b[0] == "(":
                        open_.append(b.start())
                    elif open_:
                        closes[open_.pop()] = b.start()
            at = m.end() - 1
            if bare[m.start()] == clean[m.start()]:
                yield clean.count("\n", 0, m.start()) + 1, m[1] if m.re.groups else None, clean[m.end() : closes[at]] if at in closes else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, x, *r) for p, t, x in zip(b["path"], b["text"], b["language"]) if t is not None for r in found(t, x)]
            yield pd.DataFrame(rows, columns=["file_path", "language", "line", "what", "args"]).astype({"line": "int32"})

    return files.select("path", "text", "language").mapInPandas(run, "file_path string, language string, line int, what string, args string")


def _rows(found: DataFrame, verb: Column, url: Column, ref_name: Column, ref_kind: Column) -> DataFrame:
    return found.select("file_path", "language", "line", verb.cast("string").alias("verb"), url.alias("url"), F.nullif(ref_name, F.lit("")).alias("ref_name"), ref_kind.alias("ref_kind"))


def _part(args: str, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.regexp_extract(args, pattern, group), F.lit(""))


# ---- scripts -------------------------------------------------------------------------------------

# Calls within a handler that are the framework's or the language's.
RESERVED = (
    "json", "jsonp", "send", "sendStatus", "sendFile", "status", "end", "redirect", "render", "set", "get", "header", "type", "format", "attachment", "download", "cookie", "clearCookie", "append", "location", "vary", "links", "accepts", "is",
    "next", "then", "catch", "finally", "resolve", "reject", "all", "race", "map", "filter", "forEach", "reduce", "find", "push", "pop", "slice", "splice", "includes", "keys", "values", "entries", "assign", "parse", "stringify",
    "log", "error", "warn", "info", "String", "Number", "Boolean", "Array", "Object", "Date", "Math", "JSON", "Promise", "require", "fail",
)


def _script_routes(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """app or router, a verb and a path: handled by the last argument, or by what an arrow function there calls, each name once."""
    found = calls_in(files, r"\b(?:app|router)\.(get|post|put|patch|delete|all|use)\s*\(")
    found = found.withColumn("url", _part("args", r"""^\s*['"]([^'"]+)['"]\s*,""")).where("url != '' and (what != 'use' or url like '/%')")
    after = _part("args", r"(?s)=>(.*)$")
    called = F.filter(F.array_distinct(F.regexp_extract_all(after, F.lit(r"\b([A-Za-z_$][\w$]*)\s*\("), 1)), lambda x: ~x.isin(*RESERVED, "if", "for", "while", "switch", "function"))
    arrow = F.contains("args", F.lit("=>"))
    last = _part("args", r"(?s)(?:^|[.,\s])([A-Za-z_]\w*)\s*(?:\(\s*\))?[\s,]*$")
    # Both forms in one go: a union of them would read and parse the files twice.
    handlers = F.when(~arrow, F.array(last)).when(F.size(called) > 0, called).otherwise(F.array(F.lit("")))
    found = found.withColumn("_handler", F.explode(handlers))
    return _rows(found, F.upper("what"), F.col("url"), F.col("_handler"), F.when(arrow, "calls").otherwise("references"))


def _script_targets(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """`UserController.show`: a function of that name in a file whose path names the controller, else in the file of its class."""
    asked = refs.withColumn("_owner", F.regexp_extract("ref_name", r"^(\w+)Controller\.(\w+)$", 1)).withColumn("name", F.regexp_extract("ref_name", r"^(\w+)Controller\.(\w+)$", 2)).where("name != ''").select("ref_id", "_owner", "name")
    able = nodes.where("kind in ('method', 'function')").select("name", "id", "file_path", "start_line")
    here = nodes.select(F.col("name").alias("_class"), "file_path", F.lit(True).alias("_declared")).distinct()
    met = asked.join(able, "name").withColumn("_class", F.concat("_owner", F.lit("Controller"))).join(here, ["_class", "file_path"], "left")
    named = F.contains(F.lower("file_path"), F.lower("_owner"))
    best = top_per_group(met.where(named | F.col("_declared")), ["ref_id"], [F.desc(named), "file_path", "start_line", "id"], 1)
    return best.select("ref_id", F.col("id").alias("target"), F.lit(0.85).alias("confidence"))


# ---- Python --------------------------------------------------------------------------------------


def _python_routes(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """path, re_path and url with a view (by the last part of its name) or an included module, and registered view sets."""
    found = calls_in(files, r"\b(path|re_path|url)\s*\(").withColumn("url", _part("args", r"""^\s*r?['"]([^'"]+)['"]\s*,"""))
    rest = _part("args", r"""(?s)^\s*r?['"][^'"]+['"]\s*,\s*([\w.]+(?:\s*\([^)]*\))?)""")
    found = found.withColumn("_rest", F.trim(rest)).where("url != '' and _rest != ''")
    included = _part("_rest", r"""^include\s*\(\s*['"]([^'"]+)['"]""")
    view = F.regexp_extract(F.regexp_replace("_rest", r"\.\w+\s*\([^)]*\)\s*$", ""), r"(?:^|\.)([A-Za-z_]\w*)$", 1)
    kind = F.when(included != "", "imports").otherwise("references")
    views = _rows(found, F.lit(None), F.col("url"), F.when(included != "", included).otherwise(view), kind)
    sets = calls_in(files, r"\.(register)\s*\(")
    sets = sets.withColumn("_set", _part("args", r"""^\s*r?['"][^'"]+['"]\s*,\s*(?:\w+\.)*(\w+View(?:Set)?)\b(?!\.)""")).where("_set != ''")
    prefix = F.regexp_replace(_part("args", r"""^\s*r?['"]([^'"]+)['"]"""), r"^\^|/?\$$", "")
    return views.unionByName(_rows(sets, F.lit("VIEWSET"), F.concat(F.lit("/"), prefix), F.col("_set"), F.lit("references")))


# What a name tells of its kind, and the folders where such a thing is looked for first.
PLACES = ((r"Model$|^[A-Z][a-z]+$", ("class",), "models"), (r"View(Set)?$", ("class", "function"), "views"), (r"Form$", ("class",), "forms"))


def _python_targets(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Models, views and forms by name and kind, in the folder named after them first; the first rule of PLACES that finds one counts."""
    met = refs.select("ref_id", F.col("ref_name").alias("name")).join(nodes.select("name", "kind", "id", "file_path", "start_line"), "name")
    fits = [F.when(F.col("name").rlike(p) & F.col("kind").isin(*kinds), F.struct(F.lit(i).alias("rule"), (~F.contains("file_path", F.lit(folder))).alias("elsewhere"))) for i, (p, kinds, folder) in enumerate(PLACES)]
    best = top_per_group(met.withColumn("_fit", F.coalesce(*fits)).where("_fit is not null"), ["ref_id"], ["_fit", "file_path", "start_line", "id"], 1)
    return best.select("ref_id", F.col("id").alias("target"), F.lit(0.8).alias("confidence"))


# ---- annotations -----------------------------------------------------------------------------------


def _annotated_routes(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mapping annotations: on a method a route, handled by it, below the path of the file's first annotated class. The annotated thing is the next declared one."""
    found = calls_in(files, r"@(Get|Post|Put|Patch|Delete|Request)Mapping\b(?:[ \t]*\()?").withColumn("_url", _part("args", r"""["']([^"']*)["']"""))
    declared = nodes.where("kind in ('class', 'interface', 'enum', 'method', 'function')").select("file_path", F.col("start_line").alias("line"), F.struct("kind", "name").alias("_next"))
    # A file's lines from below: what is declared next; an annotation stands before what is declared on its line.
    after = Window.partitionBy("file_path").orderBy("line", F.col("_next").isNotNull()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    placed = found.unionByName(declared, allowMissingColumns=True).withColumn("_next", F.first("_next", ignorenulls=True).over(after)).where("what is not null")
    on_class = placed.where("what = 'Request' and _next.kind = 'class'").groupBy("file_path").agg(F.min_by("_url", "line").alias("_prefix"))
    mapped = placed.where("(what = 'Request' and _next.kind in ('method', 'function')) or what != 'Request'").join(on_class, "file_path", "left")
    parts = F.filter(F.transform(F.array(F.coalesce("_prefix", F.lit("")), F.col("_url")), lambda x: F.regexp_replace(x, r"^/+|/+$", "")), lambda x: x != "")
    verb = F.when(F.col("what") == "Request", F.coalesce(F.nullif(F.upper(_part("args", r"method\s*=\s*(?:RequestMethod\.)?(\w+)")), F.lit("")), F.lit("ANY"))).otherwise(F.upper("what"))
    handler = F.when(F.col("_next.kind").isin("method", "function"), F.col("_next.name")).otherwise("")
    return _rows(mapped, verb, F.concat(F.lit("/"), F.array_join(parts, "/")), handler, F.lit("references"))


def _mentions(path: Column, text: Column, names: Sequence[str], words: str) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1).isin(*names) & F.lower(text).rlike(words)


DJANGO = Framework(
    "django", ("python",), lambda p, t: _mentions(p, t, ("requirements.txt", "setup.py", "pyproject.toml"), "django") | (p == "manage.py"), _python_routes,
    lambda name: name.endswith(".urls"), _python_targets,
)
EXPRESS = Framework(
    "express", ("javascript", "typescript", "jsx", "tsx"),
    lambda p, t: _mentions(p, t, ("package.json",), r'"(express|fastify|koa|hapi)"\s*:') | p.rlike("routes|controllers|middleware") & t.rlike(r"express|app\.get|router\.get"),
    _script_routes, resolve=_script_targets,
)
SPRING = Framework(
    "spring", ("java", "kotlin"),
    lambda p, t: _mentions(p, t, ("pom.xml", "build.gradle", "build.gradle.kts"), "spring-boot|springframework") | p.endswith(".java") & t.rlike("@(SpringBootApplication|RestController|Service|Repository)"),
    _annotated_routes, lambda name: name.endswith(":prefix"),
)
BUILT_IN = (EXPRESS, DJANGO, SPRING)


def detected(files: DataFrame, known: Sequence[Framework] = BUILT_IN) -> tuple[Framework, ...]:
    """Those that some file (path, text) shows to be used; one pass over the files, one row to the driver."""
    seen = files.agg(*(F.coalesce(F.max(f.used(F.col("path"), F.col("text"))), F.lit(False)).alias(f"_{i}") for i, f in enumerate(known))).first() if known else ()
    return tuple(f for f, yes in zip(known, seen) if yes)


def routes(files: DataFrame, nodes: DataFrame, using: Sequence[Framework]) -> tuple[DataFrame, DataFrame]:
    """(route nodes, references to what handles them) of files (path, text, language). A route is one node however many references it has; null texts
    and languages that no framework reads have none; a repeated file counts once."""
    # Written once: each framework reads the files, and both results read what was found.
    files = settled(files.select("path", "text", "language").dropDuplicates(["path"]), "files")
    empty = files.sparkSession.createDataFrame([], ROUTE)
    found = empty
    for f in using:
        own = files.where(F.col("language").isin(*f.languages))
        got = f.routes(own, nodes).select(*empty.columns)
        found = found.unionByName(f.finish(got, files).select(*empty.columns) if f.finish else got)
    name = F.concat_ws(" ", "verb", "url")
    node = F.concat_ws(":", F.lit("route"), "file_path", F.col("line").cast("string"), "verb", "url")
    found = settled(found.withColumn("id", node).withColumn("name", name), "routes")
    made = found.groupBy("id").agg(*(F.min(c).alias(c) for c in ("name", "file_path", "language", "line", "url")))
    made = made.select("id", F.lit("route").alias("kind"), "name", F.concat("file_path", F.lit("::route:"), "url").alias("qualified_name"), "file_path", "language", F.col("line").alias("start_line"), F.col("line").alias("end_line"))
    refs = found.where("ref_name is not null").select(
        F.xxhash64("id", "ref_name", "ref_kind", "line").alias("ref_id"), F.col("id").alias("from_id"), "ref_name", "ref_kind", F.col("file_path").alias("ref_file"), F.col("line").alias("ref_line"), F.col("language").alias("ref_language"),
    )
    return made, refs.distinct()


def claimed(refs: DataFrame, using: Sequence[Framework]) -> DataFrame:
    """References that one of the frameworks resolves though no node has their name."""
    return refs.where(reduce(lambda a, b: a | b, (f.claims(F.col("ref_name")) & F.col("ref_language").isin(*f.languages) for f in using), F.lit(False)))


def strategies(using: Sequence[Framework]) -> list[tuple[str, Callable[[DataFrame, DataFrame], DataFrame]]]:
    """The frameworks' own resolutions, as plug-ins of a cascade: each sees the references of its languages only."""
    made = lambda f: lambda refs, nodes: f.resolve(refs.where(F.col("ref_language").isin(*f.languages)), nodes)
    return [("framework", made(f)) for f in using if f.resolve]
