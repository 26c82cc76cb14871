"""Source files as rows: scanning folders, and extracting symbols and references."""

from __future__ import annotations

import ast
import posixpath
import fnmatch
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.schema import Graph, node_id
from graphmill.store import dealt, valid_edges

# Languages by file ending.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "jsx", ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".rs": "rust", ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp",
    ".cs": "csharp", ".php": "php", ".rb": "ruby", ".swift": "swift", ".kt": "kotlin", ".dart": "dart", ".scala": "scala", ".lua": "lua", ".svelte": "svelte", ".vue": "vue", ".yml": "yaml", ".yaml": "yaml", ".properties": "properties",
}
IGNORED = ("node_modules", ".git", "dist", "build", "target", "vendor", "__pycache__", ".venv", "venv", "coverage")
LARGEST = 1 << 20
#: Declarations of languages that are read line by line: kind and pattern with the name in group 1.
_LINES = {
    "typescript": [("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("function", r"\bfunction\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("type_alias", r"\btype\s+(\w+)\s*="), ("method", r"^\s+(?:(?:public|private|protected|static|async)\s+)*(\w+)\s*\([^;]*\{\s*$")],
    "go": [("function", r"^func\s+(\w+)"), ("method", r"^func\s+\([^)]*\)\s*(\w+)"), ("struct", r"^type\s+(\w+)\s+struct"), ("interface", r"^type\s+(\w+)\s+interface")],
    "java": [("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("method", r"^\s+(?:(?:public|private|protected|static|final)\s+)+[\w<>\[\], ]+\s+(\w+)\s*\(")],
    "rust": [("function", r"\bfn\s+(\w+)"), ("struct", r"\bstruct\s+(\w+)"), ("trait", r"\btrait\s+(\w+)"), ("enum", r"\benum\s+(\w+)")],
    "ruby": [("class", r"^\s*class\s+(\w+)"), ("module", r"^\s*module\s+(\w+)"), ("method", r"^\s*def\s+(\w+)")],
}
for _other, _like in (("javascript", "typescript"), ("tsx", "typescript"), ("jsx", "typescript"), ("csharp", "java"), ("kotlin", "java")):
    _LINES[_other] = _LINES[_like]
_WORDS = frozenset("if for while switch catch return function class new sizeof await super constructor".split())


def language_of(path: F.Column) -> F.Column:
    ends = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(ends[F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)], F.lit("unknown"))


def ignored(patterns: list[str]):
    """A test for paths below the root: built-in folders, then patterns as in .gitignore (the last one that fits decides; ! takes back)."""

    def test(path: str) -> bool:
        out = any(p in IGNORED for p in path.split("/")[:-1])
        for raw in patterns:
            p = raw.strip()
            if not p or p.startswith("#"):
                continue
            back, p = p.startswith("!"), p.lstrip("!")
            anchored, p = "/" in p.rstrip("/"), p.strip("/")
            tails = [path, *(path[: i] for i, c in enumerate(path) if c == "/")]
            if any(fnmatch.fnmatch(t, p) or not anchored and fnmatch.fnmatch(t.rsplit("/", 1)[-1], p) for t in tails):
                out = not back
        return out

    return test


def scan(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """path (below the root), text, language, size, modified_at, content_hash, error of the source files of a folder.

    Files beyond 1 MB or not in UTF-8 keep a row with an error and no text. Other languages and ignored paths are dropped.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    path = F.regexp_replace("path", f"^.*?{re.escape(base.split(':', 1)[-1].lstrip('/'))}/", "")
    keep = ignored(patterns or [])
    wanted = F.pandas_udf(lambda s: s.map(lambda p: not keep(p)), "boolean")
    rows = files.withColumn("path", path).withColumn("language", language_of(F.col("path"))).where("language != 'unknown'").where(wanted("path"))
    text = F.when(F.expr("is_valid_utf8(cast(content as string))"), F.col("content").cast("string"))
    error = F.when(F.col("length") > LARGEST, "larger than 1 MB").when(text.isNull(), "not UTF-8")
    return rows.select("path", F.when(error.isNull(), text).alias("text"), "language", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("content_hash"), error.alias("error"))


def _python(path: str, text: str) -> Iterator[tuple]:
    """Rows of a Python file: (what, kind, name, qualified name, first line, last line, owner's qualified name, docstring, exported)."""
    tree = ast.parse(text)

    def visit(node: ast.AST, owner: str, in_class: bool) -> Iterator[tuple]:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "class" if isinstance(x, ast.ClassDef) else "method" if in_class else "function"
                qualified = f"{owner}::{x.name}" if owner else x.name
                yield "node", kind, x.name, qualified, x.lineno, x.end_lineno, owner, ast.get_docstring(x), not x.name.startswith("_")
                if not isinstance(x, ast.ClassDef):
                    if gives := _type_of(x.returns):
                        yield "type", "returns", gives, qualified, x.lineno, None, None, None, None
                    for a in [*x.args.posonlyargs, *x.args.args, *x.args.kwonlyargs]:
                        if takes := _type_of(a.annotation):
                            yield "type", "variable", a.arg, takes, a.lineno, None, qualified, None, None
                for d in x.decorator_list:
                    if name := _called(d):
                        yield "ref", "decorates", name, None, d.lineno, None, qualified, None, None
                if isinstance(x, ast.ClassDef):
                    for b in x.bases:
                        if name := _called(b):
                            yield "ref", "extends", name, None, x.lineno, None, qualified, None, None
                yield from visit(x, qualified, isinstance(x, ast.ClassDef))
            else:
                if isinstance(x, ast.Call) and (name := _received(x.func)):
                    yield "ref", "calls", name, None, x.lineno, None, owner, None, None
                elif isinstance(x, (ast.Assign, ast.AnnAssign)):
                    said = _type_of(x.annotation) if isinstance(x, ast.AnnAssign) else None
                    made = _called(x.value) if isinstance(x.value, ast.Call) else None
                    if kind := said or (made if made and made[0].isupper() else None):
                        for to in x.targets if isinstance(x, ast.Assign) else [x.target]:
                            if isinstance(to, ast.Name):
                                yield "type", "variable", to.id, kind, x.lineno, None, owner, None, None
                            elif isinstance(to, ast.Attribute) and isinstance(to.value, ast.Name) and to.value.id == "self":
                                # What a method puts into its object is known in the whole class.
                                yield "type", "variable", to.attr, kind, x.lineno, None, owner.rpartition("::")[0], None, None
                elif isinstance(x, (ast.Import, ast.ImportFrom)):
                    for a in x.names:
                        yield "ref", "imports", (a.asname or a.name).rsplit(".", 1)[-1], None, x.lineno, None, owner, None, None
                        if isinstance(x, ast.Import):
                            whole = a.name if a.asname else a.name.split(".", 1)[0]
                            yield "import", None, a.asname or whole, whole.replace(".", "/"), x.lineno, None, None, None, None
                        elif a.name != "*":
                            yield "import", None, a.asname or a.name, _module(path, x.level, x.module), x.lineno, None, a.name, None, None
                yield from visit(x, owner, in_class)

    yield from visit(tree, "", False)


def _type_of(x: ast.AST | None) -> str | None:
    """The name of a type that is written as a name, a dotted name, a text, or one of these or None."""
    if isinstance(x, ast.Constant) and isinstance(x.value, str):
        return x.value.rsplit(".", 1)[-1] if re.fullmatch(r"[\w.]+", x.value) else None
    if isinstance(x, ast.BinOp):
        sides = [t for t in (_type_of(x.left), _type_of(x.right)) if t]
        return sides[0] if len(sides) == 1 else None
    return x.id if isinstance(x, ast.Name) else x.attr if isinstance(x, ast.Attribute) else None


def _module(path: str, level: int, module: str | None) -> str:
    """Path of the module that `from ..module import` names in the file at path."""
    folder = path.split("/")[:-level] if level else []
    return "/".join([*folder, *(module or "").split(".")]).rstrip("/")


def _received(x: ast.AST) -> str | None:
    """Name of what is called, with its receiver where that is a name other than self or cls."""
    parts: list[str] = []
    while isinstance(x, ast.Attribute):
        parts.append(x.attr)
        x = x.value
    if isinstance(x, ast.Name) and (not parts or x.id not in ("self", "cls")):
        parts.append(x.id)
    return ".".join(reversed(parts)) if parts and (isinstance(x, ast.Name)) else parts[0] if parts else None


#: Imports of names from a path, as scripts write them: {names}, a default name, * as name, or require. Exports of what another file has.
_FROM = re.compile(r"""^\s*(?:import)\s+(?:type\s+)?(.*?)\s+from\s+["']([^"']+)["']|^\s*(?:const|let|var)\s+(.*?)\s*=\s*require\(\s*["']([^"']+)["']\s*\)""")
_EXPORT = re.compile(r"""^\s*export\s+(?:type\s+)?(\*|\{.*?\})(?:\s+as\s+(\w+))?\s+from\s+["']([^"']+)["']""")


def _module_of(path: str, source: str) -> tuple[str | None, str]:
    """(None, path below the root without ending) of a relative path; (`spec`, the path as it stands) of others, which configs explain."""
    if not source.startswith("."):
        return "spec", source
    return None, posixpath.normpath(posixpath.join(posixpath.dirname(path), re.sub(r"\.(js|jsx|ts|tsx|mjs)$", "", source)))


def _script_imports(path: str, text: str) -> Iterator[tuple]:
    """Import and export rows of a script, of statements on one line each."""
    for i, line in enumerate(text.split("\n"), 1):
        if m := _EXPORT.match(line):
            kind, module = _module_of(path, m[3])
            if m[1] == "*" and not m[2]:
                yield "export", kind, None, module, i, None, None, None, None
            for part in m[1].strip("{}").split(",") if m[1] != "*" else ():
                ends = re.split(r"\s+as\s+", part.strip())
                if ends[0]:
                    yield "export", kind, ends[-1], module, i, None, ends[0], None, None
            continue
        if not (m := _FROM.match(line)):
            continue
        names, source, required = m[1] or m[3], m[2] or m[4], m[3] is not None
        kind, module = _module_of(path, source)
        inner = re.search(r"\{(.*)\}", names)
        for part in inner[1].split(",") if inner else ():
            ends = re.split(r"\s+as\s+|\s*:\s*", part.strip())
            if ends[0]:
                yield "import", kind, ends[-1], module, i, None, ends[0], None, None
        outer = re.sub(r"\{.*\}", "", names)
        for part in filter(None, (p.strip() for p in outer.split(","))):
            whole = re.match(r"\*\s+as\s+(\w+)$", part)
            # A default import stands for the module's export of the same name.
            yield "import", kind, whole[1] if whole else part, module, i, None, None if whole or required else part, None, None


def _called(x: ast.AST) -> str | None:
    x = x.func if isinstance(x, ast.Call) else x
    return x.id if isinstance(x, ast.Name) else x.attr if isinstance(x, ast.Attribute) else None


#: What a declaration's line says of its supertypes, and of what it returns, after its name.
_SUPERS = (("extends", r"\bextends\s+([\w.]+)"), ("extends", r"\bclass\s+\w+\s*<\s*([\w:]+)"), ("implements", r"\bimplements\s+([\w.,\s]+)"))
_RETURNS = {"typescript": r"\)\s*:\s*([A-Z]\w*)", "tsx": r"\)\s*:\s*([A-Z]\w*)", "java": r"\b([A-Z]\w*)(?:<[^()]*>)?\s+{name}\s*\(", "csharp": r"\b([A-Z]\w*)(?:<[^()]*>)?\s+{name}\s*\(", "kotlin": r"\)\s*:\s*([A-Z]\w*)", "go": r"\)\s*\*?([A-Z]\w*)\s*\{{", "rust": r"->\s*&?([A-Z]\w*)"}


def _said_of(language: str, kind: str, name: str, qualified: str, at: int, line: str) -> Iterator[tuple]:
    """Supertypes of a type and the type that a function returns, as far as one line tells."""
    if kind in ("class", "interface"):
        for what, pattern in _SUPERS:
            for m in re.finditer(pattern, line):
                for one in filter(None, (x.strip() for x in m[1].split(","))):
                    yield "ref", what, re.split(r"[.:]", one)[-1], None, at, None, qualified, None, None
    elif kind in ("function", "method") and language in _RETURNS and (m := re.search(_RETURNS[language].format(name=re.escape(name)), line)):
        yield "type", "returns", m[1], qualified, at, None, None, None, None


def _by_lines(language: str, text: str) -> Iterator[tuple]:
    """Rows of a file of another language, by declarations and calls in each line; bodies end where the next declaration of the same depth begins."""
    lines, found = text.split("\n"), []
    for i, line in enumerate(lines, 1):
        for kind, pattern in _LINES[language]:
            if (m := re.search(pattern, line)) and m[1] not in _WORDS:
                found.append((i, len(line) - len(line.lstrip()), kind, m[1]))
                break
    owners = []
    for k, (i, depth, kind, name) in enumerate(found):
        end = next((j for j, d, _, _ in found[k + 1 :] if d <= depth), len(lines) + 1) - 1
        while owners and owners[-1][1] >= depth:
            owners.pop()
        owner = owners[-1][2] if owners else ""
        qualified = f"{owner}::{name}" if owner else name
        owners.append((i, depth, qualified))
        yield "node", kind, name, qualified, i, end, owner, None, bool(re.search(r"\b(export|public|pub)\b", lines[i - 1])) or language == "go" and name[0].isupper()
        yield from _said_of(language, kind, name, qualified, i, lines[i - 1])
        declared = {(a, n) for a, _, _, n in found}
        inner_end = next((j for j, d, _, _ in found[k + 1 :] if d > depth), end + 1) - 1 if kind in ("class", "interface", "struct", "trait", "module", "enum") else end
        for j in range(i, inner_end + 1):
            for m in re.finditer(r"(\bnew\s+)?\b(\w+)\s*\(", lines[j - 1]):
                if m[2] not in _WORDS and (j, m[2]) not in declared:
                    yield "ref", "instantiates" if m[1] else "calls", m[2], None, j, None, qualified, None, None


def extract(files: DataFrame) -> DataFrame:
    """what (node, ref, type, import, export or error), kind, name, qualified_name, start_line, end_line, owner, docstring, is_exported, file_path, language.

    files: path, text, language. Python is parsed; other languages are read by lines, which finds declarations and calls
    but not types. A file that cannot be parsed gives one error row. One pass; files are dealt to tasks by their paths first, since texts that pack
    well would otherwise be parsed, and their rows sorted later, by few tasks.
    """
    schema = "what string, kind string, name string, qualified_name string, start_line int, end_line int, owner string, docstring string, is_exported boolean, file_path string, language string"
    columns = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text, language in zip(b["path"], b["text"], b["language"]):
                if text is None:
                    continue
                rows.append(("node", "file", path.rsplit("/", 1)[-1], path, 1, text.count("\n") + 1, None, None, True, path, language))
                try:
                    found = list(_python(path, text) if language == "python" else _by_lines(language, text) if language in _LINES else ())
                    if language in ("javascript", "typescript", "jsx", "tsx"):
                        found += _script_imports(path, text)
                    rows += [(*r, path, language) for r in found]
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append(("error", "file", str(e)[:200], path, 1, 1, None, None, None, path, language))
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"start_line": "Int32", "end_line": "Int32", "is_exported": "boolean"})

    return dealt(files.select("path", "text", "language"), "path").mapInPandas(run, schema)


def imports_of(extracted: DataFrame) -> DataFrame:
    """ref_file, local, exported (null: the whole module), module, language, spec (the module as written, where configs explain it): what local names of a file stand for."""
    said = extracted.where("what = 'import'").select(F.col("file_path").alias("ref_file"), F.col("name").alias("local"), F.col("owner").alias("exported"), F.col("qualified_name").alias("module"), "language", F.when(F.col("kind") == "spec", F.col("qualified_name")).alias("spec"))
    return said.distinct()


def exports_of(extracted: DataFrame) -> DataFrame:
    """ref_file, name (null: everything), from_name, module, language, spec: what files pass on from others."""
    said = extracted.where("what = 'export'").select(F.col("file_path").alias("ref_file"), "name", F.col("owner").alias("from_name"), F.col("qualified_name").alias("module"), "language", F.when(F.col("kind") == "spec", F.col("qualified_name")).alias("spec"))
    return said.distinct()


def graph_of(extracted: DataFrame) -> tuple[Graph, DataFrame]:
    """(nodes and contains edges, references: ref_id, from_id, ref_name, ref_kind, ref_file, ref_line, ref_language)."""
    gives = extracted.where("what = 'type' and kind = 'returns'").groupBy("file_path", "qualified_name", "start_line").agg(F.min("name").alias("return_type"))
    nodes = extracted.where("what = 'node'").drop("what").join(gives, ["file_path", "qualified_name", "start_line"], "left").withColumn("id", F.when(F.col("kind") == "file", F.concat(F.lit("file:"), "file_path")).otherwise(node_id()))
    owners = nodes.select("file_path", F.when(F.col("kind") == "file", "").otherwise(F.col("qualified_name")).alias("owner"), F.col("id").alias("source"))
    edges = nodes.where("kind != 'file'").join(owners, ["file_path", "owner"]).select("source", F.col("id").alias("target"), F.lit("contains").alias("kind"), F.col("start_line").alias("line"))
    refs = extracted.where("what = 'ref'").join(owners, ["file_path", "owner"])
    refs = refs.select(F.xxhash64("source", "name", "kind", "start_line").alias("ref_id"), F.col("source").alias("from_id"), F.col("name").alias("ref_name"), F.col("kind").alias("ref_kind"), F.col("file_path").alias("ref_file"), F.col("start_line").alias("ref_line"), F.col("language").alias("ref_language"))
    return Graph(nodes, valid_edges(edges, nodes)), refs.distinct()


def receiver_types(extracted: DataFrame, refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """ref_id, type: the declared type of what a call is made on (`thing.run`): that of the variable of the nearest scope around the call, of its last
    declaration there. Scopes around a call are listed by name, a row each."""
    said = extracted.where("what = 'type' and kind = 'variable'").groupBy("file_path", F.col("owner").alias("scope"), F.col("name").alias("receiver")).agg(F.max_by("qualified_name", "start_line").alias("type"))
    places = nodes.select(F.col("id").alias("from_id"), F.when(F.col("kind") == "file", "").otherwise(F.col("qualified_name")).alias("_at"))
    calls = refs.withColumn("receiver", F.regexp_extract("ref_name", r"^(\w+)\.\w+$", 1)).where("receiver != ''").join(places, "from_id")
    parts = F.filter(F.split("_at", "::"), lambda x: x != "")
    around = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "::"))
    listed = calls.select("ref_id", F.col("ref_file").alias("file_path"), "receiver", F.posexplode(around).alias("_depth", "scope"))
    return listed.join(said, ["file_path", "scope", "receiver"]).groupBy("ref_id").agg(F.max_by("type", "_depth").alias("type"))
