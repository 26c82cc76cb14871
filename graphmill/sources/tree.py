"""Source folders as a Spark data source: partitions are folders, ignore rules are carried down, and what they rule out is never listed."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Folders of dependencies, builds and caches.
DEFAULT_IGNORED = (
    "node_modules bower_components jspm_packages web_modules .yarn .pnpm-store .next .nuxt .svelte-kit .turbo .vite .parcel-cache .angular .docusaurus storybook-static "
    ".vinxi .nitro out-tsc .vercel .netlify .wrangler dist build out .output coverage .nyc_output __pycache__ __pypackages__ .venv venv .pixi .pdm-build .mypy_cache "
    ".pytest_cache .ruff_cache .tox .nox .hypothesis .ipynb_checkpoints .eggs target .gradle obj vendor .build Pods Carthage DerivedData .swiftpm .dart_tool .pub-cache .cxx "
    ".externalNativeBuild vcpkg_installed .bloop .metals lua_modules .luarocks __history __recovery .cache *.egg-info cmake-build-* bazel-*"
)
DEFAULT_RULES = tuple(f"{name}/" for name in DEFAULT_IGNORED.split())
IGNORE_FILE, REPOSITORY, CONFIG = ".gitignore", ".git", "graphmill.json"
LARGEST = 1 << 20
#: How deep below an ignored folder that is opted in repositories are looked for.
SEARCH_DEPTH = 4
#: Rows in a batch end at so many bytes of text.
_BATCH_BYTES = 16 << 20
SCHEMA = "path string, text string, language string, size long, modified_at long, content_hash string, error string"


class Rule(NamedTuple):
    takes_back: bool
    folders_only: bool
    pattern: re.Pattern


def _expression(body: str) -> str:
    """A rule's body as a regular expression; ValueError if its bracket is never closed."""
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            end = body.index("]", i + 2)
            inner = body[i + 1 : end].replace("\\", "\\\\").replace("[", r"\[")
            out, i = out + "(?!/)[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif c == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


@lru_cache(4096)
def rules_of(lines: tuple[str, ...]) -> tuple[Rule, ...]:
    """Rules of an ignore file's lines; a line that is none is left out."""
    out = []
    for raw in lines:
        line = raw.rstrip("\r")
        line = line if re.search(r"\\ +$", line) else line.rstrip(" ")
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        body = line[1:] if back else line
        folders, body = body.endswith("/"), body.rstrip("/")
        anchored, body = "/" in body, body.removeprefix("/")
        try:
            out.append(Rule(back, folders, re.compile(("" if anchored else "(?:.*/)?") + _expression(body), re.S)))
        except (ValueError, re.error):
            continue
    return tuple(out)


def ruled_out(path: str, is_folder: bool, lines: tuple[str, ...]) -> bool:
    """Whether the last rule that fits path (below the rules' folder) rules it out. Folders above are asked for on their own."""
    for r in reversed(rules_of(lines)):
        if (is_folder or not r.folders_only) and r.pattern.fullmatch(path):
            return not r.takes_back
    return False


class Folder(NamedTuple):
    """A folder (path below the root, "" for it, else ending in /) with what holds in it. levels: (folder, lines), each with its say; searching: how many more levels may
    be searched for repositories, in a folder that is ignored itself; None in others."""

    path: str
    levels: tuple[tuple[str, tuple[str, ...]], ...]
    searching: int | None = None


class Entry(NamedTuple):
    name: str
    is_folder: bool
    size: int
    modified_at: int


class Tree:
    """Walks a root. list_ and read_ take paths below the root; so that tests can see what is opened."""

    def __init__(self, list_: Callable[[str], list[Entry]], read_: Callable[[str], bytes], exclude: tuple[str, ...] = (), include: tuple[str, ...] = (), keeps: Callable[[str], bool] = lambda path: True, inside: Callable[[str], bool] = lambda path: True):
        self.list, self.read, self.exclude, self.include, self.keeps, self.inside = list_, read_, exclude, include, keeps, inside

    def lines(self, path: str, names: set[str]) -> tuple[str, ...]:
        """Of the ignore file in a folder; one that is not text counts as empty."""
        if IGNORE_FILE not in names:
            return ()
        try:
            data = self.read(path + IGNORE_FILE)
            return () if b"\0" in data else tuple(data.decode().split("\n"))
        except (OSError, UnicodeDecodeError):
            return ()

    def step(self, at: Folder) -> tuple[list[tuple[str, Entry]], list[Folder]]:
        """(files that are kept, folders to go on with) of one folder: it is listed once, the others not at all."""
        try:
            entries = sorted(self.list(at.path))
        except OSError:
            return [], []
        names = {e.name for e in entries}
        levels, searching = at.levels, at.searching
        if at.path and REPOSITORY in names:
            if self.is_worktree(at.path, entries):
                return [], []
            # A repository within: the rules around it do not hold in it, but the built-in ones do, for the whole path.
            levels, searching = (("", DEFAULT_RULES), (at.path, (*DEFAULT_RULES, *self.lines(at.path, names)))), None
        elif not at.path:
            levels = (("", (*DEFAULT_RULES, *self.lines("", names))),)
        elif searching is None and (own := self.lines(at.path, names)):
            levels = (*levels, (at.path, own))
        files, folders = [], []
        for e in entries:
            path = at.path + e.name
            if e.name == REPOSITORY or ruled_out(path, e.is_folder, self.exclude) or not self.inside(path):
                continue
            out = any(ruled_out(path[len(base) :], e.is_folder, lines) for base, lines in levels)
            if not e.is_folder:
                if searching is None and not out and self.keeps(path):
                    files.append((path, e))
            elif ruled_out(path, True, DEFAULT_RULES) and (out or searching is not None):
                continue
            elif searching is not None:
                if searching:
                    folders.append(Folder(path + "/", levels, searching - 1))
            elif not out:
                folders.append(Folder(path + "/", levels))
            elif ruled_out(path, True, self.include):
                folders.append(Folder(path + "/", levels, SEARCH_DEPTH - 1))
        return files, folders

    def is_worktree(self, path: str, entries: list[Entry]) -> bool:
        """A second view of a repository that is there already, by its pointer."""
        if any(e.name == REPOSITORY and e.is_folder for e in entries):
            return False
        try:
            to = re.search(r"^gitdir:\s*(.+)$", self.read(path + REPOSITORY).decode(errors="replace"), re.M)
        except OSError:
            return False
        return bool(to and re.search(r"(^|[\\/])\.git[\\/](modules[\\/][^\\/]+[\\/])?worktrees[\\/]", to[1].strip()))

    def walk(self, start: Folder) -> Iterator[tuple[str, Entry]]:
        open_ = [start]
        while open_:
            files, more = self.step(open_.pop())
            yield from files
            open_ += reversed(more)


def _filesystem(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if re.match(r"\w+://|file:/", root) else "file://" + os.path.abspath(root))


def tree_of(root: str, exclude: tuple[str, ...], include: tuple[str, ...], keeps: Callable[[str], bool]) -> Tree:
    """A Tree over any file system that Arrow knows. Links that lead out of the root, or up to a folder above them, are not followed."""
    from pyarrow import fs

    system, base = _filesystem(root)
    local = isinstance(system, fs.LocalFileSystem)
    real = os.path.realpath(base) if local else base

    def list_(path: str) -> list[Entry]:
        found = system.get_file_info(fs.FileSelector(f"{base}/{path}".rstrip("/")))
        return [Entry(i.base_name, i.type == fs.FileType.Directory, i.size or 0, (i.mtime_ns or 0) // 1_000_000) for i in found if i.type != fs.FileType.NotFound]

    def read_(path: str) -> bytes:
        with system.open_input_stream(f"{base}/{path}") as f:
            return f.read()

    def inside(path: str) -> bool:
        if not local or not os.path.islink(f"{base}/{path}"):
            return True
        to, here = os.path.realpath(f"{base}/{path}"), os.path.realpath(os.path.dirname(f"{base}/{path}"))
        return to.startswith(real + os.sep) and not f"{here}{os.sep}".startswith(to + os.sep)

    return Tree(list_, read_, exclude, include, keeps, inside)


class _Part(InputPartition):
    def __init__(self, folders: list[Folder], files: list[tuple[str, Entry]]):
        self.folders, self.files = folders, files


class SourceTree(DataSource):
    """spark.read.format("source_tree").load(root): path (below the root), text, language, size, modified_at, content_hash, error of source files.

    Options: exclude and includeIgnored (JSON lists of ignore rules), extensions (JSON object of ending to language), partitions, configs (true: files that explain
    import paths are rows too, of the language `config`). What the file
    graphmill.json in the root says under those names is added. Nested ignore files hold for their folders; a repository within has its own rules only;
    one in an ignored folder is read if includeIgnored names the folder. Files beyond 1 MB are not opened: they, and those not in UTF-8, have an error and no text.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SourceReader:
        return SourceReader(self.options)


def _strings(x: object) -> tuple[str, ...]:
    return tuple(s.strip() for s in x if isinstance(s, str) and s.strip()) if isinstance(x, list) else ()


def _endings(x: object, known: set[str]) -> dict[str, str]:
    """Endings (one dot, lower case) and languages that are known."""
    pairs = ((f".{k.strip().lstrip('.').lower()}", v) for k, v in x.items() if isinstance(k, str)) if isinstance(x, dict) else ()
    return {k: v for k, v in pairs if re.fullmatch(r"\.[^./\s]+", k) and v in known}


class SourceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        from graphmill.sources.code import LANGUAGES

        self.root = options["path"].rstrip("/")
        said = lambda name: json.loads(options.get(name) or "null")
        plain = tree_of(self.root, (), (), lambda path: True)
        try:
            config = json.loads(plain.read(CONFIG))
        except (OSError, ValueError):
            config = {}
        config = config if isinstance(config, dict) else {}
        both = lambda name: _strings(said(name)) + _strings(config.get(name))
        self.exclude, self.include = both("exclude"), both("includeIgnored")
        self.languages = LANGUAGES | _endings(config.get("extensions"), set(LANGUAGES.values())) | _endings(said("extensions"), set(LANGUAGES.values()))
        self.parts = int(options.get("partitions") or 64)
        self.configs = (options.get("configs") or "").lower() == "true"

    def language(self, path: str) -> str | None:
        from graphmill.operators.modules import CONFIGS

        if self.configs and path.rsplit("/", 1)[-1] in CONFIGS:
            return "config"
        return self.languages.get(os.path.splitext(path)[1].lower())

    def tree(self) -> Tree:
        return tree_of(self.root, self.exclude, self.include, lambda path: self.language(path) is not None)

    def partitions(self) -> list[InputPartition]:
        """Folders are opened level by level until there are enough for the tasks; only those are listed here."""
        tree, open_, files = self.tree(), [Folder("", ())], []
        while open_ and len(open_) < self.parts:
            steps = [tree.step(f) for f in open_]
            files += [f for found, _ in steps for f in found]
            open_ = [f for _, more in steps for f in more]
        size = max(1, -(-len(files) // self.parts))
        of_files = [_Part([], files[i : i + size]) for i in range(0, len(files), size)]
        return [_Part([f], []) for f in open_] + of_files or [_Part([], [])]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        tree, rows, held = self.tree(), [], 0
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        schema = pa.schema([(n, pa.int64() if n in ("size", "modified_at") else pa.string()) for n in names])
        for path, e in (x for source in (part.files, *(tree.walk(f) for f in part.folders)) for x in source):
            text = digest = error = None
            if e.size > LARGEST:
                error = "larger than 1 MB"
            else:
                try:
                    data = tree.read(path)
                    digest, text = hashlib.sha256(data).hexdigest(), data.decode()
                except UnicodeDecodeError:
                    error = "not UTF-8"
                except OSError as x:
                    error = f"not readable: {type(x).__name__}"
            rows.append(dict(zip(names, (path, text, self.language(path), e.size, e.modified_at, digest, error))))
            held += len(text or "")
            if held > _BATCH_BYTES or len(rows) == 1000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)


def scan_tree(spark: SparkSession, root: str, exclude: list[str] | None = None, include_ignored: list[str] | None = None, extensions: dict[str, str] | None = None, partitions: int = 64, configs: bool = False) -> DataFrame:
    """SourceTree over root, a path that driver and executors share."""
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").option("partitions", partitions).option("configs", str(configs).lower())
    for name, value in (("exclude", exclude), ("includeIgnored", include_ignored), ("extensions", extensions)):
        reader = reader.option(name, json.dumps(value)) if value else reader
    return reader.load(root)
