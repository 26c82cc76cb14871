"""Column predicates on paths and symbols."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

# File name endings that tools generate.
GENERATED = (
    r"\.pb\.go$", r"\.pulsar\.go$", r"_grpc\.pb\.go$", r"_mock\.go$", r"_mocks\.go$", r"^mock_[^/]+\.go$",
    r"\.generated\.[jt]sx?$", r"\.gen\.[jt]sx?$", r"\.pb\.[jt]s$", r"_pb\.[jt]s$", r"_grpc_pb\.[jt]s$", r"\.min\.m?js$",
    r"_pb2(_grpc)?\.py$", r"_pb2\.pyi$", r"\.pb\.(cc|h)$", r"\.g\.cs$", r"Grpc\.cs$", r"OuterClass\.java$", r"Grpc\.java$",
    r"\.pb\.swift$", r"\.g\.dart$", r"\.freezed\.dart$", r"\.pb\.dart$", r"\.pbgrpc\.dart$", r"\.chopper\.dart$", r"\.generated\.rs$",
)
# File names and folders of tests, and folders that are not production code.
TEST_NAMES = (r"^test_", r"^test\.", r"[._-](test|tests|spec|specs)\.[a-z0-9]+$")
TEST_NAMES_CASED = r"(Test|Tests|TestCase|Tester|Spec|Specs)\.[A-Za-z0-9]+$"
TEST_FOLDERS = r"/(tests|test|__tests__|spec|specs|testlib|testing)/|^(test|tests|spec|specs)/"
TEST_FOLDERS_CASED = r"(^|/)[A-Za-z0-9]*(Test|Tests|Spec)/"
OTHER_FOLDERS = r"(^|/)(integration|sample|samples|example|examples|fixture|fixtures|benchmark|benchmarks|demo|demos)/"
LOW_VALUE = (
    r"(^|/)(tests?|__tests?__|spec)/", r"_test\.go$", r"(^|/)test_[^/]+\.py$", r"_test\.py$", r"_spec\.rb$", r"_test\.rb$",
    r"\.(test|spec)\.[jt]sx?$", r"(test|spec|tests)\.(java|kt|scala)$", r"(tests?|spec)\.cs$", r"tests?\.swift$", r"_test\.dart$",
)
CONFIG_LANGUAGES = ("yaml", "properties")
GLOB_KINDS = ("function", "method", "class", "interface", "struct", "variable", "constant")
PATH_PREFIXES = ("crate", "super", "self")


def any_of(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def file_name(path: F.Column) -> F.Column:
    return F.substring_index(path, "/", -1)


def is_test(path: F.Column) -> F.Column:
    name = file_name(path)
    return F.lower(name).rlike(any_of(TEST_NAMES)) | name.rlike(TEST_NAMES_CASED) | F.lower(path).rlike(any_of((TEST_FOLDERS, OTHER_FOLDERS))) | path.rlike(TEST_FOLDERS_CASED)


def is_generated(path: F.Column) -> F.Column:
    return path.rlike(any_of(GENERATED))


def is_low_value(path: F.Column) -> F.Column:
    return F.lower(path).rlike(any_of(LOW_VALUE)) | is_generated(path)


def is_config_leaf(kind: F.Column, language: F.Column) -> F.Column:
    """A value that may be secret: render its key only."""
    return (kind == "constant") & language.isin(*CONFIG_LANGUAGES)


def glob(pattern: str, double: str = ".*", single: str = "[^/]*", one: str = "[^/]") -> str:
    """A path glob as a regular expression (unanchored): ** crosses folders, * and ? don't."""
    out = re.escape(pattern).replace(r"\*\*", "\0").replace(r"\*", single).replace(r"\?", one)
    return out.replace("\0", double)


def name_glob(pattern: str) -> str:
    """A qualified-name glob, anchored."""
    return f"^{glob(pattern, '.*', '.*', '.')}$"


def under(path: F.Column, prefix: str) -> F.Column:
    """Whether a path is the prefix or below it; leading /, . and ./ and backslashes don't matter."""
    p = re.sub(r"^(\./|/|\.$)+", "", prefix.replace("\\", "/")).rstrip("/")
    return (path == p) | path.startswith(p + "/") if p else F.lit(True)


def matches_symbol(symbol: str, name: str = "name", qualified: str = "qualified_name", path: str = "file_path", kind: str = "kind") -> F.Column:
    """Whether a node is what a caller calls `symbol`: by name, a file by its stem, or by a name qualified with . :: or /,
    whose containers stand in the qualified name or, failing that, are all folders or stems of the path."""
    simple = (F.col(name) == symbol) | ((F.col(kind) == "file") & (F.regexp_replace(name, r"\.[^.]+$", "") == symbol))
    parts = [p for p in re.split(r"::|[./]", symbol) if p]
    if not re.search(r"[./]|::", symbol) or len(parts) < 2:
        return simple
    hints = [p for p in parts[:-1] if p not in PATH_PREFIXES]
    segments = F.filter(F.split(F.col(path), "/"), lambda s: s != "")
    inside = F.lit(bool(hints))
    for h in hints:
        inside &= F.array_contains(segments, h) | F.array_contains(F.transform(segments, lambda s: F.regexp_replace(s, r"\.[^.]+$", "")), h)
    return simple | ((F.col(name) == parts[-1]) & (F.instr(F.col(qualified), "::".join(parts)).cast("int") > 0) | (F.col(name) == parts[-1]) & inside)
