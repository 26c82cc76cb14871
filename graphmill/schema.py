"""The data model: nodes, edges, files and unresolved references, and the rules that identify them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The kinds of the model.
NODE_KINDS = ("file", "module", "class", "struct", "interface", "trait", "protocol", "function", "method", "property", "field", "variable", "constant", "enum", "enum_member", "type_alias", "namespace", "parameter", "import", "export", "route", "component")
EDGE_KINDS = ("contains", "calls", "imports", "exports", "extends", "implements", "references", "type_of", "returns", "instantiates", "overrides", "decorates")
CALLER_KINDS = ("calls", "references", "imports", "instantiates")
CONTAINER_KINDS = ("class", "interface", "struct", "trait", "protocol", "module", "enum")
RANK_KINDS = ("calls", "references", "extends", "implements", "overrides", "instantiates", "returns", "type_of", "imports")

# Column names and types (as DDL: building a StructType needs a session, which workers lack).
NODE = (
    "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, start_column int, end_column int, "
    "docstring string, signature string, visibility string, is_exported boolean, is_async boolean, is_static boolean, is_abstract boolean, "
    "decorators array<string>, type_parameters array<string>, return_type string, updated_at long"
)
EDGE = "source string, target string, kind string, metadata map<string,string>, line int, col int, provenance string"
FILE = "path string, content_hash string, language string, size long, modified_at long, indexed_at long, node_count int, errors array<string>"
REFERENCE = "from_node_id string, reference_name string, reference_kind string, line int, col int, candidates array<string>, file_path string, language string"
_DEFAULTS = {"start_line": 0, "end_line": 0, "start_column": 0, "end_column": 0, "is_exported": False, "is_async": False, "is_static": False, "is_abstract": False, "updated_at": 0}


class Graph(NamedTuple):
    """Two DataFrames; edges are a multigraph (one row a call site)."""

    nodes: DataFrame
    edges: DataFrame


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with exactly the columns of schema: missing ones get their default, or null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(_DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)))


def node_id(path: str = "file_path", kind: str = "kind", name: str = "name", line: str = "start_line") -> F.Column:
    """kind:first 32 hex digits of sha256(path:kind:name:line); a file's id is file:path."""
    hashed = F.concat_ws(":", F.col(kind), F.left(F.sha2(F.concat_ws(":", F.col(path), F.col(kind), F.col(name), F.col(line).cast("string")), 256), F.lit(32)))
    return F.when(F.col(kind) == "file", F.concat(F.lit("file:"), F.col(path))).otherwise(hashed)
