"""Keeping resolved references in step with changed files: only references that the change can touch are resolved again."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.operators import names
from graphmill.store import settled


class State(NamedTuple):
    """nodes; refs: ref_id, from_id, ref_name, ref_kind, ref_file, ref_line, ref_language; resolved: ref_id, target, confidence, resolved_by."""

    nodes: DataFrame
    refs: DataFrame
    resolved: DataFrame


#: What of a node a resolution may look at.
_SEEN = ("id", "kind", "name", "qualified_name", "file_path", "language", "start_line", "return_type", "is_exported", "decorators")


def touched_names(old: DataFrame, new: DataFrame) -> DataFrame:
    """key: lower-case names of nodes that one side has and the other has not, or has otherwise (each side: the nodes of the changed files). A node that stayed as it was touches nothing."""
    seen = [c for c in _SEEN if c in old.columns and c in new.columns]
    sides = old.select(*seen, F.lit(1).alias("_side")).unionByName(new.select(*seen, F.lit(-1).alias("_side")))
    return sides.groupBy(*seen).agg(F.sum("_side").alias("_n")).where("_n != 0").select(F.lower("name").alias("key")).where("key is not null").distinct()


def parts_of(name: Column) -> Column:
    """Lower-case keys of a reference's name: the whole, what stands between slashes, and between any qualifiers. Every node that a strategy may answer with has one of them as its name."""
    low = F.lower(name)
    return F.array_distinct(F.filter(F.concat(F.array(low), F.split(low, "/"), F.split(low, r"[^\w$]+")), lambda x: x != ""))


def affected(refs: DataFrame, touched: DataFrame, changed: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """ref_id of references in changed files (file_path), of those with a part that is a touched name, and of those whose import (ref_file, local, exported,
    module) is of a touched name. Names are met one row a part; a reference counts once."""
    listed = refs.select("ref_id", "ref_file", F.explode(parts_of(F.col("ref_name"))).alias("key"))
    found = [refs.join(changed.select(F.col("file_path").alias("ref_file")), "ref_file", "left_semi").select("ref_id"), listed.join(touched, "key", "left_semi").select("ref_id")]
    if imports is not None:
        last = F.coalesce("exported", F.element_at(F.split("module", "/"), -1))
        brought = imports.select("ref_file", F.lower("local").alias("local"), F.lower(last).alias("key")).join(touched, "key", "left_semi").select("ref_file", F.col("local").alias("key")).distinct()
        found.append(listed.join(brought, ["ref_file", "key"], "left_semi").select("ref_id"))
    return reduce(DataFrame.union, found).distinct()


def update(state: State, changed: DataFrame, nodes: DataFrame, refs: DataFrame, resolve: Callable[[DataFrame, DataFrame], DataFrame] = names.cascade, imports: DataFrame | None = None) -> tuple[State, DataFrame]:
    """The state after a change, and the ids of the references that were resolved again.

    changed: file_path of files that are new, gone or edited; nodes, refs: what these files hold now (nothing, of those that are gone). The result is that of
    resolving everything anew; what is joined is the changed files' nodes and, of all references, the affected ones. resolve(refs, nodes) gives ref_id, target,
    confidence, resolved_by, and must look for nodes by names that stand in the reference (or in imports, where given).
    """
    changed = settled(changed.select("file_path").distinct(), "changed")
    was = state.nodes.join(changed, "file_path", "left_semi")
    touched = settled(touched_names(was, nodes), "touched")
    now = settled(state.nodes.join(changed, "file_path", "left_anti").unionByName(nodes, allowMissingColumns=True), "nodes")
    gone = changed.select(F.col("file_path").alias("ref_file"))
    asked_from = settled(state.refs.join(gone, "ref_file", "left_anti").unionByName(refs), "refs")
    again = settled(affected(asked_from, touched, changed, imports), "affected")
    found = settled(resolve(settled(asked_from.join(again, "ref_id", "left_semi"), "asked"), now), "found")
    kept = state.resolved.join(again, "ref_id", "left_anti").join(asked_from.select("ref_id"), "ref_id", "left_semi")
    return State(now, asked_from, settled(kept.unionByName(found.select(*kept.columns)), "resolved")), again
