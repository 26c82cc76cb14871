"""Walking a graph level by level: a frontier is joined with the edges, what was seen before is left out, and the rest is the next frontier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.schema import CALLER_KINDS, CONTAINER_KINDS, Graph
from graphmill.store import settled, small


def steps(edges: DataFrame, direction: str = "out", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """at, to of every edge in the direction (out, in or both; a self-loop counts twice in both)."""
    e = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    out, back = e.select(F.col("source").alias("at"), F.col("target").alias("to")), e.select(F.col("target").alias("at"), F.col("source").alias("to"))
    return {"out": out, "in": back}.get(direction) or out.unionByName(back)


def reach(moves: DataFrame, start: DataFrame, depth: int | None = None, allowed: DataFrame | None = None, stop: DataFrame | None = None, free: DataFrame | None = None) -> DataFrame:
    """id, depth: the smallest number of moves from a start to every node within depth (no limit: all that can be reached).

    moves: at, to. allowed: ids that may be entered. stop: ids that are entered but not left. free: moves (at, to)
    that cost nothing. Nodes come at their least depth, whatever the order of rows. The frontier is broadcast
    only while it is counted to be small; each level is written, so plans do not grow.
    """
    def closed(front: DataFrame, seen: DataFrame | None, d: int) -> DataFrame:
        """front with all that free moves add to it."""
        while free is not None:
            more = free.join(small(front), free["at"] == front["id"]).select(F.col("to").alias("id")).distinct().join(front.select("id"), "id", "left_anti")
            more = settled(more.join(seen, "id", "left_anti") if seen is not None else more)
            if more.isEmpty():
                break
            front = settled(front.select("id").union(more.select("id")).distinct())
        return front.select("id").withColumn("depth", F.lit(d))

    front = closed(settled(start.select("id").distinct()), None, 0)
    seen, d = front, 0
    while depth is None or d < depth:
        d += 1
        leaving = front.select("id") if stop is None else front.select("id").join(stop, "id", "left_anti")
        to = moves.join(small(leaving), moves["at"] == leaving["id"]).select(F.col("to").alias("id")).distinct()
        if allowed is not None:
            to = to.join(allowed, "id", "left_semi")
        front = settled(to.join(seen.select("id"), "id", "left_anti"))
        if front.isEmpty():
            break
        front = closed(front, seen, d)
        seen = settled(seen.union(front))
    return seen


def of(graph: Graph, ids: list[str]) -> DataFrame:
    return graph.nodes.sparkSession.createDataFrame([(i,) for i in ids], "id string")


def traverse(graph: Graph, start: list[str], depth: int | None = None, kinds: tuple[str, ...] | None = None, node_kinds: tuple[str, ...] | None = None, direction: str = "out", include_start: bool = True) -> Graph:
    """The subgraph within depth moves: nodes with their depth, and the edges between them. Nodes of other kinds are not entered."""
    allowed = graph.nodes.where(F.col("kind").isin(*node_kinds)).select("id") if node_kinds else None
    found = reach(steps(graph.edges, direction, kinds), of(graph, start), depth, allowed)
    found = found if include_start else found.where("depth > 0")
    return Graph(graph.nodes.join(found, "id"), induced(graph.edges, found.select("id"), kinds))


def induced(edges: DataFrame, ids: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Edges (of the kinds) both ends of which are in ids."""
    ids = small(ids.distinct())
    e = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    return e.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def callers(graph: Graph, node: str, depth: int = 1) -> DataFrame:
    """Nodes that call, reference, import or instantiate the node: at depth 1 a row an edge, beyond that a row a node with its depth."""
    if depth == 1:
        e = graph.edges.where((F.col("target") == node) & (F.col("source") != node) & F.col("kind").isin(*CALLER_KINDS))
        return e.select(F.col("source").alias("id"), F.col("kind").alias("edge_kind"), "line").join(graph.nodes, "id")
    return graph.nodes.join(reach(steps(graph.edges, "in", CALLER_KINDS), of(graph, [node]), depth).where("depth > 0"), "id")


def callees(graph: Graph, node: str, depth: int = 1) -> DataFrame:
    """The same in the other direction."""
    return callers(Graph(graph.nodes, graph.edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "kind", "line")), node, depth)


def call_graph(graph: Graph, node: str, depth: int = 2) -> DataFrame:
    """id, role, depth: the node, its callers and its callees."""
    one = lambda role, direction: reach(steps(graph.edges, direction, CALLER_KINDS), of(graph, [node]), depth).where("depth > 0").withColumn("role", F.lit(role))
    return of(graph, [node]).select("id", F.lit(0).alias("depth"), F.lit("focal").alias("role")).unionByName(one("caller", "in")).unionByName(one("callee", "out"))


def usages(graph: Graph, node: str) -> DataFrame:
    """Every edge into the node with its source, containment too."""
    return graph.edges.where(F.col("target") == node).select(F.col("source").alias("id"), F.col("kind").alias("edge_kind"), "line").join(graph.nodes, "id")


def type_hierarchy(graph: Graph, node: str, direction: str = "both") -> DataFrame:
    """id, depth, role: ancestors and descendants over extends and implements. up alone is what a single shared set of
    visited nodes would give, since the walk down would find its start visited."""
    found = [reach(steps(graph.edges, d, ("extends", "implements")), of(graph, [node])).where("depth > 0").withColumn("role", F.lit(role)) for d, role, name in (("out", "ancestor", "up"), ("in", "descendant", "down")) if direction in ("both", name)]
    return reduce(DataFrame.unionByName, found)


def parents(edges: DataFrame) -> DataFrame:
    """id, parent: one containing node each (the smallest, where there are several)."""
    return edges.where("kind = 'contains'").groupBy(F.col("target").alias("id")).agg(F.min("source").alias("parent"))


def ancestors(graph: Graph, node: str) -> DataFrame:
    """id, depth: the chain of containing nodes, nearest first."""
    return reach(parents(graph.edges).select(F.col("id").alias("at"), F.col("parent").alias("to")), of(graph, [node])).where("depth > 0")


def children(graph: Graph, node: str) -> DataFrame:
    return graph.edges.where((F.col("source") == node) & (F.col("kind") == "contains")).select(F.col("target").alias("id")).distinct().join(graph.nodes, "id")


def impact(graph: Graph, node: str, depth: int = 3) -> DataFrame:
    """id, depth: what a change of the node may break: reverse edges but contains; the children of containers come with them at no cost."""
    back = steps(graph.edges.where("kind != 'contains'"), "in")
    inside = graph.edges.where("kind = 'contains'").join(graph.nodes.where(F.col("kind").isin(*CONTAINER_KINDS)).select(F.col("id").alias("source")), "source", "left_semi")
    return reach(back, of(graph, [node]), depth, free=steps(inside))


def shortest_path(graph: Graph, a: str, b: str, kinds: tuple[str, ...] | None = None, longest: int | None = None) -> list[str] | None:
    """Ids of a shortest path of outgoing edges (of equals the one through the smallest ids from the end), or None."""
    moves, front, levels = steps(graph.edges, "out", kinds), of(graph, [a]), []
    if a == b:
        return [a]
    seen = settled(front)
    while longest is None or len(levels) < longest:
        to = moves.join(small(front), moves["at"] == front["id"]).groupBy(F.col("to").alias("id")).agg(F.min("at").alias("before"))
        level = settled(to.join(seen, "id", "left_anti"))
        levels.append(level)
        if not level.where(F.col("id") == b).isEmpty():
            path = [b]
            for level in reversed(levels):
                path.append(level.where(F.col("id") == path[-1]).first()["before"])
            return path[::-1]
        if level.isEmpty():
            return None
        front = level.select("id")
        seen = settled(seen.union(front))
    return None


def file_graph(graph: Graph) -> DataFrame:
    """source_file, target_file: files of which one has an edge other than contains into the other."""
    place = graph.nodes.select("id", "file_path")
    e = graph.edges.where("kind != 'contains'").select("source", "target").distinct()
    e = e.join(place.select(F.col("id").alias("source"), F.col("file_path").alias("source_file")), "source").join(place.select(F.col("id").alias("target"), F.col("file_path").alias("target_file")), "target")
    return e.where("source_file != target_file").select("source_file", "target_file").distinct()


def affected_files(files: DataFrame, changed: DataFrame, is_test: F.Column, depth: int = 5) -> DataFrame:
    """id, depth: test files that depend on a changed file; the search goes no further than a test file. is_test: of column id."""
    # Every level reads the pairs again, so they are written once.
    files = settled(files.select("source_file", "target_file"), "files")
    moves = files.select(F.col("target_file").alias("at"), F.col("source_file").alias("to"))
    tests = files.select(F.col("source_file").alias("id")).union(files.select(F.col("target_file").alias("id"))).distinct().where(is_test)
    return reach(moves, changed, depth, stop=tests).where(is_test)


def _big(df: DataFrame) -> DataFrame:
    """df, merged by joins that would else send it through the driver to all tasks: little each time, but at every round."""
    return df.hint("merge")


def _labels(moves: DataFrame, start: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """id, label: the smallest label that reaches each node along moves; start: id, label. within: id, colour; then a label only enters nodes of its own colour.

    Only nodes whose label has changed pass it on, over two moves a round. Each round writes the labels of the nodes that are still open, once.
    """
    def passed_on(df: DataFrame) -> DataFrame:
        to = moves.join(_big(df.select(F.col("id").alias("at"), "label")), "at").groupBy(F.col("to").alias("id")).agg(F.min("label").alias("label"))
        return to if within is None else to.join(_big(within), "id").where("colour = label").select("id", "label")

    labels = settled(start.select("id", "label"), "labels")
    new = labels
    while True:
        near = passed_on(new)
        passed = near.union(passed_on(near)).groupBy("id").agg(F.min("label").alias("_label"))
        merged = labels.join(passed, "id", "full").select("id", F.least("label", "_label").alias("label"), (F.col("label").isNull() | (F.col("_label") < F.col("label"))).alias("_new"))
        merged = settled(merged.select("id", "label", F.coalesce("_new", F.lit(False)).alias("_new")), "labels")
        labels, new = merged.select("id", "label"), merged.where("_new")
        if new.isEmpty():
            return labels


def components(moves: DataFrame) -> DataFrame:
    """id, component, size: the strongly connected component of every node that has a move, named by its smallest node. moves: at, to.

    Nodes without a way in or without a way out are components of their own and are peeled off, layer by layer. Of the rest, each node is coloured by the
    smallest node that reaches it; what reaches that node within its colour is its component; and so on with what is left. A round holds a row a node and reads
    the moves that are left; pairs of nodes that reach each other are never listed. Rounds grow with the length of paths, not with their number.
    """
    every = settled(moves.select("at", "to").where("at is not null and to is not null").distinct(), "moves")
    m, left, done = every.where("at != to"), None, []
    left = settled(every.select(F.col("at").alias("id")).union(every.select("to")).distinct(), "open")
    while True:
        size = m.count()
        while size:
            # A move stays while something leads to where it begins, and something leads on from where it ends.
            kept = settled(m.join(_big(m.select(F.col("to").alias("at")).distinct()), "at", "left_semi").join(_big(m.select(F.col("at").alias("to")).distinct()), "to", "left_semi").select("at", "to"), "moves")
            before, m, size = size, kept, kept.count()
            if size == before:
                break
        open_ = settled(m.select(F.col("at").alias("id")).union(m.select("to")).distinct(), "open")
        done.append(left.join(_big(open_), "id", "left_anti").select("id", F.col("id").alias("component")))
        left = open_
        if left.isEmpty():
            break
        colours = settled(_labels(m, left.select("id", F.col("id").alias("label"))).withColumnRenamed("label", "colour"), "colours")
        back = m.select(F.col("to").alias("at"), F.col("at").alias("to"))
        found = settled(_labels(back, colours.where("id = colour").select("id", F.col("colour").alias("label")), colours).select("id", F.col("label").alias("component")), "components")
        done.append(found)
        left = settled(left.join(_big(found), "id", "left_anti"), "open")
        inside = lambda side: _big(left.select(F.col("id").alias(side)))  # noqa: B023, E731
        m = settled(m.join(inside("at"), "at", "left_semi").join(inside("to"), "to", "left_semi").select("at", "to"), "moves")
    out = reduce(DataFrame.union, done, left.select("id", F.col("id").alias("component")).limit(0))
    return out.join(_big(out.groupBy("component").agg(F.count("*").alias("size"))), "component").select("id", "component", "size")


def cyclic(moves: DataFrame) -> DataFrame:
    """id: nodes that reach themselves: those of components of more than one node, and those with a move to themselves. moves: at, to."""
    alone = moves.where("at = to").select(F.col("at").alias("id"))
    return components(moves).where("size > 1").select("id").union(alone).distinct()


def context(graph: Graph, node: str) -> DataFrame:
    """role, id: ancestors, children, references in and out (without containment) and types of a node."""
    e = graph.edges
    role = lambda df, name: df.select(F.lit(name).alias("role"), "id").distinct()
    return reduce(DataFrame.unionByName, [
        role(ancestors(graph, node), "ancestor"), role(children(graph, node), "child"),
        role(e.where((F.col("target") == node) & (F.col("kind") != "contains")).select(F.col("source").alias("id")), "incoming"),
        role(e.where((F.col("source") == node) & (F.col("kind") != "contains")).select(F.col("target").alias("id")), "outgoing"),
        role(e.where((F.col("source") == node) & F.col("kind").isin("type_of", "returns")).select(F.col("target").alias("id")), "type"),
    ])


def glue(graph: Graph, roots: DataFrame, files: DataFrame, most: int = 60) -> DataFrame:
    """id: callers and callees of roots that live in files already chosen."""
    both = steps(graph.edges, "both", CALLER_KINDS)
    near = both.join(small(roots), both["at"] == roots["id"]).select(F.col("to").alias("id")).distinct()
    return near.join(graph.nodes.select("id", "file_path").join(small(files), "file_path", "left_semi").select("id"), "id", "left_semi").join(roots, "id", "left_anti").orderBy("id").limit(most)


def first_match_above(edges: DataFrame, members: DataFrame, start: DataFrame, depth: int = 4) -> DataFrame:
    """id, name, found, depth: for each wanted (id, name) the member of that name in the nearest supertype, within depth.

    edges: extends and implements; members: owner, name, member.
    """
    up = edges.where(F.col("kind").isin("extends", "implements")).select(F.col("source").alias("at"), F.col("target").alias("to")).distinct()
    level, levels = start.select("id", "name", F.col("id").alias("at")), []
    for d in range(depth):
        levels.append(level.withColumn("depth", F.lit(d)))
        level = level.join(up, "at").select("id", "name", F.col("to").alias("at")).distinct()
    every = reduce(DataFrame.unionByName, levels).join(members.withColumnRenamed("owner", "at"), ["at", "name"])
    nth = F.row_number().over(Window.partitionBy("id", "name").orderBy("depth", "member"))
    return every.withColumn("nth", nth).where("nth = 1").select("id", "name", F.col("member").alias("found"), "depth")
