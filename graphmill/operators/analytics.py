"""Counts and rankings over a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.predicates import is_low_value
from graphmill.operators.traverse import parents
from graphmill.schema import CALLER_KINDS, CONTAINER_KINDS, Graph
from graphmill.store import settled, small


def counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def files_of(graph: Graph) -> DataFrame:
    """path, language, node_count of the files that hold nodes."""
    return graph.nodes.groupBy(F.col("file_path").alias("path")).agg(F.min("language").alias("language"), F.count("*").alias("node_count"))


def in_file_edges(graph: Graph) -> DataFrame:
    """file_path, n: edges other than contains whose ends share a file."""
    place = graph.nodes.select("id", "file_path")
    e = graph.edges.where("kind != 'contains'")
    e = e.join(place.select(F.col("id").alias("source"), "file_path"), "source").join(place.select(F.col("id").alias("target"), F.col("file_path").alias("other")), "target")
    return e.where("file_path = other").groupBy("file_path").agg(F.count("*").alias("n"))


def dominant_file(graph: Graph, top: int = 20, least: int = 20) -> DataFrame:
    """file_path, n, next_n of the file with most in-file edges, if it has `least`. Low-value files are dropped after the top is cut."""
    first = in_file_edges(graph).orderBy(F.desc("n"), "file_path").limit(top).where(~is_low_value(F.col("file_path")))
    order = Window.orderBy(F.desc("n"), "file_path")  # of at most `top` rows
    return first.select("file_path", "n", F.lead("n").over(order).alias("next_n"), F.row_number().over(order).alias("nth")).where(f"nth = 1 and n >= {least}").select("file_path", "n", "next_n")


def top_share(counted: DataFrame, key: str, top: int = 20, least: int = 3, share: float = 0.3) -> DataFrame:
    """key, n, total: the first key by n, if it has `least` and `share` of the total over the top keys that are no low-value files."""
    first = counted.orderBy(F.desc("n"), key).limit(top).where(~is_low_value(F.col(key)))
    every = Window.partitionBy()  # of at most `top` rows
    ranked = first.select(key, "n", F.sum("n").over(every).alias("total"), F.row_number().over(Window.orderBy(F.desc("n"), key)).alias("nth"))
    return ranked.where((F.col("nth") == 1) & (F.col("n") >= least) & (F.col("total") >= least) & (F.col("n") / F.col("total") >= share)).select(key, "n", "total")


def routing_manifest(graph: Graph, routes: DataFrame, most: int = 50) -> DataFrame:
    """route, handler, file_path, line: references and calls of route nodes (id) to functions, methods and classes. The limit is
    applied before low-value files are dropped, so fewer rows may come back."""
    e = graph.edges.where(F.col("kind").isin("references", "calls")).join(routes.select(F.col("id").alias("source")), "source", "left_semi")
    h = graph.nodes.where(F.col("kind").isin("function", "method", "class", "interface", "struct")).select(F.col("id").alias("target"), F.col("name").alias("handler"), "file_path", F.col("start_line").alias("handler_line"))
    rows = e.join(h, "target").select(F.col("source").alias("route"), "handler", "file_path", "handler_line").distinct()
    return rows.orderBy("file_path", "handler_line", "route").limit(most).where(~is_low_value(F.col("file_path")))


def node_metrics(graph: Graph) -> DataFrame:
    """id, in_degree, out_degree, calls_in, calls_out, children of every node."""
    e = graph.edges
    one = lambda c, other, pre: e.groupBy(F.col(c).alias("id")).agg(F.count("*").alias(f"{pre}_degree"), F.count(F.when(F.col("kind") == "calls", 1)).alias(f"calls_{pre}"), F.count(F.when(F.col("kind") == "contains", 1)).alias(f"contains_{pre}"))
    out = graph.nodes.select("id").join(one("target", "source", "in"), "id", "left").join(one("source", "target", "out"), "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("id", zero(F.col("in_degree")).alias("in_degree"), zero(F.col("out_degree")).alias("out_degree"), zero(F.col("calls_in")).alias("calls_in"), zero(F.col("calls_out")).alias("calls_out"), zero(F.col("contains_out")).alias("children"))


def depths(graph: Graph, most: int = 10) -> DataFrame:
    """id, depth: number of containing nodes above each node."""
    up = settled(parents(graph.edges))
    level, found = graph.nodes.select("id", F.col("id").alias("at")), None
    for d in range(most + 1):
        on = level.join(up.withColumnRenamed("id", "at"), "at", "left").select("id", "parent")
        ended = on.where("parent is null").select("id", F.lit(d).alias("depth"))
        found = ended if found is None else found.union(ended)
        level = settled(on.where("parent is not null").select("id", F.col("parent").alias("at")))
        if level.isEmpty():
            break
    return found


def dead_code(graph: Graph, kinds: tuple[str, ...] = ("function", "method", "class")) -> DataFrame:
    """Nodes of the kinds that are not exported and that nothing but containment points to."""
    used = graph.edges.where("kind != 'contains'").select(F.col("target").alias("id"))
    return graph.nodes.where(F.col("kind").isin(*kinds) & ~F.col("is_exported")).join(used, "id", "left_anti")


def module_structure(paths: DataFrame) -> DataFrame:
    """folder, files: sorted paths of each folder; the root is `.`."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return paths.groupBy(F.when(folder == "", ".").otherwise(folder).alias("folder")).agg(F.array_join(F.sort_array(F.collect_list("path")), ",").alias("files"))


def blast_radius(graph: Graph, roots: DataFrame, is_test: F.Column) -> DataFrame:
    """id, callers, files, test_files: distinct callers of each root, and the files they are in. is_test: of column file_path."""
    e = graph.edges.where(F.col("kind").isin(*CALLER_KINDS)).join(small(roots.select(F.col("id").alias("target"))), "target", "left_semi").where("source != target").select("source", "target").distinct()
    at = e.join(graph.nodes.select(F.col("id").alias("source"), "file_path"), "source")
    return at.groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("callers"), F.countDistinct(F.when(~is_test, F.col("file_path"))).alias("files"), F.countDistinct(F.when(is_test, F.col("file_path"))).alias("test_files"))


def by_file(nodes: DataFrame) -> DataFrame:
    """file_path, n, symbols: nodes of each file as name:line in the order of lines."""
    item = F.struct("start_line", "name")
    return nodes.groupBy("file_path").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: F.concat_ws(":", x["name"], x["start_line"].cast("string"))), ",").alias("symbols"))


def definitions(nodes: DataFrame, file_part: str | None = None) -> DataFrame:
    """file_path, qualified_name, n: symbols grouped by definition; narrowed to files that hold file_part, if any does."""
    if file_part:
        some = nodes.where(F.contains("file_path", F.lit(file_part)))
        nodes = nodes if some.isEmpty() else some
    return nodes.groupBy("file_path", "qualified_name").agg(F.count("*").alias("n"))


def file_scores(nodes: DataFrame, least: int = 3) -> DataFrame:
    """file_path, score: 50 for a named node, 10 for an entry, 3 for a connected one, 1 for any other. nodes: file_path, is_named, is_entry, is_connected."""
    points = F.when(F.col("is_named"), 50).when(F.col("is_entry"), 10).when(F.col("is_connected"), 3).otherwise(1)
    return nodes.groupBy("file_path").agg(F.sum(points).alias("score")).where(F.col("score") >= least)


def cooccurrence(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """file_path, n: how many of the names (column name; case does not matter) each file has symbols of."""
    low = F.lower("name")
    wanted = names.select(low.alias("_low")).distinct()
    return nodes.join(wanted, low == F.col("_low"), "left_semi").groupBy("file_path").agg(F.countDistinct(low).alias("n"))


def polymorphic(edges: DataFrame, least: int = 3) -> DataFrame:
    """id, n: types that at least `least` others extend or implement."""
    e = edges.where(F.col("kind").isin("extends", "implements"))
    return e.groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("n")).where(F.col("n") >= least)


def children_of_containers(graph: Graph) -> DataFrame:
    """id, n: containers and the number of nodes they hold."""
    held = graph.edges.where("kind = 'contains'").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))
    return graph.nodes.where(F.col("kind").isin(*CONTAINER_KINDS)).select("id").join(held, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


