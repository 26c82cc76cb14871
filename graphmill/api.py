"""The facade: one object over a graph, from source files to answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill import store
from graphmill.functions.predicates import is_test, matches_symbol, name_glob, under
from graphmill.operators import analytics, boundaries, frameworks as web, modules, names, resolve, search, textindex, tools, traverse, walk
from graphmill.schema import Graph
from graphmill.sources import code, tree


class SymbolGraph:
    """Queries over nodes and edges. Every method gives a DataFrame, lazily where no loop is needed."""

    def __init__(self, graph: Graph, texts: textindex.TextIndex | None = None):
        self.graph, self.texts = graph, texts

    @classmethod
    def index(
        cls, spark: SparkSession, root: str, ignore: list[str] | None = None, resolvers: Sequence[tuple[str, names.Resolver]] = (), include_ignored: list[str] | None = None, extensions: dict[str, str] | None = None,
        frameworks: Sequence[web.Framework] = web.BUILT_IN,
    ) -> SymbolGraph:
        """Scan, extract and resolve a folder of source files. ignore: rules beside those of the ignore files; include_ignored: ignored folders whose repositories
        are read; extensions: languages of further endings. resolvers: further strategies by name. frameworks: those that are
        looked for; routes of the ones that the project uses become nodes, with references to what handles them."""
        scanned = store.settled(tree.scan_tree(spark, root, ignore, include_ignored, extensions, configs=True), "scanned")
        configs, files = scanned.where("language = 'config'").select("path", "text"), scanned.where("language != 'config'")
        extracted = store.settled(code.extract(files), "extracted")
        graph, refs = code.graph_of(extracted)
        using = web.detected(scanned, frameworks)
        routes, handled = web.routes(files, graph.nodes, using)
        refs = store.settled(refs.unionByName(handled), "refs")
        nodes = store.settled(graph.nodes.unionByName(routes, allowMissingColumns=True), "nodes")
        imports, exports = (store.settled(modules.with_files(f(extracted), files, configs), "imports") for f in (code.imports_of, code.exports_of))
        # A module is known by its file without the ending, however its path was written.
        bare = F.regexp_replace("target_path", r"(/(index|__init__|mod))?\.[^./]*$", "")
        imports = imports.withColumn("module", F.when(F.col("spec").isNotNull() & F.col("target_path").isNotNull(), bare).otherwise(F.col("module")))
        asked = store.settled(names.possible(names.without_built_ins(refs, nodes), nodes, imports).unionByName(web.claimed(refs, using)).distinct(), "asked")
        plugins = [("import", lambda r, n: names.by_import(r, n, imports)), ("import", lambda r, n: modules.by_reexport(r, n, imports, exports)), *web.strategies(using), *resolvers]
        types = store.settled(code.receiver_types(extracted, asked, nodes), "types")
        found = names.until_settled(asked, nodes, types, plugins)
        made = found.join(refs, "ref_id").where("from_id != target").select(
            F.col("from_id").alias("source"), "target", F.col("ref_kind").alias("kind"), F.col("ref_line").alias("line"),
            F.create_map(F.lit("confidence"), F.col("confidence").cast("string"), F.lit("resolvedBy"), F.col("resolved_by")).alias("metadata"),
        )
        edges = graph.edges.select("source", "target", "kind", "line").withColumn("metadata", F.lit(None).cast("map<string,string>")).unionByName(resolve.promoted(made, nodes))
        return cls(Graph(nodes, store.settled(edges, "edges")))

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> SymbolGraph:
        return cls(store.read(spark, folder), textindex.read(spark, f"{folder}/texts"))

    def save(self, folder: str) -> None:
        """The tables and the index of their texts, which `open` searches instead of the texts."""
        store.write(self.graph, folder)
        textindex.write(self.graph.nodes, f"{folder}/texts")

    def stats(self) -> dict[str, DataFrame]:
        return {"nodes": analytics.counts(self.graph.nodes, "kind"), "edges": analytics.counts(self.graph.edges, "kind"), "files": analytics.counts(analytics.files_of(self.graph), "language")}

    def node(self, *ids: str) -> DataFrame:
        return self.graph.nodes.where(F.col("id").isin(*ids))

    def nodes_in_file(self, path: str) -> DataFrame:
        return self.graph.nodes.where(F.col("file_path") == path).orderBy("start_line", "id")

    def nodes_by_kind(self, kind: str) -> DataFrame:
        return self.graph.nodes.where(F.col("kind") == kind)

    def by_qualified_name(self, pattern: str) -> DataFrame:
        return self.graph.nodes.where(F.col("qualified_name").rlike(name_glob(pattern)))

    def symbols(self, name: str) -> DataFrame:
        return self.graph.nodes.where(matches_symbol(name))

    def definitions(self, symbol: str, file_part: str | None = None, line: int | None = None) -> DataFrame:
        """What a symbol's name means, generated files last; narrowed by a part of the path, then by a line."""
        found = tools.symbols(self.graph.nodes, symbol, file_part)
        return found if line is None else tools.at_line(found, line)

    def callers_of(self, symbol: str, limit: int = 20) -> DataFrame:
        """Callers of each definition of a symbol, with what kind of use it is."""
        return tools.neighbours(self.graph, self.definitions(symbol), "in", max(1, min(limit, 100)))

    def callees_of(self, symbol: str, limit: int = 20) -> DataFrame:
        return tools.neighbours(self.graph, self.definitions(symbol), "out", max(1, min(limit, 100)))

    def trail(self, symbol: str) -> DataFrame:
        return tools.trail(self.graph, self.definitions(symbol))

    def outline(self, symbol: str) -> DataFrame:
        return tools.outline(self.graph, self.definitions(symbol))

    def search(self, query: str, limit: int = 100) -> DataFrame:
        return search.search(self.graph.nodes, query, max(1, min(limit, 100)), self.texts)

    def completions(self, prefix: str, most: int = 20) -> DataFrame:
        """Words of symbols that begin with prefix; of a saved graph."""
        if self.texts is None:
            raise ValueError("save the graph and open it: its index has the words")
        return textindex.completions(self.texts, prefix, most)

    def boundaries(self, files: DataFrame) -> DataFrame:
        """Calls in the functions' texts that cannot be followed by names. files: path, text, language."""
        scopes = self.graph.nodes.where(F.col("kind").isin("function", "method")).select(F.col("id").alias("scope"), "file_path", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
        return boundaries.boundaries(files, scopes)

    def components(self) -> DataFrame:
        """Files by the group of files that all depend on each other."""
        return traverse.components(traverse.file_graph(self.graph).toDF("at", "to"))

    def relevant(self, query: str, limit: int = 20) -> DataFrame:
        return search.relevant(self.graph, query, limit)

    def files(self, prefix: str = "") -> DataFrame:
        return analytics.files_of(self.graph).where(under(F.col("path"), prefix)).orderBy("path")

    def callers(self, node: str, depth: int = 1) -> DataFrame:
        return traverse.callers(self.graph, node, max(1, min(depth, 10)))

    def callees(self, node: str, depth: int = 1) -> DataFrame:
        return traverse.callees(self.graph, node, max(1, min(depth, 10)))

    def usages(self, node: str) -> DataFrame:
        return traverse.usages(self.graph, node)

    def impact(self, node: str, depth: int = 3) -> DataFrame:
        return traverse.impact(self.graph, node, max(1, min(depth, 10)))

    def path(self, a: str, b: str) -> list[str] | None:
        return traverse.shortest_path(self.graph, a, b)

    def hierarchy(self, node: str, direction: str = "both") -> DataFrame:
        return traverse.type_hierarchy(self.graph, node, direction)

    def ancestors(self, node: str) -> DataFrame:
        return traverse.ancestors(self.graph, node)

    def children(self, node: str) -> DataFrame:
        return traverse.children(self.graph, node)

    def context(self, node: str) -> DataFrame:
        return traverse.context(self.graph, node)

    def file_dependencies(self) -> DataFrame:
        return traverse.file_graph(self.graph)

    def circular_files(self) -> DataFrame:
        return traverse.cyclic(traverse.file_graph(self.graph).toDF("at", "to"))

    def affected_tests(self, changed: list[str]) -> DataFrame:
        spark = self.graph.nodes.sparkSession
        return traverse.affected_files(traverse.file_graph(self.graph), spark.createDataFrame([(c,) for c in changed], "id string"), is_test(F.col("id")))

    def dead_code(self) -> DataFrame:
        return analytics.dead_code(self.graph)

    def metrics(self) -> DataFrame:
        return analytics.node_metrics(self.graph).join(analytics.depths(self.graph), "id", "left")

    def filtered(self, predicate: F.Column) -> Graph:
        """The nodes that a column predicate (or a user's function) keeps, and the edges between them."""
        nodes = self.graph.nodes.where(predicate)
        return Graph(nodes, traverse.induced(self.graph.edges, nodes.select("id")))

    def relevance(self, seeds: list[str]) -> DataFrame:
        return walk.walk_with_restart(self.graph.edges, self.graph.nodes, self.graph.nodes.where(F.col("id").isin(*seeds)))
