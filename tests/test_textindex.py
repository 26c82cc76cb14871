"""The stored index of symbols' texts against reading every text."""

import contextlib
import io

from graphmill.api import SymbolGraph
from graphmill.operators import search, textindex
from graphmill.schema import Graph

NODES = [
    ("1", "UserService", "app::UserService", "serves users", "class UserService", "class", "python", "a/user.py", 1),
    ("2", "load_user", "app::load_user", None, "def load_user(id)", "function", "python", "a/user.py", 9), ("3", "X", "app::X", "", None, "class", "go", "b/x.go", 1), ("4", None, None, None, None, "variable", "go", "b/x.go", 2),
    ("5", "users users user", "q::users", "the user of users", "uses", "function", "go", "c.go", 1), ("6", "Service", "app::Service", "x" * 5000, "s", "interface", "go", "c.go", 4),
]
COLUMNS = "id string, name string, qualified_name string, docstring string, signature string, kind string, language string, file_path string, start_line int"


def opened(spark, tmp_path, nodes):
    edges = spark.createDataFrame([("2", "1", "calls", 9)], "source string, target string, kind string, line int")
    SymbolGraph(Graph(nodes, edges)).save(f"file://{tmp_path}/g")
    return SymbolGraph.open(spark, f"file://{tmp_path}/g")


def rounded(df):
    return sorted((r["id"], round(r["score"], 9)) for r in df.select("id", "score").collect())


def test_scores_are_those_of_reading_all_texts(spark, tmp_path):
    nodes = spark.createDataFrame(NODES, COLUMNS).repartition(3)
    g = opened(spark, tmp_path, nodes)
    for query in ("user", "u", "service load", "serv us", "nothing", "user user"):
        assert rounded(textindex.full_text(g.texts, query)) == rounded(search.full_text(nodes, query)), query
    assert {r["id"] for r in g.search("user kind:function").collect()} == {"2", "5"}
    assert [tuple(r) for r in g.completions("us").collect()] == [("user", 5), ("users", 4), ("userservice", 3), ("uses", 1)]



def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_a_prefix_reads_one_folder_and_a_range_of_terms(spark, tmp_path):
    g = opened(spark, tmp_path, spark.createDataFrame(NODES, COLUMNS))
    text = plan(textindex.with_prefix(g.texts.postings, "user"))
    assert "PartitionFilters: [isnotnull(shelf" in text and "(shelf" in text and "= us)" in text and "StringStartsWith(term,user)" in text
    files = textindex.with_prefix(g.texts.postings, "user").inputFiles()
    assert files and len(files) <= len(g.texts.postings.inputFiles())
    assert "StartsWith(shelf" in plan(textindex.with_prefix(g.texts.postings, "u"))


def test_an_index_of_nothing(spark, tmp_path):
    nodes = spark.createDataFrame([], COLUMNS)
    textindex.write(nodes, f"file://{tmp_path}/none")
    assert textindex.full_text(textindex.read(spark, f"file://{tmp_path}/none"), "user").count() == 0


def test_writing_an_index_reads_nodes_once_and_counts_repeated_words(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    nodes = spark.createDataFrame([(f"n{i}", f"alpha b{i} alpha" if i % 7 == 0 else f"alpha c{i}", "" if i % 2 else None) for i in range(300)], "id string, name string, docstring string")
    textindex.write(nodes.repartition(3).mapInArrow(counted, nodes.schema), f"file://{tmp_path}/once")
    assert seen.value == 300
    index = textindex.read(spark, f"file://{tmp_path}/once")
    got = {(r["term"], r["id"], r["tf"], r["len"]) for r in index.postings.collect()}
    assert got == {x for i in range(300) for x in ([("alpha", f"n{i}", 2, 3), (f"b{i}", f"n{i}", 1, 3)] if i % 7 == 0 else [("alpha", f"n{i}", 1, 2), (f"c{i}", f"n{i}", 1, 2)])}
    assert index.postings.count() == 600 and {tuple(r) for r in index.fields.collect()} == {("name", 300, 643), ("docstring", 300, 0)}
