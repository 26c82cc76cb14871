"""From source files to a resolved graph: imports, receivers, supertypes and names left alone."""

import pytest
from pyspark.sql import Row

from graphmill.api import SymbolGraph
from graphmill.operators import names

FILES = {
    "pkg/util.py": "def helper(x):\n    return x\n\n\nclass Tool:\n    def run(self):\n        return helper(1)\n",
    "pkg/other.py": "def helper(x):\n    return -x\n",
    "app/main.py": "from pkg.util import helper as h, Tool\nimport pkg.util as u\nfrom .part import piece\n\n\ndef start(items):\n    tool = Tool()\n    tool.run()\n    items.append(h(2))\n    u.helper(3)\n    piece()\n    print(len(items))\n",
    "app/part.py": "def piece():\n    return 0\n",
    "web/a.ts": "export function draw() {\n  return 1\n}\n",
    "web/b.ts": "import { draw as paint } from './a'\nexport function page() {\n  return paint()\n}\n",
}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("src")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return SymbolGraph.index(spark, str(root))


def edges(g):
    n = g.graph.nodes
    e = g.graph.edges.where("kind != 'contains'").join(n.selectExpr("id as source", "name as a"), "source").join(n.selectExpr("id as target", "name as b", "file_path as f"), "target")
    return {(r.a, r.kind, r.b, r.f): r.metadata["resolvedBy"] for r in e.collect()}


def test_index(graph):
    got = edges(graph)
    assert got[("start", "calls", "helper", "pkg/util.py")] == "import"
    assert got[("start", "calls", "piece", "app/part.py")] == "import"
    assert got[("start", "instantiates", "Tool", "pkg/util.py")] == "import"
    assert got[("start", "calls", "run", "pkg/util.py")] == "receiver"
    assert got[("page", "calls", "draw", "web/a.ts")] == "import"
    assert ("start", "calls", "helper", "pkg/other.py") not in got
    assert not [k for k in got if k[2] in ("append", "print", "len")]


def test_symbol_tools(graph):
    names_of = lambda df: {r["name"] for r in df.join(graph.graph.nodes.select("id", "name"), "id").collect()}
    assert [r.file_path for r in graph.definitions("helper").orderBy("rank").collect()] == ["pkg/other.py", "pkg/util.py"]
    assert [r.file_path for r in graph.definitions("helper", file_part="UTIL").collect()] == ["pkg/util.py"]
    assert [r.name for r in graph.definitions("run", line=2).collect()] == ["run"]
    assert names_of(graph.callers_of("helper")) == {"start", "run", "main.py"}  # the file imports it
    assert {"helper", "Tool", "piece", "run"} <= names_of(graph.callees_of("start"))
    assert [r["name"] for r in graph.outline("Tool").collect()] == ["run"]
    assert {r.role for r in graph.trail("run").collect()} == {"caller", "callee"}


def test_saved_graph_reads_back(graph, spark, tmp_path):
    graph.save(str(tmp_path / "g"))
    assert SymbolGraph.open(spark, str(tmp_path / "g")).graph.nodes.count() == graph.graph.nodes.count()


def test_methods_of_supertypes(spark):
    node = lambda i, q, lang="java", kind="method", ret=None: Row(id=i, kind=kind, name=q.split("::")[-1], qualified_name=q, file_path="a.x", language=lang, start_line=1, is_exported=True, return_type=ret)
    nodes = spark.createDataFrame([node("m", "p::Base::run"), node("f", "p::Maker::make", ret="Sub"), node("o", "p::Other::run"), node("k", "Own::go", "kotlin")], "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, is_exported boolean, return_type string")
    refs = spark.createDataFrame([(1, "Maker.make().run", "calls", "b.x", 1, "java"), (2, "Own().go", "calls", "b.x", 1, "kotlin"), (3, None, "calls", None, None, None)], "ref_id long, ref_name string, ref_kind string, ref_file string, ref_line int, ref_language string")
    supers = spark.createDataFrame([("Sub", "Mid"), ("Mid", "Base"), ("Base", "Sub")], "sub string, super string")
    assert {(r.ref_id, r.target) for r in names.by_chain(refs, nodes).collect()} == {(2, "k")}
    assert {(r.ref_id, r.target) for r in names.by_chain(refs, nodes, supers).collect()} == {(1, "m"), (2, "k")}


def test_nothing_to_resolve(spark, graph):
    none = spark.createDataFrame([], "ref_id long, ref_name string, ref_kind string, ref_file string, ref_line int, ref_language string, from_id string")
    nodes = graph.graph.nodes
    assert names.cascade(none, nodes).count() == 0
    assert names.possible(none, nodes.limit(0)).count() == 0


def test_receivers_of_known_types_and_inherited_methods(spark, tmp_path):
    texts = {
        "lib/base.py": "class Base:\n    def run(self):\n        return 1\n\n    def stop(self):\n        return 2\n",
        "lib/mid.py": "from lib.base import Base\n\n\nclass Mid(Base):\n    def stop(self):\n        return 3\n",
        "lib/decoy.py": "class Decoy:\n    def run(self):\n        return 0\n\n    def stop(self):\n        return 0\n",
        "app/use.py": (
            "from lib.mid import Mid\n\n\nclass Holder:\n    def __init__(self, first: Mid):\n        self.kept = Mid()\n\n    def go(self):\n        self.kept.run()\n\n\ndef typed(x: 'Mid | None', y: Mid | None):\n    y.run()\n    y.stop()\n\n\n"
            "def local():\n    z = Mid()\n    z.run()\n\n\ndef make() -> Mid:\n    return Mid()\n"
        ),
        "web/shapes.ts": "export class Shape {\n}\nexport interface Drawn {\n}\nexport class Box extends Shape implements Drawn {\n}\n",
    }
    for path, text in texts.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    g = SymbolGraph.index(spark, str(tmp_path))
    got = edges(g)
    for caller, method, file in (("go", "run", "lib/base.py"), ("typed", "run", "lib/base.py"), ("typed", "stop", "lib/mid.py"), ("local", "run", "lib/base.py")):
        assert (caller, "calls", method, file) in got and (caller, "calls", method, "lib/decoy.py") not in got, (caller, method)
    assert ("Mid", "extends", "Base", "lib/base.py") in got
    assert ("Box", "extends", "Shape", "web/shapes.ts") in got and ("Box", "implements", "Drawn", "web/shapes.ts") in got
    assert {r["return_type"] for r in g.graph.nodes.where("name = 'make'").collect()} == {"Mid"}
