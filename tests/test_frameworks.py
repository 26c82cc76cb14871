"""Routes of web frameworks: which project uses which, what is found in its files, and what plug-ins of a user add."""

import json

from pyspark.sql import functions as F

from graphmill.api import SymbolGraph
from graphmill.operators import frameworks

JS = """const app = require('express')();
// app.get('/commented', gone);
app.get('/users', auth, users.list);
router.post("/users/:id",
  async (req, res) => { const u = await findUser(req.params.id, f("a)b")); if (u) { res.json(saveUser(u)); } saveUser(u); });
app.use('cors', x); app.use('/api', api);
const s = "app.get('/in a string', y)";
app.delete('/x', wrap(handler()))
app.get('/open', broken"""
PY = "urlpatterns = [\n    path('home/', views.home),\n    re_path(r'^a/$', views.About.as_view(template_name='x')),  # path('no/', v)\n    path('blog/', include('blog.urls')),\n    url('bare/', 3),\n]\nrouter.register(r'^things/$', api.ThingViewSet)\nadmin.register('x', Thing)\n"
JAVA = """@RestController
@RequestMapping("/api/")
public class Users {
    @GetMapping("/{id}")
    public String show(int id) {
        return "";
    }
    @PostMapping
    @Transactional
    public String create() {
        return "";
    }
    @RequestMapping(value = "/old", method = RequestMethod.PUT)
    public String old() {
        return "";
    }
}
"""


def test_routes(spark):
    from graphmill.sources import code

    files = spark.createDataFrame([("src/a.js", JS, "javascript"), ("urls.py", PY, "python"), ("U.java", JAVA, "java"), ("n.js", None, "javascript"), ("e.py", "", "python"), ("x.go", "app.get('/x', y)", "go"), ("src/a.js", JS, "javascript")], "path string, text string, language string")
    nodes = code.graph_of(code.extract(files))[0].nodes
    made, refs = frameworks.routes(files, nodes, frameworks.BUILT_IN)
    assert sorted(tuple(r) for r in made.select("name", "file_path", "start_line").collect()) == sorted([
        ("GET /users", "src/a.js", 3), ("POST /users/:id", "src/a.js", 4), ("USE /api", "src/a.js", 6), ("DELETE /x", "src/a.js", 8),
        ("home/", "urls.py", 2), ("^a/$", "urls.py", 3), ("blog/", "urls.py", 4), ("bare/", "urls.py", 5), ("VIEWSET /things", "urls.py", 7),
        ("GET /api/{id}", "U.java", 4), ("POST /api", "U.java", 8), ("PUT /api/old", "U.java", 13),
    ])
    assert sorted(tuple(r) for r in refs.select("ref_name", "ref_kind", "ref_line").collect()) == sorted([
        ("list", "references", 3), ("findUser", "calls", 4), ("f", "calls", 4), ("saveUser", "calls", 4), ("api", "references", 6),
        ("home", "references", 2), ("About", "references", 3), ("blog.urls", "imports", 4), ("ThingViewSet", "references", 7),
        ("show", "references", 4), ("create", "references", 8), ("old", "references", 13),
    ])
    assert [f.name for f in frameworks.detected(files.unionByName(spark.createDataFrame([("manage.py", "", "python"), ("package.json", '{"dependencies": {"koa": "1"}}', "config")], files.schema)))] == ["express", "django", "spring"]
    assert frameworks.detected(files.where("path = 'urls.py'")) == () == frameworks.detected(files.limit(0))
    assert frameworks.routes(files.limit(0), nodes, frameworks.BUILT_IN)[0].count() == 0


def test_targets(spark):
    nodes = spark.createDataFrame(
        [("1", "method", "show", "src/user.js", 3), ("2", "function", "show", "src/other.js", 1), ("3", "class", "PostController", "src/p.js", 1), ("4", "method", "save", "src/p.js", 2), ("5", "class", "HomeView", "a/x.py", 1), ("6", "class", "HomeView", "b/views/x.py", 1), ("7", "function", "LoginForm", "forms/x.py", 1), ("8", "class", "User", "m.py", 1)],
        "id string, kind string, name string, file_path string, start_line int",
    )
    refs = spark.createDataFrame([(1, "UserController.show", "javascript"), (2, "PostController.save", "javascript"), (3, "HomeView", "python"), (4, "LoginForm", "python"), (5, "User", "python"), (6, "NoController.show", "javascript"), (7, "app.urls", "python"), (8, None, "python")], "ref_id long, ref_name string, ref_language string")
    got = {}
    for _, f in frameworks.strategies(frameworks.BUILT_IN):
        got |= {r["ref_id"]: (r["target"], r["confidence"]) for r in f(refs, nodes).collect()}
    assert got == {1: ("1", 0.85), 2: ("4", 0.85), 3: ("6", 0.8), 5: ("8", 0.8)}
    assert [r["ref_id"] for r in frameworks.claimed(refs, frameworks.BUILT_IN).collect()] == [7]


def test_an_index_with_frameworks_of_its_own(spark, tmp_path):
    """The built-in ones through a whole index, and a user's that claims a name, resolves it, and puts what one file says before the routes of another."""
    (tmp_path / "routes").mkdir()
    (tmp_path / "package.json").write_text(json.dumps({"dependencies": {"express": "4"}}))
    (tmp_path / "routes" / "a.js").write_text("const app = require('express')();\nfunction listUsers(req, res) {\n  res.json([]);\n}\napp.get('/users', listUsers);\n")
    (tmp_path / "prefix.rb").write_text("# prefix /v1\n")
    (tmp_path / "main.rb").write_text("class Home\n  def run\n  end\nend\non '/home'\n")

    def found(files, nodes):
        return frameworks.calls_in(files, r"on '([^']+)'").select("file_path", "language", "line", F.lit("ON").alias("verb"), F.col("what").alias("url"), F.lit("magic!").alias("ref_name"), F.lit("references").alias("ref_kind"))

    def prefixed(routes, files):
        said = files.select(F.regexp_extract("text", r"# prefix (\S+)", 1).alias("_p")).where("_p != ''")
        return routes.crossJoin(said.limit(1)).withColumn("url", F.concat("_p", "url"))

    own = frameworks.Framework("own", ("ruby",), lambda p, t: p == "main.rb", found, lambda n: n == "magic!", lambda r, n: r.where("ref_name = 'magic!'").crossJoin(n.where("name = 'run'").select(F.col("id").alias("target")).limit(1)).select("ref_id", "target", F.lit(0.99).alias("confidence")), prefixed)
    g = SymbolGraph.index(spark, str(tmp_path), frameworks=(*frameworks.BUILT_IN, own)).graph
    names = {r["id"]: r["name"] for r in g.nodes.select("id", "name").collect()}
    edges = {(names[r["source"]], names[r["target"]], r["kind"]) for r in g.edges.where("source like 'route:%'").collect()}
    assert {("GET /users", "listUsers", "references"), ("ON /v1/home", "run", "references")} <= edges


def test_scripts_are_parsed_once(spark, capsys):
    files = spark.createDataFrame([("routes/a.js", "app.get('/a', list);\napp.post('/b', (q, r) => { save(q); });", "javascript")], "path string, text string, language string")
    frameworks._script_routes(files, None).explain()
    assert capsys.readouterr().out.count("MapInPandas") == 1
