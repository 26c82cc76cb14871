"""Import paths of small repositories, and an index that follows them."""

import pytest
from pyspark.sql import functions as F

from graphmill import store
from graphmill.api import SymbolGraph
from graphmill.operators import modules, resolve


def resolved(spark, asks, files, configs):
    imports = spark.createDataFrame(asks, "ref_file string, spec string, language string")
    files = spark.createDataFrame(files, "path string, language string")
    configs = spark.createDataFrame(configs, "path string, text string")
    return {(r["ref_file"], r["spec"]): (r["target_path"], r["kind"]) for r in modules.resolved(imports, files, configs).collect()}


def test_aliases(spark):
    config = """{
      /* "paths": no */ "compilerOptions": {"baseUrl": "./src", "paths": {
        "@/*": ["./*"], "@ui/*": ["ui/*", "../lib/ui/*"], "@ui/core/*": ["core/*"], "@ui/core/one": ["one.ts"], "*.css": ["styles/*.css"], "out/*": ["../../x/*"], } } }"""
    files = [(p, "typescript") for p in ("src/a.ts", "src/ui/b/index.ts", "lib/ui/c.ts", "src/core/d.ts", "src/one.ts", "src/core/one.ts", "web/z.ts", "src/styles/s.css", "x/y.ts", "src/a/index.ts")]
    got = resolved(spark, [("web/z.ts", s, "typescript") for s in ("@/a", "@ui/b", "@ui/c", "@ui/core/d", "@ui/core/one", "@ui/none", "s.css", "out/y", "react", "./q", "../src/a", "../../x/y")] + [("web/z.ts", "@/a", "python")], files, [("tsconfig.json", config)])
    assert {k[1]: v[0] for k, v in got.items()} == {"@/a": "src/a.ts", "@ui/b": "src/ui/b/index.ts", "@ui/c": "lib/ui/c.ts", "@ui/core/d": "src/core/d.ts", "@ui/core/one": "src/one.ts", "s.css": "src/styles/s.css", "../src/a": "src/a.ts"}


def test_rules_hold_for_their_folder_and_conventions_come_last(spark):
    files = [(p, "typescript") for p in ("app/one/src/m.ts", "app/two/other/m.ts", "src/m.ts", "src/deep/n.ts")]
    configs = [("app/one/tsconfig.json", '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}'), ("app/two/jsconfig.json", '{"compilerOptions": {"baseUrl": "other", "paths": {"@/*": ["*"]}}}')]
    got = resolved(spark, [(f, "@/m", "typescript") for f in ("app/one/x.ts", "app/two/x.ts", "x.ts")] + [("x.ts", "src/deep/n", "jsx"), ("x.ts", "src/m", "typescript")], files, configs)
    assert [got[f, "@/m"] for f in ("app/one/x.ts", "app/two/x.ts", "x.ts")] == [("app/one/src/m.ts", "alias"), ("app/two/other/m.ts", "alias"), ("src/m.ts", "convention")]
    assert got["x.ts", "src/deep/n"][0] == "src/deep/n.ts"


@pytest.mark.parametrize("root", ['{"workspaces": ["packages/*", "tools"]}', '{"workspaces": {"packages": ["packages/*", "tools"]}}', None])
def test_workspaces(spark, root):
    configs = [("packages/a/package.json", '{"name": "@s/ui"}'), ("packages/b/package.json", '{"name": "@s/ui/core"}'), ("tools/package.json", '{"name": "t"}'), ("far/away/package.json", '{"name": "far"}'), ("bad/package.json", "[")]
    configs.append(("package.json", root) if root else ("pnpm-workspace.yaml", "packages:\n  - 'packages/*'\n  - tools # here\n"))
    files = [(p, "typescript") for p in ("packages/a/index.ts", "packages/a/w.ts", "packages/b/index.ts", "packages/b/x.ts", "tools/t.ts", "far/away/index.ts")]
    got = resolved(spark, [("m.ts", s, "typescript") for s in ("@s/ui", "@s/ui/w", "@s/ui/core", "@s/ui/core/x", "t/t", "far", "@s/uix")], files, configs)
    assert {k[1]: v for k, v in got.items()} == {"@s/ui": ("packages/a/index.ts", "workspace"), "@s/ui/w": ("packages/a/w.ts", "workspace"), "@s/ui/core": ("packages/b/index.ts", "workspace"), "@s/ui/core/x": ("packages/b/x.ts", "workspace"), "t/t": ("tools/t.ts", "workspace")}


def test_go_crates_and_includes(spark):
    files = [("pkg/a/z.go", "go"), ("pkg/a/b.go", "go"), ("crates/k/src/m/mod.rs", "rust"), ("crates/k/src/n.rs", "rust"), ("lib/include/x/y.h", "c"), ("src/near.h", "c"), ("include/near.h", "c"), ("src/main.c", "c")]
    configs = [("go.mod", "module example.com/app // x\n"), ("crates/k/Cargo.toml", '[package]\nversion = "1"\nname = "my-crate"\n[dependencies]\nname = "no"\n')]
    asks = [("main.go", "example.com/app/pkg/a", "go"), ("main.go", "example.com/other", "go"), ("z.rs", "my_crate/m", "rust"), ("crates/k/src/q.rs", "crate/n", "rust"), ("z.rs", "crate/n", "rust"), ("src/main.c", "x/y.h", "cpp"), ("src/main.c", "near.h", "c"), ("other/o.c", "near.h", "c"), ("src/main.c", "stdio.h", "c")]
    got = resolved(spark, asks, files, configs)
    assert got == {
        ("main.go", "example.com/app/pkg/a"): ("pkg/a/b.go", "module"), ("z.rs", "my_crate/m"): ("crates/k/src/m/mod.rs", "crate"), ("crates/k/src/q.rs", "crate/n"): ("crates/k/src/n.rs", "crate"),
        ("src/main.c", "x/y.h"): ("lib/include/x/y.h", "include"), ("src/main.c", "near.h"): ("src/near.h", "relative"), ("other/o.c", "near.h"): ("src/near.h", "include"),
    }


def test_reexports_that_lead_in_a_circle(spark):
    wanted = spark.createDataFrame([(1, "a", "X"), (2, "a", "Y"), (3, "a", "Z"), (4, "a", "R")], "ref_id int, file_path string, name string")
    exports = spark.createDataFrame([("a", None, "b", None), ("b", None, "a", None), ("b", "X", "c", "Inner"), ("b", None, "d", None), ("d", "R", "d2", "S"), ("d2", "S", "d3", "T")], "file_path string, name string, from_path string, from_name string")
    declared = spark.createDataFrame([("c", "Inner", "n1"), ("d", "Y", "n2"), ("d", "X", "n3"), ("d3", "T", "n4")], "file_path string, name string, target string")
    assert {tuple(r) for r in resolve.chase_exports(wanted, exports, declared).collect()} == {(1, "n1"), (2, "n2"), (4, "n4")}
    assert {tuple(r) for r in resolve.chase_exports(wanted, exports, declared, depth=3).collect()} == {(1, "n1"), (2, "n2")}


def test_an_index_follows_aliases_packages_and_barrels(spark, tmp_path):
    texts = {
        "tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}', "package.json": '{"workspaces": ["packages/*"]}', "packages/ui/package.json": '{"name": "@s/ui"}',
        "packages/ui/index.ts": "export { Button as Knob } from './button'\nexport * from './more'\n", "packages/ui/button.ts": "export class Button {\n}\n", "packages/ui/more.ts": "export * from './deep'\n", "packages/ui/deep.ts": "export function deepest() {\n}\n",
        "src/util.ts": "export function helper() {\n}\n", "other/util.ts": "export function helper() {\n}\nexport function deepest() {\n}\nexport class Button {\n}\n",
        "app/main.ts": "import { helper } from '@/util'\nimport { Knob, deepest } from '@s/ui'\nfunction run() {\n  helper()\n  new Knob()\n  deepest()\n}\n",
    }
    for path, text in texts.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    g = SymbolGraph.index(spark, str(tmp_path)).graph
    place = g.nodes.select("id", F.concat_ws("#", "file_path", "name").alias("at"))
    e = store.settled(g.edges.where("kind in ('calls', 'instantiates')").join(place.toDF("source", "from"), "source").join(place.toDF("target", "to"), "target"))
    assert {(r["from"], r["to"]) for r in e.collect()} == {("app/main.ts#run", "src/util.ts#helper"), ("app/main.ts#run", "packages/ui/button.ts#Button"), ("app/main.ts#run", "packages/ui/deep.ts#deepest")}
    assert not g.nodes.where("file_path like '%json'").count()
