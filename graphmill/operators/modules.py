"""What the paths of imports stand for: aliases, workspace packages, Go modules, crates and include folders, met by their longest prefix."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.lexer import without_comments
from graphmill.operators.intervals import top_per_group

SCRIPTS = ("typescript", "javascript", "tsx", "jsx", "vue", "svelte", "astro")
#: Files that say what import paths stand for.
CONFIGS = ("tsconfig.json", "jsconfig.json", "package.json", "pnpm-workspace.yaml", "go.mod", "Cargo.toml")
# What may follow a path to make a file of it, in order; "" is the path itself.
ENDINGS = {
    "script": (".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".svelte", ".vue", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.svelte", ""),
    "python": (".py", "/__init__.py", ""), "rust": (".rs", "/mod.rs", "/lib.rs", ""), "c": ("", ".h", ".hpp"), "go": ("",),
}
# Prefixes that stand for folders where no config says so.
CONVENTIONS = (("@/", "src/"), ("~/", "src/"), ("@src/", "src/"), ("src/", "src/"), ("@app/", "app/"), ("app/", "app/"))
INCLUDE_FOLDERS = ("include", "inc", "src")
#: Order of the kinds of rules: the first kind that fits decides.
KINDS = ("alias", "workspace", "module", "crate", "include", "convention")
RULES = "kind string, family string, scope string, prefix string, suffix string, wild boolean, replacement string, pick int"


def family(language: F.Column) -> F.Column:
    """The languages that share rules."""
    return F.when(language.isin(*SCRIPTS), "script").when(language.isin("c", "cpp", "objc", "objcpp"), "c").otherwise(language)


def _json(text: str) -> dict:
    """JSON that may have comments and commas before a closing bracket."""
    plain = re.sub(r",(\s*[}\]])", r"\1", without_comments(text, "java"))
    out = json.loads(plain)
    return out if isinstance(out, dict) else {}


def _said(path: str, text: str) -> Iterator[tuple]:
    """(what, kind, family, scope, prefix, suffix, wild, replacement, pick) of one config. what: rule, glob (replacement: a folder with packages) or package."""
    folder, name = posixpath.split(path)
    under = lambda *p: posixpath.normpath(posixpath.join(folder, *p)).removeprefix("./")
    here = folder + "/" if folder else ""
    if name in ("tsconfig.json", "jsconfig.json"):
        options = _json(text).get("compilerOptions") or {}
        for pattern, targets in (options.get("paths") or {}).items():
            prefix, star, suffix = pattern.partition("*")
            for pick, target in enumerate(targets if isinstance(targets, list) else ()):
                to = under(options.get("baseUrl") or ".", target)
                if not to.startswith(".."):
                    yield "rule", "alias", "script", here, prefix, suffix, bool(star), to, pick
    elif name == "package.json":
        said = _json(text)
        globs = said.get("workspaces")
        globs = globs.get("packages") if isinstance(globs, dict) else globs
        for glob in globs if isinstance(globs, list) else ():
            yield "glob", None, None, None, None, None, glob.rstrip("/").endswith("*"), under(re.sub(r"/\*+$", "", glob.rstrip("/"))), None
        if isinstance(said.get("name"), str) and folder:
            yield "package", None, None, posixpath.dirname(folder), said["name"], None, None, folder, None
    elif name == "pnpm-workspace.yaml":
        for glob in re.findall(r"^\s*-\s*['\"]?([^'\"\s#]+)", text, re.M):
            yield "glob", None, None, None, None, None, glob.endswith("*"), under(re.sub(r"/\*+$", "", glob)), None
    elif name == "go.mod" and (m := re.search(r"^\s*module\s+\"?([^\s\"]+)", text, re.M)):
        yield "rule", "module", "go", "", m[1], "", False, folder, 0
        yield "rule", "module", "go", "", m[1] + "/", "", True, under("*"), 0
    elif name == "Cargo.toml" and (m := re.search(r"\[package\][^\[]*?^\s*name\s*=\s*\"([^\"]+)\"", text, re.M | re.S)):
        crate = m[1].replace("-", "_")
        yield "rule", "crate", "rust", "", crate, "", False, under("src"), 0
        yield "rule", "crate", "rust", "", crate + "/", "", True, under("src/*"), 0
        yield "rule", "crate", "rust", here, "crate/", "", True, under("src/*"), 0


def rules(configs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """RULES that config files (path, text) give: those of tsconfig and jsconfig (for files of their folder), packages of workspaces, go.mod and Cargo.toml; for C the
    include folders that files (path) have; and conventions. A config that cannot be read gives none."""
    schema = f"what string, {RULES}"
    columns = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"]):
                try:
                    rows += list(_said(path, text or ""))
                except (ValueError, AttributeError, TypeError):
                    continue
            yield pd.DataFrame(rows, columns=columns).astype({"wild": "boolean", "pick": "Int32"})

    spark = configs.sparkSession
    said = configs.where(F.element_at(F.split("path", "/"), -1).isin(*CONFIGS)).select("path", "text").mapInPandas(run, schema)
    names = [c.split(" ")[0] for c in RULES.split(", ")]
    globs = said.where("what = 'glob'").select("wild", "replacement").distinct()
    packages = said.where("what = 'package'").select("prefix", F.col("scope").alias("above"), F.col("replacement").alias("folder"))
    members = packages.join(globs.where("wild").select(F.col("replacement").alias("above")), "above", "left_semi").unionByName(packages.join(globs.where("not wild").select(F.col("replacement").alias("folder")), "folder", "left_semi"))
    whole = lambda prefix, wild, to: members.select(F.lit("workspace"), F.lit("script"), F.lit(""), prefix, F.lit(""), F.lit(wild), to, F.lit(0))
    out = said.where("what = 'rule'").select(*names).union(whole(F.col("prefix"), False, F.col("folder"))).union(whole(F.concat("prefix", F.lit("/")), True, F.concat("folder", F.lit("/*"))))
    out = out.union(spark.createDataFrame([("convention", "script", "", a, "", True, z + "*", 0) for a, z in CONVENTIONS] + [("convention", f, "", "", "", True, "*", 9) for f in ENDINGS], RULES))
    if files is not None:
        folder = F.regexp_extract("path", r"^((?:.*/)?(?:" + "|".join(INCLUDE_FOLDERS) + r"))/", 1)
        found = files.where(family(F.col("language")) == "c").select(folder.alias("folder")).where("folder != ''").distinct()
        out = out.union(found.select(F.lit("include"), F.lit("c"), F.lit(""), F.lit(""), F.lit(""), F.lit(True), F.concat("folder", F.lit("/*")), F.length("folder")))
    return out


def rewritten(imports: DataFrame, rules: DataFrame) -> DataFrame:
    """ref_file, spec, family, kind, rank, path: what the best rule of each kind makes of each import path; where kinds are several, rank tells their order, and that of a
    rule's own replacements. imports: ref_file, spec, language.

    A path is listed once with each beginning that is as long as some rule's prefix (the lengths are few, whatever the number of rules), and met
    by equality; of the rules that fit, the one of the nearest folder, then of the longest prefix, then without a wild card, counts.
    """
    lengths = [r[0] for r in rules.select(F.length("prefix")).distinct().collect()]
    asked = imports.select("ref_file", "spec", family(F.col("language")).alias("family")).distinct()
    begins = asked.withColumn("_n", F.explode(F.array(*map(F.lit, sorted(lengths))).cast("array<int>"))).where(F.length("spec") >= F.col("_n")).withColumn("prefix", F.expr("left(spec, _n)"))
    met = begins.join(rules, ["family", "prefix"]).where(F.startswith("ref_file", "scope"))
    fits = F.when(F.col("wild"), (F.length("spec") >= F.col("_n") + F.length("suffix")) & F.endswith("spec", "suffix")).otherwise(F.length("spec") == F.col("_n"))
    met = met.where(fits).withColumn("path", F.when(F.col("wild"), F.expr("replace(replacement, '*', substring(spec, _n + 1, length(spec) - _n - length(suffix)))")).otherwise(F.col("replacement")))
    met = met.withColumn("_kind", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")))
    best = F.rank().over(Window.partitionBy("ref_file", "spec", "family", "kind").orderBy(F.desc(F.length("scope")), F.desc("_n"), "wild"))
    met = met.withColumn("_best", best).where((F.col("_best") == 1) | F.col("kind").isin("include", "convention"))
    order = F.row_number().over(Window.partitionBy("ref_file", "spec", "family").orderBy("_kind", F.when(F.col("kind") == "convention", -F.col("_n")).otherwise(0), "pick", "path"))
    return met.withColumn("rank", order).select("ref_file", "spec", "family", "kind", "rank", "path")


def relative(imports: DataFrame) -> DataFrame:
    """ref_file, spec, family, kind, rank, path of the import paths that begin with a dot, and of C's, which first mean a file beside the one that asks."""
    asked = imports.select("ref_file", "spec", family(F.col("language")).alias("family")).distinct()
    near = asked.where(((F.col("family") == "script") & F.startswith("spec", F.lit("."))) | (F.col("family") == "c"))
    parts = F.filter(F.split(F.concat(F.regexp_extract("ref_file", "^(.*/)?", 0), "spec"), "/"), lambda x: (x != "") & (x != "."))
    # `..` takes away the part before it; a path that leads out of the root is none.
    step = lambda a, x: F.when(x != "..", F.array_append(a, x)).when(F.size(a) > 0, F.slice(a, 1, F.size(a) - 1)).otherwise(F.lit(None).cast("array<string>"))
    path = F.aggregate(parts, F.array().cast("array<string>"), step)
    return near.withColumn("_p", path).where("_p is not null").select("ref_file", "spec", "family", F.lit("relative").alias("kind"), F.lit(0).alias("rank"), F.array_join("_p", "/").alias("path"))


def found_files(paths: DataFrame, files: DataFrame) -> DataFrame:
    """ref_file, spec, kind, target_path, confidence: the first file that a path stands for, in order of rank, then of its language's endings; for Go, the first
    file of the folder. Confidence: C beside 0.92, else 0.9. files: path, language."""
    known = files.select("path", family(F.col("language")).alias("family"))
    ends = F.create_map(*(x for k, v in ENDINGS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    tried = known.select("path", "family", F.posexplode(F.coalesce(ends[F.col("family")], F.array(F.lit("")))).alias("_end", "_ending")).where(F.endswith("path", "_ending"))
    stems = tried.select("family", F.col("path").alias("target_path"), "_end", F.expr("left(path, length(path) - length(_ending))").alias("path"))
    folders = known.where("family = 'go'").groupBy("family", F.regexp_replace("path", "/?[^/]*$", "").alias("path")).agg(F.min("path").alias("target_path")).select("family", "target_path", F.lit(-1).alias("_end"), "path")
    met = paths.join(stems.unionByName(folders), ["family", "path"]).where("target_path != ref_file")
    best = top_per_group(met, ["ref_file", "spec"], ["rank", "_end", "target_path"], 1)
    sure = F.when((F.col("family") == "c") & (F.col("kind") == "relative"), 0.92).otherwise(0.9)
    return best.select("ref_file", "spec", "kind", "target_path", sure.alias("confidence"))


def resolved(imports: DataFrame, files: DataFrame, configs: DataFrame) -> DataFrame:
    """found_files of all import paths: relative ones first, then the rules of configs."""
    return found_files(relative(imports).unionByName(rewritten(imports, rules(configs, files)).withColumn("rank", F.col("rank").cast("int"))), files)


def with_files(said: DataFrame, files: DataFrame, configs: DataFrame) -> DataFrame:
    """said (ref_file, module, language, spec) with target_path: the file of each module, by its path or (where spec is given) by the rules of configs; null if none is known."""
    plain = said.where("spec is null").select("ref_file", F.col("module").alias("spec"), family(F.col("language")).alias("family"), F.lit("relative").alias("kind"), F.lit(0).alias("rank"), F.col("module").alias("path")).distinct()
    ruled = rewritten(said.where("spec is not null").select("ref_file", "spec", "language"), rules(configs, files)).withColumn("rank", F.col("rank").cast("int"))
    known = found_files(plain.unionByName(ruled), files).select("ref_file", F.col("spec").alias("module"), "target_path")
    return said.join(known, ["ref_file", "module"], "left")


def by_reexport(refs: DataFrame, nodes: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """ref_id, target, confidence of names whose import leads to a file that declares them, or passes them on from others that do; 0.9.
    imports, exports: as code.imports_of and exports_of give them, with_files."""
    from graphmill.operators.resolve import chase_exports

    local = refs.select("ref_id", "ref_file", F.substring_index("ref_name", ".", 1).alias("local"))
    wanted = local.join(imports.where("exported is not null and target_path is not null"), ["ref_file", "local"]).select("ref_id", F.col("target_path").alias("file_path"), F.col("exported").alias("name"))
    passed = exports.where("target_path is not null").select(F.col("ref_file").alias("file_path"), "name", F.col("target_path").alias("from_path"), "from_name")
    declared = nodes.where("kind != 'file'").groupBy("file_path", F.col("qualified_name").alias("name")).agg(F.min("id").alias("target"))
    return chase_exports(wanted, passed, declared).select("ref_id", "target", F.lit(0.9).alias("confidence"))
