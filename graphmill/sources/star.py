"""Graph views of relational tables, and of documents, pages and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.schema import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> F.Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """region and nation as modules and namespaces, customers as classes, suppliers as structs, parts as interfaces, orders
    as methods. contains: down the hierarchy; calls: order to part (a row a line) and order to the customer's order before;
    references: order to supplier (a row a line)."""
    t = lambda name: table(spark, sf_dir, name)
    place = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")

    def nodes(df: DataFrame, kind: str, key: str, name: F.Column, qualified: F.Column, path: F.Column, language: str, exported: F.Column) -> DataFrame:
        line = F.col(key).cast("int")
        return df.select(_id(kind, key).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), qualified.alias("qualified_name"), path.alias("file_path"), F.lit(language).alias("language"), line.alias("start_line"), (line + 4).alias("end_line"), exported.alias("is_exported"))

    c, lit = F.col, F.lit
    src = lambda leaf: F.concat(lit("src/"), c("r_name"), lit("/"), c("n_name"), lit(f"/{leaf}.x"))
    customers = t("customer").join(F.broadcast(place), c("c_nationkey") == c("n_nationkey"))
    suppliers = t("supplier").join(F.broadcast(place), c("s_nationkey") == c("n_nationkey"))
    orders = t("orders").join(customers.select("c_custkey", "c_name", "n_name", "r_name"), c("o_custkey") == c("c_custkey"))
    name = F.concat(lit("order_"), c("o_orderkey").cast("string"))
    every = [
        nodes(t("region"), "module", "r_regionkey", c("r_name"), c("r_name"), F.concat(lit("src/"), c("r_name"), lit(".x")), "sql", lit(True)),
        nodes(place, "namespace", "n_nationkey", c("n_name"), F.concat_ws("::", "r_name", "n_name"), src("nation"), "sql", lit(True)),
        nodes(customers, "class", "c_custkey", c("c_name"), F.concat_ws("::", "r_name", "n_name", "c_name"), src("customer"), "java", c("c_acctbal") > 0),
        nodes(suppliers, "struct", "s_suppkey", c("s_name"), F.concat_ws("::", "r_name", "n_name", "s_name"), src("supplier"), "go", c("s_acctbal") > 0),
        nodes(t("part"), "interface", "p_partkey", c("p_name"), F.concat_ws("::", "p_brand", "p_name"), F.concat(lit("src/parts/"), c("p_brand"), lit(".x")), "java", c("p_size") > 25),
        nodes(orders, "method", "o_orderkey", name, F.concat_ws("::", c("r_name"), c("n_name"), c("c_name"), name), src("orders"), "java", c("o_orderstatus") == "F"),
    ]
    edge = lambda df, a, b, kind, line: df.select(a.alias("source"), b.alias("target"), lit(kind).alias("kind"), line.cast("int").alias("line"))
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    chain = t("orders").select("o_orderkey", before.alias("previous")).where("previous is not null")
    edges = [
        edge(t("nation"), _id("module", "n_regionkey"), _id("namespace", "n_nationkey"), "contains", lit(0)),
        edge(t("customer"), _id("namespace", "c_nationkey"), _id("class", "c_custkey"), "contains", lit(0)),
        edge(t("supplier"), _id("namespace", "s_nationkey"), _id("struct", "s_suppkey"), "contains", lit(0)),
        edge(t("orders"), _id("class", "o_custkey"), _id("method", "o_orderkey"), "contains", lit(0)),
        edge(t("lineitem"), _id("method", "l_orderkey"), _id("interface", "l_partkey"), "calls", c("l_linenumber")),
        edge(chain, _id("method", "o_orderkey"), _id("method", "previous"), "calls", lit(0)),
        edge(t("lineitem"), _id("method", "l_orderkey"), _id("struct", "l_suppkey"), "references", c("l_linenumber")),
    ]
    return Graph(reduce(DataFrame.unionByName, every), reduce(DataFrame.unionByName, edges))


def nation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, n: each nation, as a file, depends on the nation most of its customers' lines are supplied from (ties: smaller key)."""
    t = lambda name: table(spark, sf_dir, name)
    pairs = (
        t("lineitem").select("l_orderkey", "l_suppkey")
        .join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("a")), "o_custkey")
        .join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("b")), "l_suppkey")
        .where("a != b").groupBy("a", "b").agg(F.count("*").alias("n"))
    )
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))
    return pairs.withColumn("nth", nth).where("nth = 1").select(F.col("a").alias("source"), F.col("b").alias("target"), "n")


def transition_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, n: event types that follow each other for one user."""
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), after.alias("target")).where("target is not null").groupBy("source", "target").agg(F.count("*").alias("n"))


def document_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, file_path, language: documents as files, some with the names of tests and generated files."""
    ends = F.element_at(F.array(*(F.lit(x) for x in ("_test.go", ".pb.go", ".test.ts", "Test.java", "_pb2.py", ".x", ".py"))), (F.pmod("doc_id", F.lit(7)) + 1).cast("int"))
    folders = F.element_at(F.array(*(F.lit(x) for x in ("src", "tests", "lib", "examples", "jvmTest"))), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    path = F.concat(folders, F.lit("/"), "lang", F.lit("/"), "source", F.lit("/Doc"), F.col("doc_id").cast("string"), ends)
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("file_path"), F.col("lang").alias("language"))


def page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, position, name: the links of each page as references to be resolved by name."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("position", "name")).where("name != ''")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(disk, index) of documents as path, hash, size: one in ten is new on disk, one in eleven gone from it, one in seven edited."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), "text")
    disk = docs.where("doc_id % 11 != 0").select("path", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    index = docs.where("doc_id % 10 != 0").select("path", F.md5("text").alias("hash"))
    return disk, index


def symbols(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and references as source code would give them. Suppliers are classes with a method for each group of parts they sold,
    parts are functions, documents are files; an order refers to one of them, in one of twelve forms."""
    t = lambda name: table(spark, sf_dir, name)
    text = lambda template, **v: F.concat(*(x for i, part in enumerate(template.split("@")) for x in ((v[part].cast("string"),) if i % 2 else (F.lit(part),))))
    pick = lambda n, *of: F.element_at(F.array(*map(F.lit, of)), (1 + n % len(of)).cast("int"))
    c, null = F.col, F.lit(None).cast("string")
    key, nation = c("s_suppkey"), c("s_nationkey")
    kind = text("Part@k@RuleEngine", k=key % 40)
    owner = t("supplier").select("s_suppkey", kind.alias("name"), text("n@n@::Part@k@RuleEngine", n=nation, k=key % 40).alias("qualified_name"), text("src/n@n@/S@s@.x", n=nation, s=key).alias("file_path"), pick(key, "java", "kotlin", "python").alias("language"))
    classes = owner.select(text("class:@s@", s=key).alias("id"), F.lit("class").alias("kind"), "name", "qualified_name", "file_path", "language", F.lit(1).alias("start_line"), null.alias("return_type"))
    sold = t("lineitem").select(c("l_suppkey").alias("s_suppkey"), (c("l_partkey") % 50).alias("m")).distinct().join(owner.drop("name"), "s_suppkey")
    m = c("m")
    gives = F.when(m % 5 == 0, "self").otherwise(text("Part@k@RuleEngine", k=m % 40))
    methods = sold.select(text("method:@s@:@m@", s=key, m=m), F.lit("method"), text("act@m@", m=m), F.concat("qualified_name", text("::act@m@", m=m)), "file_path", "language", (m + 2).cast("int"), gives)
    alone = owner.select(text("alone:@s@", s=key), F.lit("method"), text("only@s@", s=key), F.concat("qualified_name", text("::only@s@", s=key)), "file_path", "language", F.lit(60), null)
    p = c("p_partkey")
    functions = t("part").select(text("function:@p@", p=p), F.lit("function"), text("do@n@", n=p % 701), text("do@n@", n=p % 701), text("lib/l@n@/F@n2@.x", n=p % 3, n2=p % 20), pick(p, "java", "go", "typescript", "python"), c("p_size").cast("int"), null)
    d = c("doc_id")
    path = text("doc/s@a@/t@b@/D@n@.md", a=d % 7, b=d % 3, n=d % 60)
    files = t("documents").select(path.alias("path"), text("D@n@.md", n=d % 60).alias("leaf"), pick(d % 60, "c", "objc", "java").alias("language")).distinct()
    files = files.select(F.concat(F.lit("file:"), "path"), F.lit("file"), "leaf", "path", "path", "language", F.lit(1), null)
    nodes = reduce(DataFrame.union, [classes, methods, alone, functions, files]).withColumn("is_exported", F.lit(False))

    o, u, form = c("o_orderkey"), c("o_custkey"), c("o_orderkey") % 12
    v = {"a": u % 7, "b": u % 3, "d": u % 70, "k": u % 40, "m": o % 50, "n": u % 25, "w": (o * 7) % 50, "s": u % 200, "f": u % 800}
    forms = ["D@d@.md", "t@b@/D@d@.md", "doc/s@a@/t@b@/D@d@.md", "Part@k@RuleEngine::act@m@", "n@n@::Part@k@RuleEngine", "part@k@RuleEngine.act@m@", "Part@k@RuleEngine.act@m@", "engineThing.act@m@", "thing.only@s@", "DO@f@", "do@f@", "Part@k@RuleEngine.act@m@().act@w@"]
    name = reduce(lambda x, i: F.when(form == i, text(forms[i], **v)).otherwise(x), range(12), null)
    even = u % 2 == 0
    name = F.when((form == 4) & even, text("n@n@.Part@k@RuleEngine", **v)).when((form == 8) & (u % 5 == 0), "items.append").when((form == 8) & (u % 5 == 1), "list.append").otherwise(name)
    what = F.when((form == 4) & even, "imports").when((form == 10) & (u % 5 < 3), "function_ref").when(form == 9, "references").otherwise("calls")
    where = F.when(form == 10, text("lib/l@b@/F@x@.x", b=u % 3, x=u % 20)).otherwise(text("doc/s@a@/t@b@/R.md", **v))
    refs = t("orders").select(o.alias("ref_id"), name.alias("ref_name"), what.alias("ref_kind"), where.alias("ref_file"), (o % 100).cast("int").alias("ref_line"), pick(u, "java", "kotlin", "python").alias("ref_language"), text("function:@u@", u=u).alias("from_id"))
    return nodes, refs


def script_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(path, text, language; scope, file_path, start, end): a script for each customer with a function that has a line for each of their orders,
    in one of six forms, some of them within comments and strings."""
    o = F.col("o_orderkey")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    forms = [say("  table['k", o % 3, "'](p);"), say("  // table['k", o % 3, "'](p); */"), say('  const s = "table[x](p) \\" bus.emit(name, 1)"; /* a', o), say("*/ bus.emit(name, ", o, ");"), say("  mediator.Send(new Cmd", o % 4, "(1));"), say("  import(path", o, ");")]
    pick = F.when((o / 4).cast("long") % 6 == 0, forms[0])
    for i, form in enumerate(forms[1:], 1):
        # What opens a comment is closed in the same line, or stands before what closes it.
        pick = pick.when((o / 4).cast("long") % 6 == i, F.concat(form, F.lit(" */")) if i == 2 else F.regexp_replace(form, r"^\*/", "  ") if i == 3 else form)
    lines = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", pick.alias("line")))).alias("lines"))
    path = say("src/c", F.col("o_custkey"), ".ts")
    text = F.concat(say("function f", F.col("o_custkey"), "(p) {\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n}"))
    files = lines.select(path.alias("path"), text.alias("text"), F.lit("typescript").alias("language"))
    scopes = lines.select(say("function:", F.col("o_custkey")).alias("scope"), path.alias("file_path"), F.lit(1).alias("start"), (F.size("lines") + 2).alias("end"))
    return files, scopes


def pointer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text: C files, one of a type and one for each supplier. A supplier is a struct with two pointers and the supplier before it in its nation (of the
    first, the last one); each part is a function in the file of the first supplier that sold it, and an entry of that one's table."""
    t = lambda name: table(spark, sf_dir, name)
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    s, p, b = F.col("s_suppkey"), F.col("p_partkey"), F.col("before")
    order = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    last = F.max("s_suppkey").over(Window.partitionBy("s_nationkey"))
    suppliers = t("supplier").select("s_suppkey", "s_acctbal", F.coalesce(F.lag("s_suppkey").over(order), last).alias("before"))
    sold = t("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("s_suppkey")).join(t("part").select("p_partkey", "p_size"), "p_partkey")
    entry = F.when(F.col("p_size") % 2 == 0, say("  { ", p, ", do_", p, ", 0 },")).otherwise(say("  { .stop = &do_", p, " }, // { 1, do_0 }"))
    lines = sold.groupBy("s_suppkey").agg(F.array_sort(F.collect_list(F.struct("p_partkey", say("int do_", p, "(int x) { return x; }").alias("f"), entry.alias("e")))).alias("parts"))
    joined = lambda x: F.coalesce(F.array_join(F.transform("parts", lambda r: r[x]), "\n"), F.lit(""))
    copy = say("void use_", s, "(struct Sup", s, " *a, struct Sup", b, " *b) { a->run = b->run;", F.when(F.col("s_acctbal") < 0, " a->stop = b->run;").otherwise(""), " }\n")
    chain = say("int chain_", s, "(struct Sup", s, " *a) {\n  return a->before->stop(1);\n}\n")
    text = F.concat(
        say("/* static struct Sup", s, " gone = { 1, do_1, do_1 }; */\nstruct Sup", s, " { int id; act_fn run; int (*stop)(int); struct Sup", b, " *before; };\n"), joined("f"),
        say("\nstatic struct Sup", s, " table_", s, "[] = {\n"), joined("e"), F.lit("\n};\n"), copy, say("int call_", s, "(struct Sup", s, " *a) {\n  log(\"a->stop(1)\");\n  return a->run(1);\n}\n"), chain,
        say("static act_fn list[] = { call_", s, ", (act_fn)&no_such };\nint pick_", s, "(int i) { return list[i](1); }\n"),
    )
    files = suppliers.join(lines, "s_suppkey", "left").select(say("src/s", s, ".c").alias("path"), text.alias("text"))
    return files.union(spark.range(1).select(F.lit("src/act.h").alias("path"), F.lit("typedef int (*act_fn)(int);\n").alias("text")))
