"""Queries of calls that go through values: dynamic boundaries, function pointers; and of cycles, over sources and graphs made of the tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill import store
from graphmill.functions import lexer
from graphmill.operators import boundaries, explore, modules, names, pointers, textindex, traverse, walk
from graphmill.plans.catalogue import STAR
from graphmill.sources import pointers as sources
from graphmill.sources import code, star, tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Lines of star.script_files by customer: which form, and on which line.
_LINES = """
with lines as (
  select o_custkey as c, o_orderkey as o, o_orderkey // 4 % 6 as form, row_number() over (partition by o_custkey order by o_orderkey) + 1 as line from orders)
"""


@_query(_LINES + """, hits as (
  select *, case form when 0 then 1 when 5 then 2 when 4 then 8 else 9 end as rank, ['computed-call', 'var-key-dispatch', 'typed-bus', 'dynamic-import'][case form when 0 then 1 when 3 then 2 when 4 then 3 else 4 end] as name,
    case form when 0 then 'k' || o % 3 when 4 then 'Cmd' || o % 4 end as key
  from lines where form in (0, 3, 4, 5)),
one as (select c, name, key, min(rank) as rank, min(line) as line, count(*) - 1 as more_sites from hits group by 1, 2, 3)
select 'function:' || c as scope, name as form, key, key is not null and name = 'typed-bus' as key_is_type, 'src/c' || c || '.ts' as file_path, cast(line as int) as line, more_sites
from (select *, row_number() over (partition by c order by rank, line) as nth from one) where nth <= 3""")
def dynamic_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, scopes = star.script_files(spark, sf_dir)
    return boundaries.boundaries(files, scopes).select("scope", "form", "key", "key_is_type", "file_path", "line", "more_sites")


@_query(_LINES + """select 'src/c' || c || '.ts' as path, sum(case form when 1 then 0 when 2 then 9 else 1 end)::bigint as code_lines, sum(case when form = 2 then 1 else 0 end)::bigint as quoted, true as same_offsets
from (select c, case when form = 2 then 2 else form end as form from lines) group by 1""".replace("when 2 then 9", "when 2 then 1"))
def blanked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold code outside comments, lines with a string, and whether every offset stays, of each script."""
    files, _ = star.script_files(spark, sf_dir)
    code = files.withColumn("code", lexer.blanked(F.col("text"), F.col("language"), strings=True))
    body = F.slice(F.split("code", "\n"), 2, F.size(F.split("code", "\n")) - 2)
    count = lambda pattern: F.size(F.filter(body, lambda x: x.rlike(pattern))).cast("long")
    where = lambda x: F.transform(F.split(x, "\n"), F.length)
    return code.select("path", count(r"\S").alias("code_lines"), count(r'" +"').alias("quoted"), (where("code") == where("text")).alias("same_offsets"))


@_query("""
with recursive before_ as (
  select s_suppkey as s, s_acctbal, coalesce(lag(s_suppkey) over (partition by s_nationkey order by s_suppkey), max(s_suppkey) over (partition by s_nationkey)) as b from supplier),
sold as (select l_partkey as p, min(l_suppkey) as s from lineitem group by 1),
bound as (select case when p_size % 2 = 0 then 'Sup' || s || '.run' else 'Sup' || s || '.stop' end as slot, 'src/s' || s || '.c#do_' || p as target from sold join part on p_partkey = p),
copies as (
  select 'Sup' || s || '.run' as to_slot, 'Sup' || b || '.run' as from_slot from before_
  union select 'Sup' || s || '.stop', 'Sup' || b || '.run' from before_ where s_acctbal < 0),
held as (select slot, target from bound union select c.to_slot, h.target from held h join copies c on c.from_slot = h.slot),
sites as (
  select 'src/s' || s || '.c#call_' || s as source, 'Sup' || s || '.run' as slot from before_
  union all select 'src/s' || s || '.c#chain_' || s, 'Sup' || b || '.stop' from before_),
pairs as (select source, target, slot as via from sites join held using (slot)
  union all select 'src/s' || s || '.c#pick_' || s, 'src/s' || s || '.c#call_' || s, 'list[]' from before_)
select source, target, via from pairs""")
def function_pointer_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = store.settled(sources.facts(star.pointer_files(spark, sf_dir)), "facts")
    functions = facts.where("what = 'function'").select(F.concat("file_path", F.lit("#"), "value").alias("id"), F.col("value").alias("name"), "file_path")
    return pointers.pointer_calls(facts, functions).select("source", "target", "via")


_RINGS = """
with placed as (
  select o_custkey as c, o_orderkey as o, c_acctbal, min(o_orderkey) over (partition by o_custkey) as first from orders join customer on o_custkey = c_custkey)
select o as id, case when c_acctbal < 0 then first else o end as component, cast(case when c_acctbal < 0 then count(*) over (partition by c) else 1 end as bigint) as size from placed
where exists (select 1 from placed x where x.c = placed.c and x.o <> placed.o) or c_acctbal < 0
  or exists (select 1 from placed x where placed.c % 2 = 0 and x.c = placed.c + 1) or exists (select 1 from placed x where placed.c % 2 = 1 and x.c = placed.c - 1)
"""


@_query(_RINGS)
def order_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders lead to the customer's order before; the first leads to the last where the customer owes, and to the next customer's last where their number is even."""
    t = lambda name: star.table(spark, sf_dir, name)
    o = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey")
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    chain = o.select(F.col("o_orderkey").alias("at"), F.lag("o_orderkey").over(by).alias("to")).where("to is not null")
    ends = o.groupBy("o_custkey", "c_acctbal").agg(F.min("o_orderkey").alias("at"), F.max("o_orderkey").alias("to"))
    ring = ends.where("c_acctbal < 0").select("at", "to")
    across = ends.where("o_custkey % 2 = 0").select((F.col("o_custkey") + 1).alias("o_custkey"), "at").join(ends.select("o_custkey", "to"), "o_custkey").select("at", "to")
    return traverse.components(chain.union(ring).union(across))


_WORDS = STAR + r""", texts as (select id, 'name' as field, 20.0 as weight, list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: x <> '') as words from nodes
  union all select id, 'qualified_name', 5.0, list_filter(regexp_split_to_array(lower(qualified_name), '[^a-z0-9]+'), lambda x: x <> '') from nodes),
sizes as (select field, count(*) as n, avg(len(words)) as mean from texts group by 1),
hits as (select id, field, weight, w, len(words) as size, len(list_filter(words, lambda x: starts_with(x, w))) as tf from texts, (values ('sup'), ('asia'), ('order'), ('1')) v(w)),
spread as (select field, w, count(*) as df from hits where tf > 0 group by 1, 2)
"""


def _index(spark: SparkSession, sf_dir: str) -> textindex.TextIndex:
    folder = f"{store.shared(spark)}/graphmill-texts-{uuid.uuid4().hex}"
    textindex.write(star.star_graph(spark, sf_dir).nodes, folder)
    return textindex.read(spark, folder)


@_query(_WORDS + """select id, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) as score
from hits join sizes using (field) join spread using (field, w) where tf > 0 group by 1""")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every symbol with words that begin with one of four, from the stored index."""
    return textindex.scores(_index(spark, sf_dir), ["sup", "asia", "order", "1"]).select("id", F.round("score", 6).alias("score"))


@_query(_WORDS + "select word as term, count(*) as df from (select distinct id, field, unnest(words) as word from texts) where starts_with(word, '1') group by 1 order by 2 desc, 1 limit 20")
def word_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textindex.completions(_index(spark, sf_dir), "1")


@_query("""select lower(replace(r_name, ' ', '_')) as region, lower(replace(n_name, ' ', '_')) as nation, count(*) as files, cast(sum(n) as bigint) as lines, cast(sum(size) as bigint) as size
from (select r_name, n_name, count(*) as n, sum(strlen(c_name) + 1) as size from customer join nation on c_nationkey = n_nationkey join region on r_regionkey = n_regionkey group by 1, 2)
where r_name <> 'EUROPE' and n_name <> 'JAPAN' and not (r_name <> 'ASIA' and n_name = 'KENYA') group by 1, 2""")
def scanned_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names in a file for each nation, in a folder for each region, of which ignore files rule out one region and two nations."""
    t = lambda name: star.table(spark, sf_dir, name)
    folder = f"{store.shared(spark)}/graphmill-tree-{uuid.uuid4().hex}"
    lower = lambda x: F.lower(F.replace(x, F.lit(" "), F.lit("_")))
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), lower("r_name").alias("r"), lower("n_name").alias("n"))
    t("customer").join(place, "c_nationkey").select(F.col("c_name").alias("value"), "r", "n").repartition("r", "n").write.partitionBy("r", "n").text(folder)
    # Ignore files are texts of one line of their own folders, written as anything else is.
    rules = spark.createDataFrame([("", "r=europe/"), ("/r=asia", "n=japan"), ("/r=africa", "/n=kenya/")], "folder string, rule string")
    for at, rule in rules.collect():
        system, base = tree._filesystem(folder + at)
        system.create_dir(base)
        with system.open_output_stream(f"{base}/{tree.IGNORE_FILE}") as f:
            f.write(f"# made\n{rule}\n*.crc\n".encode())
    found = tree.scan_tree(spark, folder, extensions={".txt": "python"}, partitions=8)
    part = lambda name: F.regexp_extract("path", rf"{name}=([^/]*)/", 1)
    n_lines = F.size(F.split("text", "\n")) - 1
    return found.groupBy(part("r").alias("region"), part("n").alias("nation")).agg(F.count("*").alias("files"), F.sum(n_lines).cast("long").alias("lines"), F.sum("size").alias("size"))


#: Configs of a made repository; its files and imports come from the tables.
CONFIGS = [
    ("tsconfig.json", '{ // paths\n "compilerOptions": { "baseUrl": ".", "paths": { "@/*": ["src/*"], "@/deep/*": ["lib/deep/*", "src/deep/*"], "exact": ["src/n1/only"], "x*.end": ["src/*"], }, }, }'),
    ("package.json", '{"workspaces": ["packages/*"]}'), ("packages/ui/package.json", '{"name": "@scope/ui"}'), ("packages/uicore/package.json", '{"name": "@scope/ui/core"}'), ("elsewhere/no/package.json", '{"name": "left"}'),
    ("go.mod", "// m\nmodule example.com/app\n\ngo 1.2\n"), ("crates/k/Cargo.toml", '[package]\nname = "my-crate"\n'), ("broken/tsconfig.json", "{"),
]
_MODULES = """
with c as (select c_custkey as u, c_nationkey as n from customer),
files as (
  select 'src/n' || n || '/c' || u || '.ts' as path, 'script' as family from c union all select 'src/n1/only.ts', 'script'
  union all select 'lib/deep/n' || n || '/c' || u || '.ts', 'script' from c where u % 3 = 0 union all select 'src/deep/n' || n || '/c' || u || '.tsx', 'script' from c where u % 3 <> 2
  union all select 'packages/ui/n' || n || '/c' || u || '.tsx', 'script' from c where u % 2 = 0 union all select 'packages/uicore/c' || u || '/index.ts', 'script' from c where u % 2 = 1
  union all select 'pkg/n' || n || '/c' || u || '.go', 'go' from c union all select 'crates/k/src/n' || n || '/c' || u || '.rs', 'rust' from c
  union all select 'native/include/n' || n || '/c' || u || '.h', 'c' from c union all select 'from/c' || u || '.h', 'c' from c where u % 5 = 0)
"""


@_query(_MODULES + """, asks as (select o_orderkey as o, u, n, o_orderkey % 11 as form from orders join c on o_custkey = u),
wanted as (select o, case form when 0 then ['src/n' || n || '/c' || u || '.ts'] when 1 then ['lib/deep/n' || n || '/c' || u || '.ts', 'src/deep/n' || n || '/c' || u || '.tsx'] when 2 then ['packages/ui/n' || n || '/c' || u || '.tsx']
  when 3 then ['packages/uicore/c' || u || '/index.ts'] when 4 then ['go' || n] when 5 then ['src/n1/only.ts'] when 7 then ['crates/k/src/n' || n || '/c' || u || '.rs'] when 8 then ['from/c' || u || '.h', 'native/include/n' || n || '/c' || u || '.h']
  when 9 then ['src/n' || n || '/c' || u || '.ts'] when 10 then ['src/n' || n || '/c' || u || '.ts'] else [] end as paths,
  case form when 0 then 'alias' when 1 then 'alias' when 2 then 'workspace' when 3 then 'workspace' when 4 then 'module' when 5 then 'alias' when 7 then 'crate' when 9 then 'alias' when 10 then 'relative' end as kind, form from asks),
named as (select o, kind, form, unnest(paths) as path, generate_subscripts(paths, 1) as pick from wanted),
go as (select 'go' || n as path, min('pkg/n' || n || '/c' || u || '.go') as first from c group by 1),
met as (select o, form, pick, coalesce(kind, case when pick = 1 then 'relative' else 'include' end) as kind, coalesce(first, path) as path from named left join go using (path))
select o as ref_id, path as target_path, kind, cast(case when form = 8 and kind = 'relative' then 0.92 else 0.9 end as double) as confidence from (
  select *, row_number() over (partition by o order by pick) as nth from met where path in (select path from files)) where nth = 1""")
def resolved_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import paths of orders, in eleven forms, to files of customers."""
    t = lambda name: star.table(spark, sf_dir, name)
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    c = t("customer").select(F.col("c_custkey").alias("u"), F.col("c_nationkey").alias("n"))
    u, n = F.col("u"), F.col("n")
    made = [
        ("true", say("src/n", n, "/c", u, ".ts"), "typescript"), ("u % 3 = 0", say("lib/deep/n", n, "/c", u, ".ts"), "typescript"), ("u % 3 != 2", say("src/deep/n", n, "/c", u, ".tsx"), "tsx"), ("u % 2 = 0", say("packages/ui/n", n, "/c", u, ".tsx"), "tsx"),
        ("u % 2 = 1", say("packages/uicore/c", u, "/index.ts"), "typescript"), ("true", say("pkg/n", n, "/c", u, ".go"), "go"), ("true", say("crates/k/src/n", n, "/c", u, ".rs"), "rust"),
        ("true", say("native/include/n", n, "/c", u, ".h"), "c"), ("u % 5 = 0", say("from/c", u, ".h"), "c"),
    ]
    files = reduce(DataFrame.union, (c.where(w).select(path.alias("path"), F.lit(x).alias("language")) for w, path, x in made))
    files = store.settled(files.union(spark.range(1).select(F.lit("src/n1/only.ts"), F.lit("typescript"))), "files")
    o = F.col("o_orderkey")
    specs = [
        (say("@/n", n, "/c", u), "typescript"), (say("@/deep/n", n, "/c", u), "tsx"), (say("@scope/ui/n", n, "/c", u), "typescript"), (say("@scope/ui/core/c", u), "javascript"), (say("example.com/app/pkg/n", n), "go"), (F.lit("exact"), "typescript"),
        (F.lit("left-pad"), "typescript"), (say("my_crate/n", n, "/c", u), "rust"), (F.when(u % 5 == 0, say("c", u, ".h")).otherwise(say("n", n, "/c", u, ".h")), "c"), (say("xn", n, "/c", u, ".end"), "vue"), (say("../src/./n", n, "/c", u), "svelte"),
    ]
    asks = t("orders").join(c, F.col("o_custkey") == u)
    pick = lambda i: reduce(lambda x, k: F.when(o % 11 == k, specs[k][i] if i == 0 else F.lit(specs[k][1])).otherwise(x), range(11), F.lit(None).cast("string"))
    asks = store.settled(asks.select(o.alias("ref_id"), pick(0).alias("spec"), pick(1).alias("language"), F.lit("from/here").alias("ref_file")), "asks")
    found = modules.resolved(asks, files, spark.createDataFrame(CONFIGS, "path string, text string"))
    return asks.join(found, ["ref_file", "spec"]).select("ref_id", "target_path", "kind", "confidence")


_EXPLORE = """
with recursive ranges as (
  select 'src/c' || o_custkey || '.x' as f, o_orderkey as a, o_orderkey + o_orderkey % 30 as z, [10, 9, 6, 3, 1][1 + o_orderkey % 5] as importance, o_orderkey % 13 = 0 as spine, case when o_orderkey % 13 = 0 then o_orderkey end as call_line from orders),
flagged as (select *, case when a <= max(z) over w + 300 then 0 else 1 end as is_new from ranges window w as (partition by f order by a, z, importance rows between unbounded preceding and 1 preceding)),
runs as (select *, sum(is_new) over (partition by f order by a, z, importance rows unbounded preceding) as run from flagged),
found as (select f, min(a) as a, max(z) as z, sum(importance)::bigint as score, max(importance) as top, bool_or(spine) as spine, arg_min(call_line, a) filter (call_line is not null) as call_line, count(*) as symbols from runs group by f, run),
ranked as (select *, 2 * (z - a + 1) as chars, row_number() over (partition by f order by spine desc, top desc, score / (z - a + 1) desc, score desc, z - a, a) as rank from found)
"""


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    spine = o % 13 == 0
    rank = F.element_at(F.array(*map(F.lit, (10, 9, 6, 3, 1))), (1 + o % 5).cast("int"))
    ranges = star.table(spark, sf_dir, "orders").select(F.concat(F.lit("src/c"), F.col("o_custkey").cast("string"), F.lit(".x")).alias("file_path"), o.alias("start"), (o + o % 30).alias("end"), rank.alias("importance"), spine.alias("spine"), F.when(spine, o).alias("call_line"))
    return explore.clusters(ranges, 300)


@_query(_EXPLORE + "select f as file_path, a as start, z as \"end\", score, top, spine, call_line, symbols, rank from ranked")
def line_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of orders' numbers as lines of a file a customer, merged and ranked."""
    return _clusters(spark, sf_dir)


@_query(_EXPLORE + """, folded as (
  select f, 0::bigint as rank, 0::bigint as used, 0 as n, []::bigint[] as kept from (select distinct f from ranked)
  union all select s.f, r.rank, case when ok then more else used end, case when ok then n + 1 else n end, case when ok then list_append(kept, r.rank) else kept end
  from (select s.*, r.rank as next, s.used + r.chars + case when s.n > 0 then 19 else 0 end as more, s.n = 0 or s.used + r.chars + 19 <= 3800 or (r.spine and s.used + r.chars + 19 <= 9500) as ok from folded s join ranked r on r.f = s.f and r.rank = s.rank + 1) s
  join ranked r on r.f = s.f and r.rank = s.next),
last as (select f, max_by(kept, rank) as kept, max_by(used, rank) as used from folded group by f),
files as (select f, used, row_number() over (order by 2 * least(score, 100) // 20 desc, symbols desc, f) as rank from (select f, sum(score) as score, count(*) as symbols from ranked group by f) join last using (f)),
total as (
  select 0::bigint as rank, 0::bigint as used, []::varchar[] as kept
  union all select f.rank, case when ok then more else t.used end, case when ok then list_append(kept, f.f) else kept end
  from (select t.*, t.used + f.used + 200 as more, len(t.kept) < 4 and t.used + f.used + 200 <= 13000 as ok from total t join files f on f.rank = t.rank + 1) t join files f on f.rank = t.rank + 1 where f.rank <= 50)
select file_path, file_rank, r.rank, r.a as start, r.chars from (select unnest(kept) as file_path, generate_subscripts(kept, 1) as file_rank from (select max_by(kept, rank) as kept from total)) join last l on l.f = file_path
join ranked r on r.f = file_path and list_contains(l.kept, r.rank)""")
def explored_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of those clusters fits the answer to one question, file by file."""
    found = store.settled(_clusters(spark, sf_dir).withColumn("chars", 2 * (F.col("end") - F.col("start") + 1)), "clusters")
    no = F.lit(False)
    files = found.groupBy("file_path").agg(F.sum("score").alias("_s"), F.count("*").alias("symbols"))
    files = files.select("file_path", (F.floor(2 * F.least("_s", F.lit(100)) / 20)).cast("double").alias("graph"), no.alias("is_central"), no.alias("is_entry"), no.alias("is_named"), F.lit(0).alias("hits"), F.lit(0).alias("score"), "symbols")
    picked = explore.selection(explore.ranked_files(explore.gated(files), 50), found, explore.budget_of(100))
    return picked.select("file_path", "file_rank", "rank", "start", "chars")


@_query("""
with recursive edges as (select o_orderkey as at, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as "to" from orders),
named as (select o_orderkey as id from orders where o_totalprice > 50000), seeds as (select id from named order by id desc limit 8),
step as (
  select id as seed, id as at, 1 as n, 0 as streak, [id] as path from seeds
  union all select s.seed, e."to", s.n + 1, case when e."to" in (select id from named) then 0 else s.streak + 1 end, list_append(s.path, e."to")
  from step s join edges e on e.at = s.at where e."to" is not null and s.n < 7 and (e."to" in (select id from named) or s.streak < 1))
select seed, array_to_string(path, '>') as path from (select *, row_number() over (partition by seed order by n desc) as nth from step where streak = 0 and n > 1) where nth = 1""")
def longest_call_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the last eight dear orders back through the customer's orders."""
    orders = star.table(spark, sf_dir, "orders")
    # A negative number stands for an order, so that the last ones are the first seeds.
    at, before = -F.col("o_orderkey"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    moves = orders.select(at.alias("at"), (-before).alias("to")).where("to is not null")
    found = walk.longest_chains(moves, orders.where("o_totalprice > 50000").select(at.alias("id")))
    return found.select((-F.col("seed")).alias("seed"), F.array_join(F.transform("path", lambda x: (-x).cast("string")), ">").alias("path"))


@_query("""
with recursive above as (select s_suppkey as s, lag(s_suppkey) over (partition by s_nationkey order by s_suppkey) as b from supplier),
has as (select distinct s, p % 50 as m from (select l_partkey as p, min(l_suppkey) as s from lineitem group by 1)),
up as (select s, s as at, 0 as depth from above union all select u.s, a.b, u.depth + 1 from up u join above a on a.s = u.at where a.b is not null and u.depth < 4),
found as (select u.s, h.m, arg_min(u.at, u.depth) as owner from up u join has h on h.s = u.at group by 1, 2),
only_one as (select m, min(s) as owner from has group by 1 having count(*) = 1)
select 'm/s' || s || '.py' as ref_file, 'x.do' || m as ref_name, 'm/s' || owner || '.py' as target_file, cast(confidence as double) as confidence from (
  select s, m, owner, 0.9 as confidence from found
  union all select a.s, o.m, o.owner, 0.7 from above a cross join only_one o where not exists (select 1 from found f where f.s = a.s and f.m = o.m))""")
def inherited_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python files, one a supplier: a class below the one of the supplier before it in its nation, with a method for some parts, and a function that calls fifty
    methods on a parameter of that type."""
    t = lambda name: star.table(spark, sf_dir, name)
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    s, b = F.col("s_suppkey"), F.col("above")
    suppliers = t("supplier").select("s_suppkey", F.lag("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("above"))
    first = t("lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("s_suppkey"))
    methods = first.groupBy("s_suppkey").agg(F.array_sort(F.collect_set(F.col("l_partkey") % 50)).alias("ms"))
    body = F.array_join(F.transform(F.coalesce("ms", F.array().cast("array<bigint>")), lambda m: say("    def do", m, "(self):\n        return 0\n")), "\n")
    calls = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(49)), lambda j: say("    x.do", j, "()")), "\n")
    text = F.concat(say("class Sup", s), F.when(b.isNull(), "").otherwise(say("(Sup", b, ")")), F.lit(":\n    size = 1\n\n"), body, say("\n\ndef use", s, "(x: Sup", s, "):\n"), calls, F.lit("\n"))
    files = suppliers.join(methods, "s_suppkey", "left").select(say("m/s", s, ".py").alias("path"), text.alias("text"), F.lit("python").alias("language"))
    extracted = store.settled(code.extract(files), "extracted")
    graph, refs = code.graph_of(extracted)
    nodes, refs = store.settled(graph.nodes, "nodes"), store.settled(refs, "refs")
    types = store.settled(code.receiver_types(extracted, refs, nodes), "types")
    found = names.until_settled(refs, nodes, types).join(refs.where("ref_name like 'x.do%'"), "ref_id")
    return found.join(nodes.select(F.col("id").alias("target"), F.col("file_path").alias("target_file")), "target").select("ref_file", "ref_name", "target_file", F.col("confidence").cast("double").alias("confidence"))
