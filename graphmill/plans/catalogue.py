"""Queries over the test tables and the DuckDB SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill import store
from graphmill.functions import predicates as P
from graphmill.functions import text as X
from graphmill.operators import analytics, intervals, resolve, search, traverse, walk
from graphmill.schema import Graph
from graphmill.sources import code, star
from graphmill.streaming import sync

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The star graph in SQL, for the oracles.
STAR = """
with recursive place as (select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey),
nodes as (
  select 'module:' || r_regionkey as id, 'module' as kind, r_name as name, r_name as qualified_name, 'src/' || r_name || '.x' as file_path, 'sql' as language, cast(r_regionkey as int) as start_line, true as is_exported from region
  union all select 'namespace:' || n_nationkey, 'namespace', n_name, r_name || '::' || n_name, 'src/' || r_name || '/' || n_name || '/nation.x', 'sql', cast(n_nationkey as int), true from place
  union all select 'class:' || c_custkey, 'class', c_name, r_name || '::' || n_name || '::' || c_name, 'src/' || r_name || '/' || n_name || '/customer.x', 'java', cast(c_custkey as int), c_acctbal > 0 from customer join place on c_nationkey = n_nationkey
  union all select 'struct:' || s_suppkey, 'struct', s_name, r_name || '::' || n_name || '::' || s_name, 'src/' || r_name || '/' || n_name || '/supplier.x', 'go', cast(s_suppkey as int), s_acctbal > 0 from supplier join place on s_nationkey = n_nationkey
  union all select 'interface:' || p_partkey, 'interface', p_name, p_brand || '::' || p_name, 'src/parts/' || p_brand || '.x', 'java', cast(p_partkey as int), p_size > 25 from part
  union all select 'method:' || o_orderkey, 'method', 'order_' || o_orderkey, r_name || '::' || n_name || '::' || c_name || '::order_' || o_orderkey, 'src/' || r_name || '/' || n_name || '/orders.x', 'java', cast(o_orderkey as int), o_orderstatus = 'F' from orders join customer on o_custkey = c_custkey join place on c_nationkey = n_nationkey),
edges as (
  select 'module:' || n_regionkey as source, 'namespace:' || n_nationkey as target, 'contains' as kind, 0 as line from nation
  union all select 'namespace:' || c_nationkey, 'class:' || c_custkey, 'contains', 0 from customer
  union all select 'namespace:' || s_nationkey, 'struct:' || s_suppkey, 'contains', 0 from supplier
  union all select 'class:' || o_custkey, 'method:' || o_orderkey, 'contains', 0 from orders
  union all select 'method:' || l_orderkey, 'interface:' || l_partkey, 'calls', l_linenumber from lineitem
  union all select 'method:' || o_orderkey, 'method:' || prev, 'calls', 0 from (select o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as prev from orders) where prev is not null
  union all select 'method:' || l_orderkey, 'struct:' || l_suppkey, 'references', l_linenumber from lineitem)
"""
FILE_GRAPH = """, file_edges as (
  select distinct a.file_path as source_file, b.file_path as target_file from edges e join nodes a on e.source = a.id join nodes b on e.target = b.id
  where e.kind <> 'contains' and a.file_path <> b.file_path)
"""
DOC_PATHS = """
with paths as (select doc_id, ['src','tests','lib','examples','jvmTest'][1 + doc_id % 5] || '/' || lang || '/' || source || '/Doc' || doc_id || ['_test.go','.pb.go','.test.ts','Test.java','_pb2.py','.x','.py'][1 + doc_id % 7] as file_path, lang as language from documents)
"""
SNAPSHOTS = """
with docs as (select doc_id, lang || '/' || source || '/' || doc_id as path, text from documents),
disk as (select path, md5(case when doc_id % 7 = 0 then text || '!' else text end) as hash from docs where doc_id % 11 <> 0),
idx as (select path, md5(text) as hash from docs where doc_id % 10 <> 0)
"""
NATION = """
with recursive pairs as (
  select c_nationkey as a, s_nationkey as b, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
  where c_nationkey <> s_nationkey group by 1, 2),
deps as (select a as source, b as target, n from (select *, row_number() over (partition by a order by n desc, b) as nth from pairs) where nth = 1)
"""
PAGE_REFS = r"""
with refs as (select page_id, url, unnest(range(len(names))) as position, unnest(names) as name from (select page_id, url, regexp_extract_all(html, 'href="/([^"]*)"', 1) as names from pages)),
named as (select * from refs where name <> '')
"""


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


g = star.star_graph
t = star.table
c = F.col

# ---- scans and stores ------------------------------------------------------------------------------


@query(STAR + "select file_path as path, min(language) as language, count(*) as node_count from nodes group by 1")
def files_list(s, d):
    return analytics.files_of(g(s, d))


@query(STAR + "select distinct name from nodes")
def distinct_names(s, d):
    return g(s, d).nodes.select("name").distinct()


@query(STAR + "select id, name from nodes order by id limit 50 offset 100")
def paged_scan(s, d):
    return g(s, d).nodes.select("id", "name").orderBy("id").offset(100).limit(50)


@query(STAR + "select id, kind, case when kind = 'struct' and start_line % 3 = 0 then name || '_v2' else name end as name from nodes union all select 'struct:new' || s_suppkey, 'struct', s_name || '_new' from supplier where s_suppkey % 5 = 0")
def node_upsert(s, d):
    n = g(s, d).nodes.select("id", "kind", "name")
    changed = t(s, d, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("struct:"), "s_suppkey").alias("id"), F.lit("struct").alias("kind"), F.concat("s_name", F.lit("_v2")).alias("name"))
    added = t(s, d, "supplier").where("s_suppkey % 5 = 0").select(F.concat(F.lit("struct:new"), "s_suppkey").alias("id"), F.lit("struct").alias("kind"), F.concat("s_name", F.lit("_new")).alias("name"))
    return store.upsert(n, changed.union(added), ["id"])


@query(STAR + "select source, target, kind, line from edges where source in (select id from nodes where is_exported) and target in (select id from nodes where is_exported)")
def endpoint_validation(s, d):
    x = g(s, d)
    return store.valid_edges(x.edges, x.nodes.where("is_exported")).select("source", "target", "kind", "line")


@query("select user_id as path, event_type as content_hash, ts as indexed_at from (select *, row_number() over (partition by user_id order by ts desc, event_type desc) as nth from events) where nth = 1")
def file_upsert_latest(s, d):
    rows = t(s, d, "events").select(c("user_id").alias("path"), c("event_type").alias("content_hash"), c("ts").alias("indexed_at"))
    return store.latest(rows, ["path"], [F.desc("indexed_at"), F.desc("content_hash")])


@query(STAR + ", kept as (select * from nodes where file_path not like 'src/parts/%') select kind, count(*) as n from edges where source in (select id from kept) and target in (select id from kept) group by 1")
def file_delete_cascade(s, d):
    x = g(s, d)
    gone = x.nodes.where(P.under(c("file_path"), "./src/parts/")).select("file_path").distinct()
    return analytics.counts(store.delete_files(x, gone).edges, "kind")


@query(PAGE_REFS + "select page_id, name, count(*) as n from named where not exists (select 1 from named x where x.page_id = named.page_id and x.name = named.name and x.position = 0) group by 1, 2")
def reference_tuple_delete(s, d):
    refs = star.page_references(s, d).select(c("page_id").alias("from_node_id"), c("name").alias("reference_name"), F.lit("references").alias("reference_kind"), "position")
    left = store.delete_references(refs, refs.where("position = 0").drop("position"))
    return left.groupBy(c("from_node_id").alias("page_id"), c("reference_name").alias("name")).agg(F.count("*").alias("n"))


# ---- lookups ---------------------------------------------------------------------------------------


@query(STAR + "select id, name, start_line from nodes where id in ('method:1', 'class:1', 'struct:1', 'module:1', 'class:7')")
def nodes_by_id(s, d):
    return g(s, d).nodes.where(c("id").isin("method:1", "class:1", "struct:1", "module:1", "class:7")).select("id", "name", "start_line")


@query(STAR + "select id, name, start_line from nodes where file_path = 'src/ASIA/NATION_2/customer.x'")
def nodes_in_file(s, d):
    return g(s, d).nodes.where("file_path = 'src/ASIA/NATION_2/customer.x'").select("id", "name", "start_line").orderBy("start_line", "id")


@query(STAR + "select id, name from nodes where lower(name) = lower('aSiA') or qualified_name = 'EUROPE::NATION_3'")
def name_lookups(s, d):
    return g(s, d).nodes.where((F.lower("name") == "asia") | (c("qualified_name") == "EUROPE::NATION_3")).select("id", "name")


@query(STAR + "select id, name from nodes where contains(lower(name), '12') and not starts_with(lower(name), '12') order by length(name), name, id limit 40")
def name_substring(s, d):
    return search.nearest_by_name(g(s, d).nodes, "12", 40)


@query(STAR + "select source, target, kind, line from edges where (source = 'method:3' and kind in ('calls','references')) or target = 'method:3'")
def edges_of_node(s, d):
    e = g(s, d).edges
    return e.where((c("source") == "method:3") & c("kind").isin("calls", "references")).unionByName(e.where("target = 'method:3'"))


@query(STAR + ", picked as (select id from nodes where kind in ('class', 'method') and starts_with(file_path, 'src/ASIA/')) select source, target, kind, line from edges where kind in ('calls', 'contains') and source in (select id from picked) and target in (select id from picked)")
def induced_edges(s, d):
    x = g(s, d)
    picked = x.nodes.where(c("kind").isin("class", "method") & c("file_path").startswith("src/ASIA/")).select("id")
    return traverse.induced(x.edges, picked, ("calls", "contains"))


@query(STAR + "select id, name from nodes where file_path = 'src/EUROPE/NATION_3/supplier.x' and is_exported")
def exported_in_file(s, d):
    return g(s, d).nodes.where("file_path = 'src/EUROPE/NATION_3/supplier.x' and is_exported").select("id", "name")


@query(STAR + "select id, qualified_name from nodes where regexp_full_match(qualified_name, 'ASIA::.*::Customer#0.*1') and kind in ('function','method','class','interface','struct','variable','constant')")
def qualified_glob(s, d):
    return g(s, d).nodes.where(c("qualified_name").rlike(P.name_glob("ASIA::*::Customer#0*1")) & c("kind").isin(*P.GLOB_KINDS)).select("id", "qualified_name")


@query(STAR + "select distinct file_path from nodes where regexp_matches(file_path, 'src/.*/[^/]*er[.]x')")
def path_glob(s, d):
    return g(s, d).nodes.where(c("file_path").rlike(P.glob("src/**/*er.x"))).select("file_path").distinct()


@query(STAR + "select distinct file_path from nodes where file_path = 'src/ASIA' or starts_with(file_path, 'src/ASIA/')")
def path_prefix(s, d):
    return g(s, d).nodes.where(P.under(c("file_path"), "./src/ASIA/")).select("file_path").distinct()


_NAME = "regexp_extract(file_path, '[^/]*$')"
_TEST = (
    f"(regexp_matches(lower({_NAME}), '^test_|^test[.]|[._-](test|tests|spec|specs)[.][a-z0-9]+$') or regexp_matches({_NAME}, '(Test|Tests|TestCase|Tester|Spec|Specs)[.][A-Za-z0-9]+$') "
    "or regexp_matches(lower(file_path), '/(tests|test|__tests__|spec|specs|testlib|testing)/|^(test|tests|spec|specs)/|(^|/)(integration|sample|samples|example|examples|fixture|fixtures|benchmark|benchmarks|demo|demos)/') "
    "or regexp_matches(file_path, '(^|/)[A-Za-z0-9]*(Test|Tests|Spec)/'))"
)
_GENERATED = "regexp_matches(file_path, '[.]pb[.]go$|_pb2(_grpc)?[.]py$')"
_LOW = "(regexp_matches(lower(file_path), '(^|/)(tests?|__tests?__|spec)/|_test[.]go$|[.](test|spec)[.][jt]sx?$|(test|spec|tests)[.](java|kt|scala)$') or " + _GENERATED + ")"


@query(DOC_PATHS + f"select file_path, {_TEST} as is_test, {_GENERATED} as is_generated, {_LOW} as is_low_value from paths")
def file_predicates(s, d):
    p = c("file_path")
    return star.document_paths(s, d).select(p, P.is_test(p).alias("is_test"), P.is_generated(p).alias("is_generated"), P.is_low_value(p).alias("is_low_value"))


@query(STAR + "select id, file_path from nodes where name = 'NATION_2' and contains(qualified_name, 'ASIA::NATION_2')")
def symbol_match(s, d):
    return g(s, d).nodes.where(P.matches_symbol("ASIA.NATION_2")).select("id", "file_path")


# ---- joins -----------------------------------------------------------------------------------------


@query(STAR + "select a.file_path, count(*) as n from edges e join nodes a on e.source = a.id join nodes b on e.target = b.id where e.kind <> 'contains' and a.file_path = b.file_path group by 1")
def in_file_edges(s, d):
    return analytics.in_file_edges(g(s, d))


@query(STAR + """, top as (select a.file_path, count(*) as n from edges e join nodes a on e.source = a.id join nodes b on e.target = b.id where e.kind <> 'contains' and a.file_path = b.file_path group by 1 order by n desc, file_path limit 20),
ranked as (select file_path, n, lead(n) over (order by n desc, file_path) as next_n, row_number() over (order by n desc, file_path) as nth from top) select file_path, n, next_n from ranked where nth = 1 and n >= 20""")
def dominant_file(s, d):
    return analytics.dominant_file(g(s, d))


@query(STAR + """, rows as (select distinct e.source as route, b.name as handler, b.file_path, b.start_line as handler_line from edges e join nodes a on e.source = a.id join nodes b on e.target = b.id
where e.kind in ('calls', 'references') and a.kind = 'method' and b.kind in ('method', 'class', 'interface', 'struct')) select * from rows order by file_path, handler_line, route limit 50""")
def routing_manifest(s, d):
    x = g(s, d)
    return analytics.routing_manifest(x, x.nodes.where("kind = 'method'").select("id"))


@query(STAR + FILE_GRAPH + "select source_file, target_file from file_edges")
def file_dependencies(s, d):
    return traverse.file_graph(g(s, d))


@query(STAR + FILE_GRAPH + "select distinct source_file as dependent from file_edges where target_file = 'src/parts/Brand#11.x'")
def file_dependents(s, d):
    return traverse.file_graph(g(s, d)).where("target_file = 'src/parts/Brand#11.x'").select(c("source_file").alias("dependent"))


@query(STAR + "select e.source, e.kind, b.kind as target_kind, b.name as target_name, e.line from edges e join nodes a on e.source = a.id join nodes b on e.target = b.id where b.file_path = 'src/ASIA/NATION_2/supplier.x' and a.file_path <> b.file_path")
def cross_file_in_edges(s, d):
    x = g(s, d)
    b = x.nodes.where("file_path = 'src/ASIA/NATION_2/supplier.x'").select(c("id").alias("target"), c("kind").alias("target_kind"), c("name").alias("target_name"))
    a = x.nodes.where("file_path != 'src/ASIA/NATION_2/supplier.x'").select(c("id").alias("source"))
    return x.edges.join(b, "target").join(a, "source", "left_semi").select("source", "kind", "target_kind", "target_name", "line")


@query(STAR + "select e.source, 'v2:' || e.target as target, e.kind, e.line from edges e join nodes b on e.target = b.id where b.kind = 'struct' and b.start_line % 4 <> 0 and e.kind <> 'contains'")
def edge_rekey(s, d):
    x = g(s, d)
    old = x.nodes.where("kind = 'struct'")
    new = old.where("start_line % 4 != 0").withColumn("id", F.concat(F.lit("v2:"), "id"))
    return store.rekey_edges(x.edges.where("kind != 'contains'"), old, new).select("source", "target", "kind", "line")


@query("""select event_id as id, scope from (select e.event_id, r.event_id as scope, row_number() over (partition by e.event_id order by r.event_id desc nulls last) as nth
from (select event_id, user_id % 5 as k, event_id as at from events where event_type = 'click') e
left join (select event_id, user_id % 5 as k, event_id as s, event_id + 40 as z from events where event_type = 'purchase') r on r.k = e.k and r.s <= e.at and r.z >= e.at) where nth = 1""")
def enclosing_scope(s, d):
    e = t(s, d, "events").withColumn("k", c("user_id") % 5)
    points = e.where("event_type = 'click'").select(c("event_id").alias("id"), "k", c("event_id").alias("at"))
    ranges = e.where("event_type = 'purchase'").select(c("event_id").alias("scope"), "k", c("event_id").alias("start"), (c("event_id") + 40).alias("end"))
    return intervals.enclosing(points, ranges, "k", "at").select("id", "scope")


@query("""with want as (select distinct l_orderkey as wanted, l_partkey as item from lineitem), have as (select distinct l_suppkey as owner, l_partkey as item from lineitem),
sizes as (select wanted, count(*) as size from want group by 1) select h.owner, w.wanted from have h join want w using (item) join sizes z on z.wanted = w.wanted group by h.owner, w.wanted, z.size having count(*) = z.size""")
def interface_satisfaction(s, d):
    lines = t(s, d, "lineitem")
    want = lines.select(c("l_orderkey").alias("wanted"), c("l_partkey").alias("item"))
    have = lines.select(c("l_suppkey").alias("owner"), c("l_partkey").alias("item"))
    return resolve.covering(have, want)


@query("""with members as (select distinct l_suppkey as owner, l_partkey % 100 as name, 's' || l_suppkey || '.' || (l_partkey % 100) as member from lineitem), types as (select a.s_suppkey as sub, b.s_suppkey as super from supplier a join supplier b on a.s_nationkey = b.s_nationkey and b.s_suppkey = a.s_suppkey - 25)
select u.member as source, v.member as target from types t join members u on u.owner = t.super join members v on v.owner = t.sub and v.name = u.name qualify row_number() over (partition by t.sub, t.super order by u.name, u.member, v.member) <= 40""")
def override_pairs(s, d):
    lines, sup = t(s, d, "lineitem"), t(s, d, "supplier")
    name = c("l_partkey") % 100
    members = lines.select(c("l_suppkey").alias("owner"), name.alias("name"), F.concat(F.lit("s"), "l_suppkey", F.lit("."), name).alias("member")).distinct()
    a, b = sup.select(c("s_suppkey").alias("sub"), c("s_nationkey").alias("n")), sup.select(c("s_suppkey").alias("super"), c("s_nationkey").alias("n"))
    types = a.withColumn("super", c("sub") - 25).join(b, ["super", "n"]).select("sub", "super")
    return resolve.overriding(types, members)


@query("""with a as (select distinct cast(json_extract(props, '$.k') as bigint) as key, user_id as source from events where event_type = 'click'), b as (select distinct cast(json_extract(props, '$.k') as bigint) as key, user_id as target from events where event_type = 'purchase'),
fa as (select key from a group by 1 having count(*) <= 25), fb as (select key from b group by 1 having count(*) <= 25) select a.source, b.target, a.key from a join b using (key) where a.key in (select key from fa) and a.key in (select key from fb) and a.source <> b.target""")
def key_channel_capped(s, d):
    e = t(s, d, "events").withColumn("key", F.get_json_object("props", "$.k").cast("long"))
    return resolve.key_channel(e.where("event_type = 'click'").select("key", c("user_id").alias("source")), e.where("event_type = 'purchase'").select("key", c("user_id").alias("target")), "key", 25)


@query("""with n as (select p_name as qualified_name, 'p' || p_partkey as id, p_brand as file_path, p_size % 2 = 0 as mark from part) select a.id as source, b.id as target from n a join n b on a.qualified_name = b.qualified_name where not a.mark and b.mark and a.file_path <> b.file_path""")
def same_name_pairs(s, d):
    n = t(s, d, "part").select(c("p_name").alias("qualified_name"), F.concat(F.lit("p"), "p_partkey").alias("id"), c("p_brand").alias("file_path"), "p_size")
    return resolve.same_name_elsewhere(n, c("p_size") % 2 == 0)


@query("""with named as (select p_partkey, p_name || ' ' || p_brand as name from part), cand as (select name, min(p_partkey) as target from named group by 1 having count(*) = 1) select l_orderkey as ref_id, l_linenumber as line, target from lineitem join named on p_partkey = l_partkey join cand using (name)""")
def unique_or_drop(s, d):
    names = t(s, d, "part").select("p_partkey", F.concat("p_name", F.lit(" "), "p_brand").alias("name"))
    refs = t(s, d, "lineitem").select(c("l_orderkey").alias("ref_id"), c("l_linenumber").alias("line"), c("l_partkey").alias("p_partkey")).join(names, "p_partkey")
    return resolve.unique_match(refs, names.select("name", c("p_partkey").alias("target")), "name").select("ref_id", "line", "target")


# ---- counts and rankings ---------------------------------------------------------------------------


@query(STAR + "select kind, count(*) as n from nodes group by 1")
def node_kinds(s, d):
    return analytics.counts(g(s, d).nodes, "kind")


@query(STAR + "select kind, count(*) as n from edges group by 1")
def edge_kinds(s, d):
    return analytics.counts(g(s, d).edges, "kind")


@query(STAR + "select language, count(distinct file_path) as n from nodes group by 1")
def files_by_language(s, d):
    return analytics.counts(analytics.files_of(g(s, d)), "language")


@query("select max(ts) as last_indexed, count(*) as n from events")
def last_indexed(s, d):
    return t(s, d, "events").agg(F.max("ts").alias("last_indexed"), F.count("*").alias("n"))


@query(STAR + "select n.id, (select count(*) from edges where target = n.id) as in_degree, (select count(*) from edges where source = n.id) as out_degree, (select count(*) from edges where target = n.id and kind = 'calls') as calls_in, (select count(*) from edges where source = n.id and kind = 'calls') as calls_out, (select count(*) from edges where source = n.id and kind = 'contains') as children from nodes n")
def node_metrics(s, d):
    return analytics.node_metrics(g(s, d))


@query(STAR + "select id, case kind when 'module' then 0 when 'interface' then 0 when 'namespace' then 1 when 'class' then 2 when 'struct' then 2 else 3 end as depth from nodes")
def node_depths(s, d):
    return analytics.depths(g(s, d))


@query(STAR + "select id, name from nodes n where kind in ('function', 'method', 'class') and not is_exported and not exists (select 1 from edges e where e.target = n.id and e.kind <> 'contains')")
def dead_code(s, d):
    return analytics.dead_code(g(s, d)).select("id", "name")


@query(STAR + "select regexp_extract(file_path, '^(.*)/[^/]*$', 1) as folder, string_agg(file_path, ',' order by file_path) as files from (select distinct file_path from nodes) group by 1")
def module_structure(s, d):
    return analytics.module_structure(analytics.files_of(g(s, d)))


@query(NATION + ", walk as (select source as a, target as b from deps union select w.a, d.target from walk w join deps d on w.b = d.source) select distinct a as id from walk where a = b")
def cycles_in_file_graph(s, d):
    return traverse.cyclic(star.nation_graph(s, d).select(c("source").alias("at"), c("target").alias("to")))


@query(STAR + "select e.target as id, count(distinct e.source) as callers, count(distinct case when not contains(a.file_path, 'ASIA') then a.file_path end) as files, count(distinct case when contains(a.file_path, 'ASIA') then a.file_path end) as test_files from edges e join nodes a on e.source = a.id where e.kind in ('calls', 'references') and e.target in ('interface:1', 'interface:2', 'struct:1', 'struct:2', 'interface:3') group by 1")
def blast_radius(s, d):
    x = g(s, d)
    return analytics.blast_radius(x, traverse.of(x, ["interface:1", "interface:2", "struct:1", "struct:2", "interface:3"]), F.contains("file_path", F.lit("ASIA")))


@query(STAR + "select a.file_path, count(*) as n, string_agg(a.name || ':' || a.start_line, ',' order by a.start_line, a.name) as symbols from (select distinct source from edges where target = 'struct:1' and kind <> 'contains') e join nodes a on e.source = a.id group by 1")
def impact_by_file(s, d):
    x = g(s, d)
    ids = x.edges.where("target = 'struct:1' and kind != 'contains'").select(c("source").alias("id")).distinct()
    return analytics.by_file(x.nodes.join(ids, "id"))


@query(STAR + "select file_path, cast(sum(case when is_exported and start_line % 100 = 0 then 50 when start_line % 10 = 0 then 10 when start_line % 3 = 0 then 3 else 1 end) as bigint) as score from nodes group by 1 having score >= 3")
def file_scores(s, d):
    n = g(s, d).nodes
    return analytics.file_scores(n.select("file_path", (c("is_exported") & (c("start_line") % 100 == 0)).alias("is_named"), (c("start_line") % 10 == 0).alias("is_entry"), (c("start_line") % 3 == 0).alias("is_connected")))


@query("select p_brand as file_path, count(distinct lower(p_name)) as n from part group by 1")
def name_cooccurrence(s, d):
    p = t(s, d, "part")
    return analytics.cooccurrence(p.select(c("p_brand").alias("file_path"), c("p_name").alias("name")), p.select(c("p_name").alias("name")))


@query("select 'nation:' || c_nationkey as id, count(distinct c_custkey) as n from customer group by 1 having n >= 3")
def polymorphic_types(s, d):
    return analytics.polymorphic(t(s, d, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("source"), F.concat(F.lit("nation:"), "c_nationkey").alias("target"), F.lit("implements").alias("kind")))


@query("with top as (select lang as file, count(*) as n from documents group by 1 order by n desc, file limit 20), ranked as (select file, n, cast(sum(n) over () as bigint) as total, row_number() over (order by n desc, file) as nth from top) select file, n, total from ranked where nth = 1 and n >= 3 and n / total >= 0.3")
def top_route_file(s, d):
    return analytics.top_share(analytics.counts(t(s, d, "documents"), "lang").withColumnRenamed("lang", "file"), "file")


@query(STAR + "select file_path, qualified_name, count(*) as n from nodes where kind = 'interface' and contains(file_path, 'Brand#1') group by 1, 2")
def definition_groups(s, d):
    return analytics.definitions(g(s, d).nodes.where("kind = 'interface'"), "Brand#1")


# ---- traversal -------------------------------------------------------------------------------------


@query(STAR + "select e.source as id, e.kind as edge_kind, e.line, a.name from edges e join nodes a on e.source = a.id where e.target = 'interface:1' and e.kind in ('calls', 'references', 'imports', 'instantiates')")
def callers_d1(s, d):
    return traverse.callers(g(s, d), "interface:1").select("id", "edge_kind", "line", "name")


@query(STAR + "select e.target as id, e.kind as edge_kind, e.line, b.name from edges e join nodes b on e.target = b.id where e.source = 'method:7' and e.kind in ('calls', 'references', 'imports', 'instantiates')")
def callees_d1(s, d):
    return traverse.callees(g(s, d), "method:7").select("id", "edge_kind", "line", "name")


_BACK = ", walk as (select 'interface:1' as id, 0 as depth union select e.source, w.depth + 1 from walk w join edges e on e.target = w.id where e.kind in ('calls', 'references', 'imports', 'instantiates') and w.depth < 3)"


@query(STAR + _BACK + " select id, min(depth) as depth from walk where id <> 'interface:1' group by 1")
def callers_d3(s, d):
    return traverse.callers(g(s, d), "interface:1", 3).select("id", "depth")


@query(STAR + """, up as (select 'method:7' as id, 0 as depth union select e.source, w.depth + 1 from up w join edges e on e.target = w.id where e.kind in ('calls', 'references') and w.depth < 2),
down as (select 'method:7' as id, 0 as depth union select e.target, w.depth + 1 from down w join edges e on e.source = w.id where e.kind in ('calls', 'references') and w.depth < 2)
select 'method:7' as id, 0 as depth, 'focal' as role union all select id, min(depth), 'caller' from up where depth > 0 group by 1 union all select id, min(depth), 'callee' from down where depth > 0 group by 1""")
def call_graph(s, d):
    return traverse.call_graph(g(s, d), "method:7")


_TYPES = """with recursive edges as (select 'c' || c_custkey as source, 'n' || c_nationkey as target, 'implements' as kind from customer union all select 'n' || n_nationkey, 'r' || n_regionkey, 'extends' from nation)"""


def _types(s, d) -> Graph:
    a = t(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"), F.lit("implements").alias("kind"))
    b = t(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"), F.lit("extends").alias("kind"))
    e = a.union(b)
    return Graph(e.select(c("source").alias("id")).union(e.select("target")).distinct(), e)


@query(_TYPES + ", up as (select 'n3' as id, 0 as depth union select e.target, u.depth + 1 from up u join edges e on e.source = u.id), down as (select 'n3' as id, 0 as depth union select e.source, u.depth + 1 from down u join edges e on e.target = u.id) select id, min(depth) as depth, 'ancestor' as role from up where depth > 0 group by 1 union all select id, min(depth), 'descendant' from down where depth > 0 group by 1")
def type_hierarchy(s, d):
    return traverse.type_hierarchy(_types(s, d), "n3")


@query(_TYPES + ", up as (select 'c7' as id, 0 as depth union select e.target, u.depth + 1 from up u join edges e on e.source = u.id) select id, min(depth) as depth, 'ancestor' as role from up where depth > 0 group by 1")
def type_hierarchy_up(s, d):
    return traverse.type_hierarchy(_types(s, d), "c7", "up")


@query(STAR + "select e.source as id, e.kind as edge_kind, e.line from edges e where e.target = 'struct:2'")
def usages(s, d):
    return traverse.usages(g(s, d), "struct:2").select("id", "edge_kind", "line")


@query(STAR + ", up as (select 'method:7' as id, 0 as depth union all select e.source, u.depth + 1 from up u join edges e on e.target = u.id and e.kind = 'contains') select id, depth from up where depth > 0")
def ancestors(s, d):
    return traverse.ancestors(g(s, d), "method:7")


@query(STAR + "select target as id from edges where source = 'namespace:3' and kind = 'contains'")
def children(s, d):
    return traverse.children(g(s, d), "namespace:3").select("id")


@query(NATION + ", walk as (select 0 as id, 0 as depth union select d.target, w.depth + 1 from walk w join deps d on d.source = w.id where w.depth < 30) select id, min(depth) as depth from walk group by 1")
def reachable_nations(s, d):
    deps = star.nation_graph(s, d)
    start = s.createDataFrame([(0,)], "id int")
    return traverse.reach(deps.select(c("source").alias("at"), c("target").alias("to")), start)


@query(STAR + ", walk as (select 'module:0' as id, 0 as depth union select e.target, w.depth + 1 from walk w join edges e on e.source = w.id where w.depth < 6) select min(depth) as hops from walk where id = 'interface:5'")
def shortest_path_length(s, d):
    p = traverse.shortest_path(g(s, d), "module:0", "interface:5", longest=6)
    return s.createDataFrame([(len(p) - 1 if p else None,)], "hops int")


@query(STAR + """, inside as (select e.source, e.target from edges e join nodes n on e.source = n.id where e.kind = 'contains' and n.kind in ('class', 'interface', 'struct', 'trait', 'protocol', 'module', 'enum')),
walk as (select 'interface:1' as id, 0 as depth union select x.id, x.depth from (select e.source as id, w.depth + 1 as depth from walk w join edges e on e.target = w.id and e.kind <> 'contains' where w.depth < 3 union all select i.target, w.depth from walk w join inside i on i.source = w.id) x)
select id, min(depth) as depth from walk group by 1""")
def impact_d3(s, d):
    return traverse.impact(g(s, d), "interface:1", 3)


@query(STAR + """, inside as (select e.source, e.target from edges e join nodes n on e.source = n.id where e.kind = 'contains' and n.kind in ('class', 'interface', 'struct', 'trait', 'protocol', 'module', 'enum')),
walk as (select 'class:5' as id, 0 as depth union select x.id, x.depth from (select e.source as id, w.depth + 1 as depth from walk w join edges e on e.target = w.id and e.kind <> 'contains' where w.depth < 2 union all select i.target, w.depth from walk w join inside i on i.source = w.id) x)
select id, min(depth) as depth from walk group by 1""")
def impact_of_class(s, d):
    return traverse.impact(g(s, d), "class:5", 2)


@query(STAR + FILE_GRAPH + ", walk as (select 'src/parts/Brand#12.x' as id, 0 as depth union select f.source_file, w.depth + 1 from walk w join file_edges f on f.target_file = w.id where w.depth < 5 and not contains(w.id, 'AFRICA')) select id, min(depth) as depth from walk where contains(id, 'AFRICA') group by 1")
def affected_files(s, d):
    return traverse.affected_files(traverse.file_graph(g(s, d)), s.createDataFrame([("src/parts/Brand#12.x",)], "id string"), F.contains("id", F.lit("AFRICA")))


@query(STAR + ", walk as (select 'class:5' as id, 0 as depth union select e.target, w.depth + 1 from walk w join edges e on e.source = w.id join nodes n on n.id = e.target where n.kind in ('method', 'class', 'interface') and w.depth < 3) select w.id, min(w.depth) as depth, any_value(n.name) as name from walk w join nodes n on n.id = w.id group by 1")
def traverse_bfs(s, d):
    return traverse.traverse(g(s, d), ["class:5"], 3, node_kinds=("method", "class", "interface")).nodes.select("id", "depth", "name")


@query(STAR + """select distinct role, id from (select 'ancestor' as role, 'class:' || o_custkey as id from orders where o_orderkey = 7 union all select 'ancestor', 'namespace:' || c_nationkey from orders join customer on o_custkey = c_custkey where o_orderkey = 7
union all select 'ancestor', 'module:' || n_regionkey from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderkey = 7
union all select 'incoming', source from edges where target = 'method:7' and kind <> 'contains' union all select 'outgoing', target from edges where source = 'method:7' and kind <> 'contains')""")
def node_context(s, d):
    return traverse.context(g(s, d), "method:7")


@query("""with recursive up as (select 'c' || c_custkey as id, 'c' || c_custkey as at, 0 as depth from customer union all
select u.id, case when starts_with(u.at, 'c') then 'n' || (select c_nationkey from customer where 'c' || c_custkey = u.at) else 'r' || (select n_regionkey from nation where 'n' || n_nationkey = u.at) end, u.depth + 1 from up u where not starts_with(u.at, 'r')),
members as (select 'n' || n_nationkey as owner, n_name as member from nation where n_nationkey % 2 = 0 union all select 'r' || r_regionkey, r_name from region)
select id, 'run' as name, member as found, depth from (select u.id, m.member, u.depth, row_number() over (partition by u.id order by u.depth, m.member) as nth from up u join members m on m.owner = u.at) where nth = 1""")
def supertype_member(s, d):
    members = t(s, d, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("owner"), c("n_name").alias("member")).union(t(s, d, "region").select(F.concat(F.lit("r"), "r_regionkey"), "r_name"))
    start = t(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("run").alias("name"))
    return traverse.first_match_above(_types(s, d).edges, members.withColumn("name", F.lit("run")), start)


_STEPS = [
    f"m{k} as materialized (select n.id, 0.75 * coalesce((select sum(p.mass * b.n / d.degree) from both_ways b join m{k - 1} p on p.id = b.from_id join deg d on d.from_id = b.from_id where b.to_id = n.id), 0) + 0.25 * (case when n.id = 'click' then 1.0 else 0.0 end) as mass from ids n)"
    for k in range(1, 26)
]
_EVENT_GRAPH = """with e as (select event_type as source, lead(event_type) over (partition by user_id order by ts, event_id) as target from events), pairs as (select source, target, count(*) as n from e where target is not null and source <> target group by 1, 2),
both_ways as (select from_id, to_id, cast(sum(n) as double) as n from (select source as from_id, target as to_id, n from pairs union all select target, source, n from pairs) group by 1, 2), deg as (select from_id, sum(n) as degree from both_ways group by 1), ids as (select distinct event_type as id from events),
m0 as (select id, case when id = 'click' then 1.0 else 0.0 end as mass from ids), """


def _walked(rounds: int, what: str) -> str:
    return _EVENT_GRAPH + ", ".join(_STEPS[:rounds]) + f" select {what} from m{rounds}"



@query(_walked(3, "id, round(mass, 6) as mass"))
def random_walk_3(s, d):
    return _event_walk(s, d, 3).select("id", F.round("mass", 6).alias("mass"))


def _event_walk(s, d, rounds):
    e = t(s, d, "events")
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    edges = e.select(c("event_type").alias("source"), after.alias("target")).where("target is not null")
    return walk.walk_with_restart(edges, e.select(c("event_type").alias("id")).distinct(), s.createDataFrame([("click",)], "id string"), rounds=rounds, kinds=None)


@query(_walked(25, "id, round(mass, 6) as mass"))
def random_walk_25(s, d):
    return _event_walk(s, d, 25).select("id", F.round("mass", 6).alias("mass"))


@query(_walked(25, "round(sum(mass), 9) as mass"))
def random_walk_mass(s, d):
    return _event_walk(s, d, 25).agg(F.round(F.sum("mass"), 9).alias("mass"))


@query(STAR + """, calls as (select distinct source as at, target as to_id from edges where kind = 'calls'), named as (select id from nodes where contains(qualified_name, '::Customer#000000001::') or id in ('interface:1', 'interface:2', 'interface:3')),
step as (select id as seed, id, 0 as depth, 0 as streak from (select id from named order by id limit 8) union select s.seed, x.to_id, s.depth + 1, case when x.to_id in (select id from named) then 0 else s.streak + 1 end from step s join calls x on x.at = s.id where s.depth < 6 and (x.to_id in (select id from named) or s.streak < 1))
select seed, id, min(depth) as depth from step where id in (select id from named) and depth > 0 and id <> seed group by 1, 2""")
def flow_chain(s, d):
    x = g(s, d)
    return walk.flow(x.edges, x.nodes.where(c("qualified_name").contains("::Customer#000000001::") | c("id").isin("interface:1", "interface:2", "interface:3")).select("id"))


@query(NATION + """, walks as (
  select [source::varchar] as path from (select distinct source from deps)
  union all select list_append(w.path, e.target::varchar) from walks w join deps e on e.source::varchar = w.path[-1] where len(w.path) < 7 and not list_contains(w.path, e.target::varchar)),
good as (select path, '>' || array_to_string(path, '>') || '>' as line from walks where len(path) >= 3)
select array_to_string(path, '>') as path from good g where not exists (select 1 from good o where o.line <> g.line and contains(o.line, g.line)) order by len(path) desc, line limit 3""")
def call_paths(s, d):
    deps = star.nation_graph(s, d)
    moves = deps.select(c("source").cast("string").alias("at"), c("target").cast("string").alias("to"))
    return walk.paths(moves, moves.select(c("at").alias("id"))).select(F.array_join("path", ">").alias("path"))


# ---- search ----------------------------------------------------------------------------------------


@query(STAR + "select id, name, case when name = 'order_1' then 1.0 when name ilike 'order_1%' then 0.9 when name ilike '%order_1%' then 0.8 else 0.7 end as score from nodes where name ilike '%order_1%' or qualified_name ilike '%order_1%'")
def like_ranked(s, d):
    return search.like_ranked(g(s, d).nodes, "order_1")


@query("with near as (select distinct r_name as name, levenshtein(lower(r_name), 'azia') as distance from region) select 'module:' || r_regionkey as id, r_name as name, distance, 1.0 / (1 + distance) as score from region join near on name = r_name where distance <= 1")
def fuzzy_names(s, d):
    return search.fuzzy(g(s, d).nodes.where("kind = 'module'"), "azia").withColumn("score", c("score").cast("double"))


@query(STAR + """, hits as (select id, lower(name) as name, file_path from nodes where lower(name) in ('red widget', 'blue bolt', 'small ring', 'nation_3', 'order_1')), rare as (select name from hits group by 1 having count(distinct file_path) < 10),
scored as (select id, name, 1.0 + case when file_path in (select file_path from hits where name in (select name from rare)) then 20 else 0 end as score from hits),
top as (select * from scored qualify row_number() over (partition by name order by score desc, id) <= 10) select id, name, cast(score as double) as score from top order by score desc, id limit 50""")
def colocation_search(s, d):
    return search.exact_names(g(s, d).nodes, ["red widget", "blue bolt", "small ring", "nation_3", "order_1"])


@query("select kind, n, bonus from (select kind, count(*) as n, case kind when 'module' then 4 when 'namespace' then 4 when 'class' then 8 when 'struct' then 6 when 'interface' then 9 else 10 end as bonus from (" + STAR + " select kind from nodes) group by 1)")
def kind_bonus(s, d):
    return analytics.counts(g(s, d).nodes, "kind").withColumn("bonus", X.kind_bonus(c("kind")))


@query("""select p_partkey, cast(case when lower(p_name) = 'bluepart' then 80 when lower(p_name) in ('blue', 'part') then 60 when starts_with(lower(p_name), 'bluepart') then floor(10.5 + 30.0 * 8 / length(p_name)) when contains(lower(p_name), 'blue') and contains(lower(p_name), 'part') then 15 when contains(lower(p_name), 'bluepart') then 10 else 0 end as int) as bonus from part""")
def name_bonus(s, d):
    return t(s, d, "part").select("p_partkey", X.name_bonus(c("p_name"), "blue part").cast("int").alias("bonus"))


@query(DOC_PATHS + f"select file_path, cast((case when contains(lower({_NAME}), 'doc1') then 10 else 0 end) + (case when contains(regexp_extract(lower(file_path), '^(.*)/', 1), 'doc1') then 5 when contains(lower(file_path), 'doc1') then 3 else 0 end) + (case when contains(lower({_NAME}), 'lib') then 10 else 0 end) + (case when contains(regexp_extract(lower(file_path), '^(.*)/', 1), 'lib') then 5 when contains(lower(file_path), 'lib') then 3 else 0 end) - (case when {_TEST} then 15 else 0 end) as int) as score from paths")
def path_relevance(s, d):
    return star.document_paths(s, d).select("file_path", X.path_score(c("file_path"), "lib doc1").cast("int").alias("score"))


@query("""with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') as words from documents), n as (select doc_id as id, len(words) as len, len(list_filter(words, lambda x: x = 'the')) as a, len(list_filter(words, lambda x: x = 'license')) as b from w),
st as (select count(*) as N, avg(len) as mean, count(*) filter (a > 0) as da, count(*) filter (b > 0) as db from n)
select id, round((case when a > 0 then ln(1 + (N - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / mean)) else 0 end) + (case when b > 0 then ln(1 + (N - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / mean)) else 0 end), 6) as score from n, st where a > 0 or b > 0""")
def bm25_documents(s, d):
    return search.bm25(t(s, d, "documents"), "doc_id", "text", ["the", "license"]).select("id", F.round("score", 6).alias("score"))


@query("""with w as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) as term from documents) select term, count(distinct doc_id) as df, count(*) as tf from w group by 1""")
def term_statistics(s, d):
    return search.postings(t(s, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(STAR + "select id, name, cast(1.0 as double) as score from nodes where kind in ('struct', 'module') and language = 'go' order by name, id limit 100")
def filter_only_search(s, d):
    return search.filtered(g(s, d).nodes, ("struct", "module"), ("go",), 100)


@query(None)
def search_cascade(s, d):
    return search.search(g(s, d).nodes, "kind:interface path:Brand#1 steel blue", 50).select("id", "name", F.round("score", 6).alias("score"))


@query(None)
def hybrid_retrieval(s, d):
    return search.relevant(g(s, d), "customer order blue", 30).select("id", F.round("score", 6).alias("score"), "file_path")


@query("with a as (select p_partkey as id, p_size::double as score from part where p_size > 20), b as (select p_partkey as id, p_retailprice / 100 as score from part where p_partkey % 3 = 0) select id, max(score) as score from (select * from a union all select * from b) group by 1")
def channel_max_merge(s, d):
    p = t(s, d, "part")
    return search.merge_max(p.where("p_size > 20").select(c("p_partkey").alias("id"), c("p_size").cast("double").alias("score")), p.where("p_partkey % 3 = 0").select(c("p_partkey").alias("id"), (c("p_retailprice") / 100).alias("score")))


@query("with hits as (select p_partkey as id, k as term_group, p_size::double as score from part, (values (2), (3), (5)) v(k) where p_partkey % k = 0), got as (select id, max(score) as score, count(distinct term_group) as n from hits group by 1) select id, round(case when n = 1 then score * 0.3 else score * (1 + 0.5 * (n - 1)) end, 6) as score, n from got")
def corroboration(s, d):
    p = t(s, d, "part")
    hits = p.withColumn("term_group", F.explode(F.array(F.lit(2), F.lit(3), F.lit(5)))).where("p_partkey % term_group = 0").select(c("p_partkey").alias("id"), "term_group", c("p_size").cast("double").alias("score"))
    return search.corroborated(hits, 3).withColumn("score", F.round("score", 6))


# ---- ranges, windows, sets -------------------------------------------------------------------------


@query(STAR + "select id, file_path, rank from (select id, file_path, row_number() over (partition by file_path order by start_line, id) as rank from nodes) where rank <= 5")
def per_file_cap(s, d):
    return intervals.top_per_group(g(s, d).nodes, ["file_path"], ["start_line", "id"], 5).select("id", "file_path", "rank")


@query("""with r as (select user_id as k, event_id as s, event_id + 30 as z, value from events), f as (select *, max(z) over (partition by k order by s, z rows between unbounded preceding and 1 preceding) as reached from r),
i as (select *, sum(case when s <= reached + 200 then 0 else 1 end) over (partition by k order by s, z rows between unbounded preceding and current row) as run from f)
select k, min(s) as start, max(z) as "end", count(*) as n, round(sum(value), 4) as weight, max(value) as top from i group by k, run""")
def gap_merge(s, d):
    r = t(s, d, "events").select(c("user_id").alias("k"), c("event_id").alias("start"), (c("event_id") + 30).alias("end"), c("value").alias("weight"))
    return intervals.merged(r, "k", 200).withColumn("weight", F.round("weight", 4))


@query("select doc_id, source, cast(used as bigint) as used from (select doc_id, source, sum(n_chars) over (partition by source order by n_chars, doc_id rows between unbounded preceding and current row) as used from documents) where used <= 15000")
def running_budget(s, d):
    docs = t(s, d, "documents").select("doc_id", "source", "n_chars")
    return intervals.within_budget(docs, "source", ["n_chars", "doc_id"], "n_chars", 15000).select("doc_id", "source", "used")


@query("""with recursive placed as (select doc_id, source, n_chars, row_number() over (partition by source order by doc_id) as nth from documents),
taken as (
  select source, nth, doc_id, n_chars, true as kept, 15000 - n_chars as remaining from placed where nth = 1
  union all select p.source, p.nth, p.doc_id, p.n_chars, p.n_chars <= t.remaining, case when p.n_chars <= t.remaining then t.remaining - p.n_chars else t.remaining end
  from taken t join placed p on p.source is not distinct from t.source and p.nth = t.nth + 1)
select doc_id, source, n_chars from taken where kept""")
def greedy_budget(s, d):
    docs = t(s, d, "documents").select("doc_id", "source", "n_chars")
    return intervals.greedy_budget(docs, "source", ["doc_id"], "n_chars", 15000)


@query(STAR + "select distinct source, target, kind from edges")
def edge_dedupe(s, d):
    return g(s, d).edges.select("source", "target", "kind").dropDuplicates(["source", "target", "kind"])


@query("""with a as (select distinct l_orderkey as source, l_partkey as target from lineitem where l_returnflag = 'R'), b as (select distinct l_orderkey as source, l_partkey as target from lineitem where l_linestatus = 'F' and l_linenumber <= 3)
select source, target, min(ch) as synthesized_by from (select source, target, 'a_returns' as ch from a union all select source, target, 'b_status' from b) group by 1, 2""")
def channel_dedupe(s, d):
    lines = t(s, d, "lineitem")
    pick = lambda cond: lines.where(cond).select(c("l_orderkey").alias("source"), c("l_partkey").alias("target")).distinct()
    return resolve.first_channel(("a_returns", pick("l_returnflag = 'R'")), ("b_status", pick("l_linestatus = 'F' and l_linenumber <= 3")))


# ---- resolution ------------------------------------------------------------------------------------


@query(r"""select p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as normalized, regexp_extract(p_brand, '[^#]*$') as last_part, upper(left(p_name, 1)) || substr(lower(p_name), 2) as titled, cast(length(p_name) - length(replace(p_name, ' ', '')) + 1 as int) as words, sha256(p_name) as hashed, p_name ~ '[_0-9]' as distinctive from part""")
def scalar_functions(s, d):
    n = c("p_name")
    return t(s, d, "part").select("p_partkey", F.regexp_replace(F.lower(n), "[^a-z0-9]", "").alias("normalized"), F.substring_index("p_brand", "#", -1).alias("last_part"), F.concat(F.upper(F.left(n, F.lit(1))), F.substring(F.lower(n), 2, 10_000)).alias("titled"), F.size(F.split(n, " ", -1)).alias("words"), F.sha2(n, 256).alias("hashed"), n.rlike("[_0-9]").alias("distinctive"))


@query(DOC_PATHS + "select a.doc_id, cast(least(15 * (case when split_part(a.file_path, '/', 1) <> split_part(b.file_path, '/', 1) then 0 when split_part(a.file_path, '/', 2) <> split_part(b.file_path, '/', 2) then 1 when split_part(a.file_path, '/', 3) <> split_part(b.file_path, '/', 3) then 2 else 3 end), 80) as int) as near from paths a join paths b on b.doc_id = a.doc_id + 5")
def path_proximity(s, d):
    p = star.document_paths(s, d)
    b = p.select((c("doc_id") - 5).alias("doc_id"), c("file_path").alias("other"))
    return p.join(b, "doc_id").select("doc_id", resolve.proximity(c("file_path"), c("other")).alias("near"))


_CANDIDATES = """
with nodes as (select 'p' || p_partkey as id, split_part(p_name, ' ', 1) as name, 'src/' || p_brand || '/' || p_type || '.x' as file_path, case when p_size % 2 = 0 then 'go' else 'java' end as language, case when p_size % 3 = 0 then 'method' else 'class' end as kind, p_size as start_line, p_size > 25 as is_exported from part),
refs as (select p_partkey as ref_id, split_part(p_name, ' ', 1) as ref_name, 'src/' || p_brand || '/main.x' as ref_file, 10 as ref_line, 'go' as ref_language from part),
crowd as (select name, count(*) as n from nodes group by 1 having n <= 500),
scored as (select r.ref_id, x.id as target, w.n, (case when x.language = r.ref_language then 50 else -80 end) + (case when split_part(x.file_path, '/', 2) = split_part(r.ref_file, '/', 2) then 30 else 15 end) + (case when x.kind = 'method' then 25 else 0 end) + (case when x.is_exported then 10 else 0 end) as score,
  (case when split_part(x.file_path, '/', 2) = split_part(r.ref_file, '/', 2) then 30 else 15 end) as near, x.language = r.ref_language as same from refs r join nodes x on x.name = r.ref_name join crowd w on w.name = x.name),
best as (select * from scored qualify row_number() over (partition by ref_id order by score desc, target) = 1)
"""


def _candidates(s, d):
    p = t(s, d, "part")
    name = F.substring_index("p_name", " ", 1)
    nodes = p.select(F.concat(F.lit("p"), "p_partkey").alias("id"), name.alias("name"), F.concat(F.lit("src/"), "p_brand", F.lit("/"), "p_type", F.lit(".x")).alias("file_path"), F.when(c("p_size") % 2 == 0, "go").otherwise("java").alias("language"), F.when(c("p_size") % 3 == 0, "method").otherwise("class").alias("kind"), c("p_size").alias("start_line"), (c("p_size") > 25).alias("is_exported"))
    refs = p.select(c("p_partkey").alias("ref_id"), name.alias("ref_name"), F.lit("calls").alias("ref_kind"), F.concat(F.lit("src/"), "p_brand", F.lit("/main.x")).alias("ref_file"), F.lit(10).alias("ref_line"), F.lit("go").alias("ref_language"))
    return nodes, refs


@query(_CANDIDATES + "select ref_id, target, cast(score as double) as score, n, case when n = 1 then (case when same then 0.9 else 0.5 end) when near >= 30 then 0.7 else 0.4 end as confidence from best where score > -1")
def best_candidate(s, d):
    nodes, refs = _candidates(s, d)
    return resolve.by_name(refs, nodes).withColumn("confidence", c("confidence").cast("double"))


_CASCADE = PAGE_REFS + """, cand as (select lower(split_part(p_name, ' ', 1)) as word, min(p_partkey) as target, count(*) as n from part group by 1), r as (select page_id * 1000000 + position as ref_id, name from named),
hits as (select ref_id, target, case when n = 1 then 0.9 else 0.4 end as confidence, 0 as rank, 'exact' as resolved_by from r join cand on word = lower(name) union all select ref_id, min(n_nationkey), 0.5, 1, 'prefix' from r join nation on left(lower(n_name), 1) = left(lower(name), 1) group by 1)
select ref_id, target, confidence, resolved_by from hits qualify row_number() over (partition by ref_id order by confidence desc, rank, target) = 1"""


@query(_CASCADE)
def resolve_cascade(s, d):
    refs = star.page_references(s, d).withColumn("ref_id", c("page_id") * 1_000_000 + c("position")).select("ref_id", F.lower("name").alias("name"))
    words = t(s, d, "part").groupBy(F.lower(F.substring_index("p_name", " ", 1)).alias("name")).agg(F.min("p_partkey").alias("target"), F.count("*").alias("n"))
    exact = refs.join(words, "name").select("ref_id", "target", F.when(c("n") == 1, 0.9).otherwise(0.4).alias("confidence"))
    nations = t(s, d, "nation").groupBy(F.left(F.lower("n_name"), F.lit(1)).alias("first")).agg(F.min("n_nationkey").cast("long").alias("target"))
    prefix = refs.withColumn("first", F.left("name", F.lit(1))).join(nations, "first").select("ref_id", "target", F.lit(0.5).alias("confidence"))
    return resolve.first_strategy(("exact", exact), ("prefix", prefix))


@query("select resolved_by, count(*) as n from (" + _CASCADE + ") group by 1")
def resolution_stats(s, d):
    return analytics.counts(resolve_cascade(s, d), "resolved_by")


@query("select 'n' || n_nationkey as source, case when n_regionkey = 1 then 'i' else 'c' end || n_regionkey as target, case when n_nationkey % 2 = 0 then (case when n_regionkey = 1 then 'implements' else 'extends' end) else (case when n_regionkey = 1 then 'calls' else 'instantiates' end) end as kind from nation")
def edge_promotion(s, d):
    n = t(s, d, "nation")
    target = F.concat(F.when(c("n_regionkey") == 1, "i").otherwise("c"), "n_regionkey")
    edges = n.select(F.concat(F.lit("n"), "n_nationkey").alias("source"), target.alias("target"), F.when(c("n_nationkey") % 2 == 0, "extends").otherwise("calls").alias("kind"))
    nodes = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("class").alias("kind")).union(t(s, d, "region").select(F.concat(F.when(c("r_regionkey") == 1, "i").otherwise("c"), "r_regionkey"), F.when(c("r_regionkey") == 1, "interface").otherwise("class")))
    return resolve.promoted(edges, nodes)


@query(r"""select 'page' || page_id as file_path, cast(line as int) as line, unnest(regexp_extract_all(part, 'class="([a-z]+)"', 1)) as key from (select page_id, unnest(string_split(html, chr(10))) as part, generate_subscripts(string_split(html, chr(10)), 1) as line from pages)""")
def pattern_extraction(s, d):
    pages = t(s, d, "pages").select(F.concat(F.lit("page"), "page_id").alias("file_path"), c("html").alias("text"))
    return resolve.calls_in_text(pages, 'class="([a-z]+)"')


@query("""with recursive walk as (select n_nationkey as ref_id, n_nationkey as file, 0 as d from nation union all select w.ref_id, (w.file * 3 + 1) % 25, w.d + 1 from walk w where w.d < 7), hits as (select w.ref_id, w.d, r_name as target from walk w join nation on n_nationkey = w.file join region on n_regionkey = r_regionkey where w.file % 6 = 0)
select ref_id, target from hits qualify row_number() over (partition by ref_id order by d, target) = 1""")
def reexport_chasing(s, d):
    n = t(s, d, "nation")
    wanted = n.select(c("n_nationkey").alias("ref_id"), c("n_nationkey").alias("file_path"), F.lit("x").alias("name"))
    exports = n.select(c("n_nationkey").alias("file_path"), F.lit("x").alias("name"), ((c("n_nationkey") * 3 + 1) % 25).alias("from_path"), F.lit("x").alias("from_name"))
    declared = n.where("n_nationkey % 6 = 0").join(t(s, d, "region"), c("n_regionkey") == c("r_regionkey")).select(c("n_nationkey").alias("file_path"), F.lit("x").alias("name"), c("r_name").alias("target"))
    return resolve.chase_exports(wanted, exports, declared)


# ---- keeping fresh ---------------------------------------------------------------------------------


@query(SNAPSHOTS + "select coalesce(d.path, i.path) as path, case when i.path is null then 'added' when d.path is null then 'removed' else 'modified' end as change from disk d full join idx i on d.path = i.path where i.path is null or d.path is null or d.hash <> i.hash")
def reconcile(s, d):
    return sync.reconcile(*star.snapshots(s, d))


@query(SNAPSHOTS + "select d.path from disk d join idx i on d.path = i.path where d.hash <> i.hash")
def stale_files(s, d):
    return sync.stale(*star.snapshots(s, d))


@query("""with f as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 12 hour then 0 else 1 end as fresh from events), r as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows between unbounded preceding and current row) as run from f)
select user_id as path, min(ts) as start, max(ts) as last, count(*) as n from r group by user_id, run""")
def debounce_sessions(s, d):
    return intervals.debounced(t(s, d, "events").select(c("user_id").alias("path"), "ts"), "path", "ts", "12 hours")


@query("select user_id as path, min(ts) as first_seen, max(ts) as last_seen, false as indexing from events group by 1 having max(ts) > timestamp '2024-01-30 12:00:00'")
def pending_after_sync(s, d):
    return sync.pending(t(s, d, "events").select(c("user_id").alias("path"), "ts"), "2024-01-30 12:00:00")


@query("with p as (select user_id from events group by 1 having max(ts) > timestamp '2024-01-30 12:00:00') select event_id, user_id as file_path, user_id in (select user_id from p) as stale from events where event_type = 'purchase'")
def staleness_banner(s, d):
    e = t(s, d, "events")
    return sync.banner(e.where("event_type = 'purchase'").select("event_id", c("user_id").alias("file_path")), sync.pending(e.select(c("user_id").alias("path"), "ts"), "2024-01-30 12:00:00"))


@query("""with f as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 12 hour then 0 else 1 end as fresh from events), r as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows between unbounded preceding and current row) as run from f)
select user_id as path, min(ts) as start, max(ts) as last, count(*) as n from r group by user_id, run having max(ts) + interval 13 hour <= (select max(ts) from events)""")
def debounce_stream(s, d):
    """Bursts that the watermark has passed; those still open at the end of the feed stay in its state."""
    feed = s.readStream.schema(t(s, d, "events").schema).parquet(f"{d}/events*")
    changes = feed.select(c("user_id").alias("path"), c("ts").cast("timestamp").alias("ts"))
    done = sync.run_feed(s, changes, "12 hours", "1 hour", f"bursts_{uuid.uuid4().hex}")
    return done.select("path", c("start").cast("timestamp_ntz").alias("start"), c("last").cast("timestamp_ntz").alias("last"), "n")


@query(None)
def code_extraction(s, d):
    """Symbols of small source files made from the tables' names."""
    rows = t(s, d, "nation").select(F.concat(F.lit("src/n"), "n_nationkey", F.lit(".py")).alias("path"), F.concat(F.lit("class "), F.initcap(F.regexp_replace("n_name", " ", "_")), F.lit(":\n    def run(self):\n        return helper("), c("n_nationkey").cast("string"), F.lit(")\n\ndef helper(x):\n    return x\n")).alias("text"), F.lit("python").alias("language"))
    graph, refs = code.graph_of(code.extract(rows))
    found = resolve.by_name(refs, graph.nodes.where("kind != 'file'"))
    return found.join(refs, "ref_id").select("from_id", "ref_name", "target", "confidence")
