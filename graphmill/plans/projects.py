"""Queries of whole projects: when their changed files are synced, and the routes of the frameworks that they use."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill import store
from graphmill.operators import frameworks
from graphmill.sources import code, star
from graphmill.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@_query("""
with recursive e as (
  select user_id::varchar as path, epoch_us(ts) as "at", case event_type when 'error' then 'locked' when 'purchase' then 'synced' when 'signup' then 'failed' else 'changed' end as what
  from events where user_id is not null and ts is not null and event_type is not null),
m as (select max("at") // 1000 * 1000 - 3600000000 as mark from e),
o as (select e.*, row_number() over (partition by path order by "at", what) as nth from e, m where "at" <= mark),
walk as (
  select distinct path, 0::bigint as nth, null::bigint as "at", null::bigint as first, null::bigint as last, 0::bigint as changes, null::bigint as due, null::bigint as started, 0 as failures, false as dead from o
  union all
  select path, nth, "at",
    case when changed then coalesce(first, "at") when clean then null else first end, case when changed then "at" when clean then null else last end, case when changed then changes + 1 when clean then 0 else changes end,
    case when changed then case when started is null then "at" + 21600000000 end when not ended then due when clean or gone then null when locked then "at" + least(86400000000, 21600000000 * (1 << failures)) else "at" + 21600000000 end,
    case when ended then null else started end, case when locked then failures + 1 when ended then 0 else failures end, dead or gone
  from (select *, ended and what = 'synced' and last <= started as clean, ended and what = 'locked' as locked, ended and what = 'locked' and failures + 1 > 2 as gone
    from (select *, what = 'changed' and not dead as changed, what <> 'changed' and not dead and started is not null as ended
      from (select w.path, o.nth, o."at", o.what, w.first, w.last, w.changes, w.failures, w.dead, case when w.due <= o."at" then null else w.due end as due, case when w.due <= o."at" then w.due else w.started end as started
        from walk w join o on o.path = w.path and o.nth = w.nth + 1)))),
rows as (
  select w.path, 'sync' as action, w.due as "at", w.failures, w.first, w.last, w.changes from walk w cross join m left join o on o.path = w.path and o.nth = w.nth + 1 where w.due <= coalesce(o."at", m.mark)
  union all select path, 'degraded', "at", failures, first, last, changes from (select *, lag(dead) over (partition by path order by nth) as before from walk) where dead and not before)
select path, action, make_timestamp("at") as "at", failures, make_timestamp(first) as first_seen, make_timestamp(last) as last_seen, changes from rows""")
def watched_syncs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as changes of a file and ends of its syncs, replayed as a stream: six hours of quiet, waits up to a day, given up after two refusals."""
    feed = spark.readStream.schema(star.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*")
    kind = F.col("event_type")
    what = F.when(kind == "error", "locked").when(kind == "purchase", "synced").when(kind == "signup", "failed").when(kind.isNotNull(), "changed")
    due = watch.due_syncs(feed.select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"), what.alias("what")), "1 hour", 21_600_000, 86_400_000, 2)
    done = watch.followed(due, f"watched_{uuid.uuid4().hex}")
    return done.select("path", "action", "failures", "changes", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("at", "first_seen", "last_seen")))


@_query("""
with o as (select o_custkey as c, o_orderkey as o, o_orderkey // 4 % 3 as form, row_number() over (partition by o_custkey order by o_orderkey) + 1 as line from orders)
select 'src/routes/c' || c || '.js' as file_path, line::int as line, case form when 0 then 'GET /o' else 'POST /o' end || o as name, case form when 0 then 'list' || o % 5 else 'save' || o % 4 end as ref_name, case form when 0 then 'references' else 'calls' end as ref_kind from o where form < 2
union all select 'src/S' || s_suppkey || '.java', 4, 'GET /n' || s_nationkey || '/s' || s_suppkey, 'show' || s_suppkey, 'references' from supplier
union all select 'src/S' || s_suppkey || '.java', 7, 'POST /n' || s_nationkey, 'make' || s_suppkey, 'references' from supplier
union all select 'p' || p_partkey // 50 || '/urls.py', (2 + row_number() over (partition by p_partkey // 50 order by p_partkey))::int, 'parts/' || p_partkey || '/', case when p_partkey % 3 = 0 then 'p' || p_partkey % 7 || '.urls' else 'Part' || p_partkey % 9 end,
  case when p_partkey % 3 = 0 then 'imports' else 'references' end from part""")
def framework_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes and what handles them in sources made of the tables: a script a customer with a line an order, a Java class a supplier, a Python file for fifty parts."""
    t = lambda name: star.table(spark, sf_dir, name)
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    o, s, n, p = F.col("o_orderkey"), F.col("s_suppkey"), F.col("s_nationkey"), F.col("p_partkey")
    form = F.floor(o / 4) % 3
    line = F.when(form == 0, say("app.get('/o", o, "', auth, x.list", o % 5, ");")).when(form == 1, say("router.post('/o", o, "', (q, r) => { r.json(save", o % 4, "(q)); });")).otherwise(say("// app.get('/o", o, "', y); const s = \"app.get('/z', y)\""))
    body = lambda line, key: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, line.alias("line")))), lambda x: x["line"]), "\n")
    scripts = t("orders").groupBy("o_custkey").agg(body(line, o).alias("body")).select(say("src/routes/c", F.col("o_custkey"), ".js").alias("path"), F.concat(F.lit("const app = require('express')();\n"), "body").alias("text"), F.lit("javascript").alias("language"))
    java = say("@RestController\n@RequestMapping(\"/n", n, "/\")\npublic class S", s, " {\n    @GetMapping(\"/s", s, "\")\n    public String show", s, "() {\n    }\n    @PostMapping\n    public String make", s, "() {\n    }\n}\n")
    classes = t("supplier").select(say("src/S", s, ".java").alias("path"), java.alias("text"), F.lit("java").alias("language"))
    view = F.when(p % 3 == 0, say("include('p", p % 7, ".urls')")).otherwise(say("views.Part", p % 9, ".as_view()"))
    urls = t("part").groupBy(F.floor(p / 50).alias("folder")).agg(body(say("    path('parts/", p, "/', ", view, "),"), p).alias("body"))
    urls = urls.select(say("p", F.col("folder"), "/urls.py").alias("path"), F.concat(F.lit("from django.urls import path\nurlpatterns = [\n"), "body", F.lit("\n]\n")).alias("text"), F.lit("python").alias("language"))
    project = spark.createDataFrame([("requirements.txt", "Django==5\n", "config")], urls.schema)
    files = store.settled(scripts.unionByName(classes).unionByName(urls).unionByName(project), "files")
    nodes = store.settled(code.graph_of(code.extract(files.where("language = 'java'")))[0].nodes, "nodes")
    made, refs = frameworks.routes(files, nodes, frameworks.detected(files))
    return made.select(F.col("id").alias("from_id"), "file_path", F.col("start_line").alias("line"), "name").join(refs, "from_id").select("file_path", "line", "name", "ref_name", "ref_kind")
