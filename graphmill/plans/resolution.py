"""Queries of the resolution strategies over symbols made of the tables, and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill import store
from graphmill.operators import incremental, names
from graphmill.sources import star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The symbols and references of star.symbols in SQL.
SYMBOLS = """
with recursive owner as (select s_suppkey as s, 'Part' || (s_suppkey % 40) || 'RuleEngine' as name, 'n' || s_nationkey || '::Part' || (s_suppkey % 40) || 'RuleEngine' as qn, 'src/n' || s_nationkey || '/S' || s_suppkey || '.x' as file_path, ['java','kotlin','python'][1 + s_suppkey % 3] as language from supplier),
sold as (select distinct l_suppkey as s, l_partkey % 50 as m from lineitem),
nodes as (
  select 'class:' || s as id, 'class' as kind, name, qn as qualified_name, file_path, language, 1 as start_line, null as return_type from owner
  union all select 'method:' || s || ':' || m, 'method', 'act' || m, qn || '::act' || m, file_path, language, m + 2, case when m % 5 = 0 then 'self' else 'Part' || (m % 40) || 'RuleEngine' end from sold join owner using (s)
  union all select 'alone:' || s, 'method', 'only' || s, qn || '::only' || s, file_path, language, 60, null from owner
  union all select 'function:' || p_partkey, 'function', 'do' || (p_partkey % 701), 'do' || (p_partkey % 701), 'lib/l' || (p_partkey % 3) || '/F' || (p_partkey % 20) || '.x', ['java','go','typescript','python'][1 + p_partkey % 4], p_size, null from part
  union all select distinct 'file:' || path, 'file', leaf, path, path, language, 1, null from (select 'doc/s' || (doc_id % 7) || '/t' || (doc_id % 3) || '/D' || (doc_id % 60) || '.md' as path, 'D' || (doc_id % 60) || '.md' as leaf, ['c','objc','java'][1 + doc_id % 60 % 3] as language from documents)),
o as (select o_orderkey as o, o_custkey as u, o_orderkey % 12 as form from orders),
refs as (select o as ref_id, case when form = 4 and u % 2 = 0 then 'n' || (u % 25) || '.Part' || (u % 40) || 'RuleEngine' when form = 8 and u % 5 = 0 then 'items.append' when form = 8 and u % 5 = 1 then 'list.append' else
   ['D' || (u % 70) || '.md', 't' || (u % 3) || '/D' || (u % 70) || '.md', 'doc/s' || (u % 7) || '/t' || (u % 3) || '/D' || (u % 70) || '.md', 'Part' || (u % 40) || 'RuleEngine::act' || (o % 50), 'n' || (u % 25) || '::Part' || (u % 40) || 'RuleEngine',
    'part' || (u % 40) || 'RuleEngine.act' || (o % 50), 'Part' || (u % 40) || 'RuleEngine.act' || (o % 50), 'engineThing.act' || (o % 50), 'thing.only' || (u % 200), 'DO' || (u % 800), 'do' || (u % 800), 'Part' || (u % 40) || 'RuleEngine.act' || (o % 50) || '().act' || ((o * 7) % 50)][1 + form] end as ref_name,
  case when form = 4 and u % 2 = 0 then 'imports' when form = 10 and u % 5 < 3 then 'function_ref' when form = 9 then 'references' else 'calls' end as ref_kind,
  case when form = 10 then 'lib/l' || (u % 3) || '/F' || (u % 20) || '.x' else 'doc/s' || (u % 7) || '/t' || (u % 3) || '/R.md' end as ref_file,
  cast(o % 100 as int) as ref_line, ['java','kotlin','python'][1 + u % 3] as ref_language, 'function:' || u as from_id from o),
fam as (select * from (values ('java','jvm'),('kotlin','jvm'),('typescript','web'),('c','c'),('objc','apple')) f(lang, fam)),
kin as (select a.language as x, b.language as y, a.language = b.language or coalesce(p.fam = q.fam, false) as same, coalesce(p.fam <> q.fam, false) as crosses from (select distinct language from nodes union select distinct ref_language from refs) a(language) cross join (select distinct language from nodes union select distinct ref_language from refs) b(language) left join fam p on p.lang = a.language left join fam q on q.lang = b.language)
"""
SHARED = "len(list_filter(range(1, 1 + least(len(string_split({a}, '/')), len(string_split({b}, '/'))) - 1), lambda i: list_slice(string_split({a}, '/'), 1, i) = list_slice(string_split({b}, '/'), 1, i)))"
FOLDER = "regexp_extract({0}, '^(.*)/[^/]*$', 1)"
WORDS = r"list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[\s._:/\\]+'), lambda w: length(w) > 1), lambda w: lower(w))"

STRATEGY = {
    "path": f"""select ref_id, id as target, conf as confidence from (select *, row_number() over (partition by ref_id order by conf desc, case when conf = 0.85 then apart else 0 end, case when conf = 0.85 then -near else 0 end, file_path, start_line, id) as nth from (
  select r.ref_id, n.id, n.file_path, n.start_line, {FOLDER.format('n.file_path')} <> {FOLDER.format('r.ref_file')} as apart, least(80, 15 * {SHARED.format(a='r.ref_file', b='n.file_path')}) + case when k.same then 5 else 0 end as near,
   case when n.qualified_name = r.ref_name or n.file_path = r.ref_name then 0.95 when ends_with(n.qualified_name, r.ref_name) or ends_with(n.file_path, r.ref_name) then 0.85 when count(*) over (partition by r.ref_id) = 1 then 0.7 end as conf
  from refs r join nodes n on n.kind = 'file' and n.name = string_split(r.ref_name, '/')[-1] join kin k on k.x = n.language and k.y = r.ref_language
  where contains(r.ref_name, '/') or regexp_matches(r.ref_name, '\\.[A-Za-z][A-Za-z0-9]{{0,3}}$')) where conf is not null) where nth = 1""",
    "qualified": """select ref_id, target, confidence from (
  select r.ref_id, min(n.id) as target, 0.95 as confidence, 0 as rank from refs r join nodes n on n.qualified_name = r.ref_name where contains(r.ref_name, '::') or contains(r.ref_name, '.') group by r.ref_id having count(*) = 1
  union all select ref_id, id, 0.85, 1 from (select r.ref_id, n.id, row_number() over (partition by r.ref_id order by n.file_path, n.start_line, n.id) as nth from refs r join nodes n on n.name = regexp_extract(r.ref_name, '[^:.]*$') and ends_with(n.qualified_name, r.ref_name) where contains(r.ref_name, '::') or contains(r.ref_name, '.')) where nth = 1)
  qualify row_number() over (partition by ref_id order by rank) = 1""",
    "package": f"""select r.ref_id, n.id as target, 0.95 as confidence from refs r join nodes n on n.qualified_name = replace(r.ref_name, '.', '::') where r.ref_kind = 'imports' and r.ref_language in ('java', 'kotlin')
  qualify row_number() over (partition by r.ref_id order by -{SHARED.format(a='r.ref_file', b='n.file_path')}, n.file_path, n.start_line, n.id) = 1""",
    "chain": """select ref_id, id as target, 0.85 as confidence from (select c.ref_id, m.id, m.file_path, m.start_line from (select * from (
   select r.ref_id, r.ref_language, regexp_extract(r.ref_name, '\\(\\)\\.(\\w+)$', 1) as method, case when g.return_type = 'self' then regexp_extract(r.ref_name, '^(\\w+)\\.', 1) else g.return_type end as type,
    row_number() over (partition by r.ref_id order by g.file_path, g.start_line, g.id) as nth from refs r join nodes g on g.language = r.ref_language and g.kind = 'method' and g.return_type is not null and g.name = regexp_extract(r.ref_name, '\\.(\\w+)\\(\\)', 1) and ends_with(g.qualified_name, '::' || regexp_extract(r.ref_name, '^(\\w+)\\.', 1) || '::' || g.name)
    where contains(r.ref_name, '()') and r.ref_language in ('java', 'kotlin')) where nth = 1) c join nodes m on m.kind = 'method' and m.language = c.ref_language and m.name = c.method and ends_with(m.qualified_name, '::' || c.type || '::' || c.method))
  qualify row_number() over (partition by ref_id order by file_path, start_line, id) = 1""",
    "receiver": f"""select ref_id, target, confidence from (
  select ref_id, id as target, case when form = 0 then 0.85 else 0.8 end as confidence from (select r.ref_id, f.form, k.file_path, k.start_line as line, k.id as class, m.start_line, m.id from rec r join (values (0), (1)) f(form) on true
    join nodes k on k.kind = 'class' and k.language = r.ref_language and k.name = case when form = 0 then receiver else upper(receiver[1]) || receiver[2:] end and (form = 0 or k.name <> receiver) join nodes m on m.kind = 'method' and m.file_path = k.file_path and m.name = method and contains(m.qualified_name, k.name))
    qualify row_number() over (partition by ref_id order by form, file_path, line, class, start_line, id) = 1
  union all select ref_id, id, case when own = 1 then 0.7 else 0.65 end from (select *, row_number() over (partition by ref_id order by -score, file_path, start_line, id) as nth from (
    select r.ref_id, m.id, m.file_path, m.start_line, m.language = r.ref_language as same, sum(case when m.language = r.ref_language then 1 else 0 end) over (partition by r.ref_id) as own, count(*) over (partition by r.ref_id) as total,
      len(list_filter({WORDS.format('r.receiver')}, lambda w: list_contains({WORDS.format('m.qualified_name')}, w))) + case when m.language = r.ref_language then 1 else 0 end as score
    from rec r join nodes m on m.kind = 'method' and m.name = r.method and m.name in (select name from nodes group by 1 having count(*) <= 500)) where same or own = 0) where nth = 1 and (own = 1 or (total > 1 and score >= 2)))
  qualify row_number() over (partition by ref_id order by confidence desc) = 1""",
    "exact": f"""select ref_id, id as target, case when n = 1 then (case when same then 0.9 else 0.5 end) when near >= 30 then 0.7 else 0.4 end as confidence from (select *, row_number() over (partition by ref_id order by score desc, id) as nth from (
  select r.ref_id, n.id, c.n, n.language = r.ref_language as same, least(80, 15 * {SHARED.format(a='r.ref_file', b='n.file_path')}) as near,
    case when n.file_path = r.ref_file then 100 + greatest(0, 20 - abs(n.start_line - r.ref_line) / 10.0) else 0 end + least(80, 15 * {SHARED.format(a='r.ref_file', b='n.file_path')}) + case when n.language = r.ref_language then 50 else -80 end + case when r.ref_kind = 'calls' and n.kind in ('function', 'method') then 25 else 0 end as score
  from refs r join nodes n on n.name = r.ref_name join (select name, count(*) as n from nodes group by 1 having count(*) <= 500) c on c.name = n.name)) where nth = 1 and score > -1""",
    "fuzzy": """select ref_id, case when own = 1 then mine else anyone end as target, case when own = 1 then 0.5 else 0.3 end as confidence from (
  select r.ref_id, count(*) filter (n.language = r.ref_language) as own, min(n.id) filter (n.language = r.ref_language) as mine, count(*) as total, min(n.id) as anyone from refs r join nodes n on lower(n.name) = lower(r.ref_name) and n.kind in ('function', 'method', 'class') join kin k on k.x = n.language and k.y = r.ref_language
  where case when r.ref_kind in ('references', 'function_ref') then k.same when r.ref_kind = 'imports' then not k.crosses else true end group by 1) where own = 1 or (own = 0 and total = 1)""",
    "value": """select ref_id, case when here > 0 then near else anyone end as target, case when here = 1 then 0.95 when here > 1 then 0.9 else 0.8 end as confidence from (
  select r.ref_id, count(*) as total, count(*) filter (n.file_path = r.ref_file) as here, arg_min(n.id, (n.start_line, n.id)) filter (n.file_path = r.ref_file) as near, min(n.id) as anyone from refs r join nodes n on n.name = r.ref_name join kin k on k.x = n.language and k.y = r.ref_language
  where r.ref_kind = 'function_ref' and k.same and n.id <> r.from_id and (n.kind = 'function' or (n.kind = 'method' and r.ref_language <> 'python')) group by 1) where here > 0 or total = 1""",
}
RECEIVERS = r""", rec as (select *, regexp_extract(ref_name, '^([\w.]+)\.(\w+:?(?:\w+:)*)$|^(\w+)::(\w+)$', 1) || regexp_extract(ref_name, '^([\w.]+)\.(\w+:?(?:\w+:)*)$|^(\w+)::(\w+)$', 3) as receiver,
  regexp_extract(ref_name, '^([\w.]+)\.(\w+:?(?:\w+:)*)$|^(\w+)::(\w+)$', 2) || regexp_extract(ref_name, '^([\w.]+)\.(\w+:?(?:\w+:)*)$|^(\w+)::(\w+)$', 4) as method from refs where regexp_matches(ref_name, '^([\w.]+)\.(\w+:?(?:\w+:)*)$|^(\w+)::(\w+)$'))
"""
BASE = SYMBOLS + RECEIVERS


def _plain(sql: str) -> str:
    return f"select ref_id, target, cast(confidence as double) as confidence from ({sql})"


_ORDER = ("path", "qualified", "chain", "receiver", "exact", "fuzzy")
_CASCADE = BASE + "".join(f", s_{n} as ({STRATEGY[n]})" for n in STRATEGY) + f""", named as (select * from (select *, row_number() over (partition by ref_id order by rank) as nth from (
  {' union all '.join(f"select ref_id, target, confidence, '{n}' as resolved_by, {i} as rank from s_{n} join refs using (ref_id) where ref_kind <> 'function_ref'" for i, n in enumerate(_ORDER))})) where nth = 1),
gated as (select g.* from named g join refs r using (ref_id) join nodes n on n.id = g.target join kin k on k.x = n.language and k.y = r.ref_language where case when r.ref_kind in ('references', 'function_ref') then k.same when r.ref_kind = 'imports' then not k.crosses else true end),
every as (select ref_id, target, confidence, 'package' as resolved_by, 0 as rank from s_package union all select ref_id, target, confidence, 'value', 0 from s_value union all select ref_id, target, confidence, resolved_by, 1 from gated)
select ref_id, target, cast(confidence as double) as confidence, resolved_by from every qualify row_number() over (partition by ref_id order by confidence desc, rank, target) = 1"""


def _strategy(name: str, key: str, f: names.Resolver) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes, refs = star.symbols(spark, sf_dir)
        return f(refs, nodes).select("ref_id", "target", F.col("confidence").cast("double").alias("confidence"))

    QUERIES[name], ORACLE_SQL[name] = run, BASE + _plain(STRATEGY[key])


for _name, _key, _f in (
    ("resolve_by_path", "path", names.by_path), ("resolve_by_qualified_name", "qualified", names.by_qualified), ("resolve_by_package", "package", names.by_package), ("resolve_by_chain", "chain", names.by_chain),
    ("resolve_by_receiver", "receiver", names.by_receiver), ("resolve_by_lower_name", "fuzzy", names.by_lower_name), ("resolve_function_values", "value", names.as_value),
):
    _strategy(_name, _key, _f)


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@_query(_CASCADE)
def resolve_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, refs = (store.settled(df, "symbols") for df in star.symbols(spark, sf_dir))
    return names.cascade(refs, nodes).withColumn("confidence", F.col("confidence").cast("double"))


@_query(BASE + """select ref_id, ref_name from refs r where exists (select 1 from nodes n where n.name = ref_name) or exists (select 1 from nodes n where n.name in (select unnest([string_split(ref_name, '.')[1], regexp_replace(ref_name, '^[^.]*\\.', ''), string_split(ref_name, '.')[-1], upper(ref_name[1]) || string_split(ref_name, '.')[1][2:]])) and contains(ref_name, '.'))
  or exists (select 1 from nodes n where contains(ref_name, '::') and n.name in (string_split(ref_name, '::')[1], string_split(ref_name, '::')[-1])) or exists (select 1 from nodes n where n.name = string_split(ref_name, '/')[-1])""")
def possible_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, refs = star.symbols(spark, sf_dir)
    return names.possible(refs, nodes).select("ref_id", "ref_name")


@_query(BASE + "select ref_id, ref_name from refs where not (ref_language = 'python' and ref_name in ('items.append', 'list.append'))")
def references_without_built_ins(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, refs = star.symbols(spark, sf_dir)
    return names.without_built_ins(refs, nodes).select("ref_id", "ref_name")


@_query(SYMBOLS + "select x, y, same, crosses from kin")
def language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, refs = star.symbols(spark, sf_dir)
    every = nodes.select("language").union(refs.select("ref_language")).distinct()
    pairs = every.select(F.col("language").alias("x")).join(F.broadcast(every.select(F.col("language").alias("y"))))
    return pairs.select("x", "y", names.same_family(F.col("x"), F.col("y")).alias("same"), names.crosses_families(F.col("x"), F.col("y")).alias("crosses"))


@_query(_CASCADE)
def scoped_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The references after one file in seven was edited: resolved before, and of those only what the edit touches resolved again."""
    nodes, refs = (store.settled(df, "symbols") for df in star.symbols(spark, sf_dir))
    edited = F.pmod(F.xxhash64("file_path"), F.lit(7)) == 0
    # As the edited files were before: some symbols not yet there, some of another name, kind or line.
    n = F.col("start_line")
    before = nodes.where(edited & (n % 3 != 0)).withColumn("name", F.when(n % 3 == 1, F.concat("name", F.lit("Old"))).otherwise(F.col("name"))).withColumn("start_line", F.when(n % 2 == 0, n + 1).otherwise(n))
    old = store.settled(nodes.where(~edited).unionByName(before), "old")
    state = incremental.State(old, refs, store.settled(names.cascade(refs, old), "resolved"))
    theirs = refs.join(nodes.where(edited).select(F.col("file_path").alias("ref_file")).distinct(), "ref_file", "left_semi").select(*refs.columns)
    after, _ = incremental.update(state, nodes.where(edited).select("file_path"), nodes.where(edited), theirs)
    return after.resolved.withColumn("confidence", F.col("confidence").cast("double"))
