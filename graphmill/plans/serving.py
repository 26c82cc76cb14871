"""Queries of the readers' tools over the tables, and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.operators import tools
from graphmill.plans.catalogue import STAR
from graphmill.sources import star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_USES = "('calls', 'references', 'imports', 'instantiates')"
_DOCS = "select 'd' || doc_id as file_path, replace(text, ' the ', chr(10)) as text from documents where text is not null"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _first_part(s, d) -> str:
    return star.table(s, d, "part").orderBy("p_partkey").first()["p_name"]


def _docs(s, d):
    return star.table(s, d, "documents").where("text is not null").select(F.concat(F.lit("d"), "doc_id").alias("file_path"), F.replace("text", F.lit(" the "), F.lit("\n")).alias("text"))


def _near(near: str, far: str, most: int) -> str:
    return f"""select definition, id, label, cast(rank as int) as rank from (select x.definition, x.id, case when x.other = 0 then null when x.kind = 'references' then 'reference' else x.kind end as label, row_number() over (partition by x.definition order by n.file_path, n.start_line, n.id) as rank
  from (select {near} as definition, {far} as id, min(case when kind = 'calls' then 0 else 1 end) as other, min(kind) as kind from edges where kind in {_USES} and source <> target group by 1, 2) x join nodes n on n.id = x.id) where rank <= {most}"""


@query(STAR + _near("target", "source", 20))
def callers_by_definition(s, d):
    """Callers of every node of the graph, twenty a definition."""
    g = star.star_graph(s, d)
    return tools.neighbours(g, g.nodes, "in", 20)


@query(STAR + f"select definition, 'callee' as role, id, rank from ({_near('source', 'target', 12)}) union all select definition, 'caller', id, rank from ({_near('target', 'source', 12)})")
def trails(s, d):
    return tools.trail(star.star_graph(s, d))


@query(STAR + "select e.source as container, n.id, n.kind, n.name, n.start_line, cast(row_number() over (partition by e.source order by n.start_line, n.id) as int) as rank from (select distinct source, target from edges where kind = 'contains') e join nodes n on n.id = e.target")
def outlines(s, d):
    g = star.star_graph(s, d)
    return tools.outline(g, g.nodes)


_MATCHED = "select *, row_number() over (order by file_path, start_line, id) as rank from nodes where name = (select p_name from part order by p_partkey limit 1)"


@query(STAR + f"select id, cast(rank as int) as rank from ({_MATCHED})")
def symbol_matches(s, d):
    return tools.symbols(star.star_graph(s, d).nodes, _first_part(s, d)).select("id", "rank")


@query(STAR + "select id from nodes where name = (select p_name from part order by p_partkey limit 1) order by case when start_line <= 1000 and start_line + 4 >= 1000 then -1 else abs(start_line - 1000) end, file_path, start_line, id limit 1")
def symbol_at_line(s, d):
    nodes = star.star_graph(s, d).nodes
    return tools.at_line(nodes.where(F.col("name") == _first_part(s, d)), 1000).select("id")


@query("""with files as (select distinct 'src/' || r_name || '/' || n_name || '/' || leaf as path from nation join region on n_regionkey = r_regionkey cross join (values ('a.x'), ('b.x')) l(leaf)),
asked as (select n_name || '/A.X' as asked from nation union select lower(n_name) from nation union select 'src/' || r_name || '/' || n_name || '/b.x' from nation join region on n_regionkey = r_regionkey union select 'nothing'),
met as (select asked, path, case when lower(path) = lower(asked) then 0 when ends_with(lower(path), '/' || lower(asked)) then 1 else 2 end as step from asked join files on contains(lower(path), lower(asked)))
select asked, min(path) as path from met m where step = (select min(step) from met x where x.asked = m.asked) group by asked, step having count(*) = 1""")
def file_arguments(s, d):
    n = star.table(s, d, "nation").join(star.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.concat(F.lit("src/"), "r_name", F.lit("/"), "n_name", F.lit("/"))
    files = n.select(F.explode(F.array(F.concat(path, F.lit("a.x")), F.concat(path, F.lit("b.x")))).alias("path"))
    asked = n.select(F.explode(F.array(F.concat("n_name", F.lit("/A.X")), F.lower("n_name"), F.concat(path, F.lit("b.x")), F.lit("nothing"))).alias("asked")).distinct()
    return tools.resolve_files(asked, files)


@query(f"""with docs as ({_DOCS}), lines as (select file_path, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as line from docs),
cut as (select *, sum(length(text) + 1) over (partition by file_path order by line) as used from lines where line between 3 and 12) select file_path, cast(line as int) as line, text from cut where used <= 400""")
def file_slices(s, d):
    return tools.line_slice(_docs(s, d), 3, 10, 400)


@query(f"with docs as ({_DOCS}) select file_path, case when strpos(text, ' of ') > 0 then cast(length(left(text, strpos(text, ' of ') - 1)) - length(replace(left(text, strpos(text, ' of ') - 1), chr(10), '')) + 1 as int) end as line from docs")
def first_lines(s, d):
    at = F.instr("text", " of ") - 1
    return _docs(s, d).select("file_path", F.when(at >= 0, tools.line_of(F.col("text"), at)).cast("int").alias("line"))


@query(f"""with docs as ({_DOCS}), h as (select file_path, text, left(text, 300) as head from docs), p as (select *, length(head) - strpos(reverse(head), chr(10)) as kept from h)
select file_path, case when length(text) <= 300 then text else (case when contains(head, chr(10)) and kept > 240 then left(head, kept) else head end) || chr(10) || chr(10) || '... (output truncated)' end as text from p""")
def truncated_texts(s, d):
    return _docs(s, d).select("file_path", tools.truncated(F.col("text"), 300).alias("text"))


@query(STAR + "select language, count(*) as n, string_agg(path, ',' order by path) as paths from (select distinct language, file_path as path from nodes) group by 1")
def file_listing(s, d):
    return tools.file_listing(star.star_graph(s, d).nodes.select("language", F.col("file_path").alias("path")).distinct()).withColumn("paths", F.array_join("paths", ","))


@query("""select page_id, url, name as reference_name from (select page_id, url, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) as name from pages) where name <> '' and name in (select split_part(text, ' ', 1) from documents)""")
def unresolved_by_name(s, d):
    refs = star.page_references(s, d).select("page_id", F.col("url"), F.col("name").alias("reference_name"))
    names = star.table(s, d, "documents").select(F.substring_index("text", " ", 1).alias("reference_name"))
    return tools.unresolved(refs, names)


@query(STAR + "select id from nodes where kind in ('module', 'class', 'namespace')")
def union_of_kinds(s, d):
    return tools.of_kinds(star.star_graph(s, d).nodes, ("module", "class"), ("class", "namespace")).select("id")


@query(STAR + "select file_path as handler_file, count(*) as n from nodes where kind = 'method' group by 1 order by n desc, handler_file limit 1")
def primary_handler_file(s, d):
    return tools.top_handler_file(star.star_graph(s, d).nodes.where("kind = 'method'").select(F.col("file_path").alias("handler_file")))
