"""Which files and which parts of them answer a question: a gate and an order for files, clusters of lines, and what fits a budget."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.predicates import is_generated, is_low_value
from graphmill.operators.intervals import top_per_group

#: Kinds that may span most of a file; such a node says nothing about where to look.
ENVELOPE_KINDS = ("file", "module", "class", "struct", "interface", "enum", "namespace", "protocol", "trait", "component")
#: Lines around a cluster, what stands between two, and what a file's heading takes.
PADDING, GAP_CHARS, HEADING_CHARS = 3, 19, 200
# Importance of what a range is.
IMPORTANCE = {"entry": 10, "named": 9, "glue": 6, "connected": 3, "edge": 2, "other": 1}


class Budget(NamedTuple):
    """chars of an answer, files in it, chars a file, and lines between ranges that still make one cluster."""

    chars: int
    files: int
    chars_a_file: int
    gap: int
    low_value_files: bool


# Budgets by the number of files of a project, below each bound.
_TIERS = [(150, Budget(13000, 4, 3800, 7, False)), (500, Budget(18000, 5, 3800, 8, False)), (5000, Budget(24000, 8, 6500, 12, True)), (15000, Budget(24000, 8, 7000, 15, True))]
_CALLS = [(500, 1), (5000, 2), (15000, 3), (25000, 4)]


def budget_of(files: int) -> Budget:
    return next((b for bound, b in _TIERS if files < bound), _TIERS[-1][1])


def calls_of(files: int) -> int:
    """How many questions a project of so many files may take."""
    return next((n for bound, n in _CALLS if files < bound), 5)


def importance(is_entry: Column, is_named: Column, is_glue: Column, is_connected: Column) -> Column:
    v = {k: F.lit(x) for k, x in IMPORTANCE.items()}
    return F.when(is_entry, v["entry"]).when(is_named, v["named"]).when(is_glue, v["glue"]).when(is_connected, v["connected"]).otherwise(v["other"])


def gated(files: DataFrame, share: float = 0.06, hits: int = 2) -> DataFrame:
    """files without those that neither a walk, nor an entry, nor enough terms speak for; all of them if fewer than two are left or no walk reached any.

    files: file_path, graph (mass of a walk), is_central, is_entry, hits (distinct terms). One aggregate, of one row, decides for all.
    """
    top = files.agg(F.max("graph").alias("_top"))
    with_top = files.join(F.broadcast(top))  # one row
    keeps = (F.col("graph") >= F.col("_top") * share) | F.col("is_central") | F.col("is_entry") | (F.col("hits") >= hits)
    marked = with_top.withColumn("_keeps", F.coalesce(keeps, F.lit(False)))
    enough = marked.agg(((F.count_if("_keeps") >= 2) & (F.coalesce(F.max("_top"), F.lit(0.0)) > 0)).alias("_gate"))
    return marked.join(F.broadcast(enough)).where(F.col("_keeps") | ~F.col("_gate")).drop("_top", "_keeps", "_gate")


def ranked_files(files: DataFrame, most: int) -> DataFrame:
    """The first `most` files, with rank: named ones first, then entries or central ones that two terms speak for, then by the walk's mass (in steps of
    a hundredth of the greatest, so that near ties go on to the next key), terms, worth, generated or not, score, number of symbols, path.

    files: as in gated, and is_named, score, symbols. Only `most` rows meet in one place.
    """
    top = files.agg(F.max("graph").alias("_top"))
    step = F.when(F.col("_top") > 0, F.floor(F.col("graph") / (F.col("_top") * 0.01) + 0.5)).otherwise(0)
    corroborated = (F.col("hits") >= 2) & (F.col("is_entry") | F.col("is_central"))
    path = F.lower("file_path")
    order = [F.desc("is_named"), F.desc(corroborated), F.desc(step), F.desc("hits"), is_low_value(path), is_generated(F.col("file_path")), F.desc("score"), F.desc("symbols"), F.asc("file_path")]
    first = files.join(F.broadcast(top)).orderBy(*order).limit(most)  # one row on the right
    nth = F.row_number().over(Window.orderBy(*order))
    return first.withColumn("rank", nth).drop("_top")


def ranges_of(nodes: DataFrame, files: DataFrame, share: float = 0.5) -> DataFrame:
    """nodes (file_path, kind, start, end, ..) of files (file_path, n_lines) without containers that cover more than a share of their file."""
    met = nodes.where("start > 0 and end > 0").join(files.select("file_path", "n_lines"), "file_path")
    return met.where(~F.col("kind").isin(*ENVELOPE_KINDS) | (F.col("end") - F.col("start") + 1 <= F.col("n_lines") * share)).drop("n_lines")


def clusters(ranges: DataFrame, gap: int) -> DataFrame:
    """file_path, start, end, score (sum), top (greatest importance), spine (of any), call_line (of the first range that has one), symbols, rank: runs of
    ranges at most gap lines apart, ranked within their file: those on the call path, then by importance, density, score, fewer lines, place.
    ranges: file_path, start, end, importance, spine, call_line."""
    order = Window.partitionBy("file_path").orderBy("start", "end", "importance")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = ranges.withColumn("_new", F.when(F.col("start") <= reached + gap, 0).otherwise(1))
    runs = flagged.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first_call = F.min(F.when(F.col("call_line").isNotNull(), F.struct("start", "end", "importance", "call_line"))).alias("_call")
    out = runs.groupBy("file_path", "_run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("importance").cast("long").alias("score"), F.max("importance").alias("top"), F.bool_or("spine").alias("spine"), first_call, F.count("*").alias("symbols")
    )
    span = F.col("end") - F.col("start") + 1
    by = Window.partitionBy("file_path").orderBy(F.desc("spine"), F.desc("top"), F.desc(F.col("score") / span), F.desc("score"), span, "start")
    return out.withColumn("call_line", F.col("_call.call_line")).withColumn("rank", F.row_number().over(by)).drop("_run", "_call")


def with_sections(found: DataFrame, texts: DataFrame, padding: int = PADDING, oversize: int = 200, window: int = 28) -> DataFrame:
    """found with section and chars: the lines of each cluster with some around; of a very long one on the call path, its first lines and those around
    the next call. texts: file_path, text."""
    met = found.join(texts.select("file_path", F.split("text", "\n").alias("_lines")), "file_path")
    n = F.size("_lines")
    cut = lambda a, z: F.array_join(F.slice("_lines", F.greatest(a, F.lit(1)), F.greatest(F.least(z, n) - F.greatest(a, F.lit(1)) + 1, F.lit(0))), "\n")
    a, z = F.greatest(F.col("start"), F.col("call_line") - window), F.least(F.col("end"), F.col("call_line") + window)
    head = F.least(F.col("start") + 4, a - 2)
    parts = F.when(head >= F.col("start"), F.concat(cut(F.col("start"), head), F.lit("\n\n... (gap) ...\n\n"), cut(a, z))).otherwise(cut(a, z))
    long_one = F.col("spine") & F.col("call_line").isNotNull() & (F.col("end") - F.col("start") + 1 > oversize)
    section = F.when(long_one, parts).otherwise(cut(F.col("start") - padding, F.col("end") + padding))
    return met.withColumn("section", section).withColumn("chars", F.length("section")).drop("_lines")


def chosen_clusters(found: DataFrame, budget: Budget) -> DataFrame:
    """Clusters of each file that fit its budget: in order of rank, each that still fits is taken and one that doesn't is passed over; the first always is. One on
    the call path may go to 2.5 times the budget. found: file_path, rank, start, spine, chars, ..

    What is taken depends on all before it, so a file's clusters (numbers only) are folded in one row, of as many entries as the file has clusters.
    """
    slim = F.struct("rank", "start", "spine", "chars")
    listed = found.groupBy("file_path").agg(F.array_sort(F.collect_list(slim)).alias("_all"))
    kind = "struct<used:bigint,kept:array<int>>"
    empty = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("kept")).cast(kind)

    def take(state: Column, x: Column) -> Column:
        more = state["used"] + x["chars"] + F.when(F.size(state["kept"]) > 0, GAP_CHARS).otherwise(0)
        fits = (F.size(state["kept"]) == 0) | (more <= budget.chars_a_file) | (x["spine"] & (more <= F.lit(int(budget.chars_a_file * 2.5))))
        taken = F.struct(more.cast("bigint").alias("used"), F.array_append(state["kept"], x["rank"]).alias("kept"))
        return F.when(fits, taken).otherwise(state).cast(kind)

    kept = listed.withColumn("_s", F.aggregate("_all", empty, take)).select("file_path", F.explode("_s.kept").alias("rank"), F.col("_s.used").alias("file_chars"))
    return found.join(kept, ["file_path", "rank"])


def selection(files: DataFrame, found: DataFrame, budget: Budget) -> DataFrame:
    """file_rank, and the clusters of chosen_clusters, of the files that fit the answer: in order of rank, a file that still fits is taken whole and one that doesn't is
    passed over (a named one never is), until there are enough. files: of ranked_files, so there are few of them, and they are folded in one row."""
    picked = chosen_clusters(found.join(files.select("file_path"), "file_path", "left_semi"), budget)
    sized = files.select("file_path", "rank", "is_named").join(picked.groupBy("file_path").agg(F.max("file_chars").alias("chars")), "file_path")
    listed = sized.agg(F.array_sort(F.collect_list(F.struct("rank", "file_path", "is_named", "chars"))).alias("_all"))
    kind = "struct<used:bigint,kept:array<string>>"
    empty = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("kept")).cast(kind)

    def take(state: Column, x: Column) -> Column:
        more = state["used"] + x["chars"] + HEADING_CHARS
        fits = (F.size(state["kept"]) < budget.files) & ((more <= budget.chars) | x["is_named"])
        return F.when(fits, F.struct(more.cast("bigint").alias("used"), F.array_append(state["kept"], x["file_path"]).alias("kept"))).otherwise(state).cast(kind)

    kept = listed.select(F.posexplode(F.aggregate("_all", empty, take)["kept"]).alias("file_rank", "file_path"))
    return picked.join(F.broadcast(kept.withColumn("file_rank", F.col("file_rank") + 1)), "file_path")


def siblings(edges: DataFrame, least: int = 3) -> DataFrame:
    """id, super: types of supertypes that have at least `least` of them. edges: source, target, kind."""
    up = edges.where(F.col("kind").isin("extends", "implements")).select(F.col("source").alias("id"), F.col("target").alias("super")).distinct()
    return up.join(up.groupBy("super").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("super"), "super", "left_semi").select("id", "super")


def confidence(hits: DataFrame, distinctive: Column) -> DataFrame:
    """is_high: whether any entry (id, name, term) is found by two terms, or bears a name that only an identifier has."""
    by = hits.groupBy("id").agg(F.countDistinct("term").alias("n"), F.bool_or(distinctive).alias("marked"))
    return by.agg(F.coalesce(F.bool_or((F.col("n") >= 2) | F.col("marked")), F.lit(False)).alias("is_high"))


def diverse(found: DataFrame, most: int, priority: Column, is_root: Column, is_production: Column, share: float = 0.2, other_share: float = 0.15) -> DataFrame:
    """At most max(5, share * most) nodes of a file, roots first, then by the kind's priority, score and id; and at most max(3, other_share * most) in all that aren't production code."""
    a_file, others = max(5, -(-int(most * share * 100) // 100)), max(3, -(-int(most * other_share * 100) // 100))
    order = F.when(is_root, 10).otherwise(0) + priority
    kept = top_per_group(found.withColumn("_p", order), ["file_path"], [F.desc("_p"), F.desc("score"), "id"], a_file).drop("rank")
    rest = kept.where(~is_production).orderBy(F.desc("_p"), F.desc("score"), "id").limit(others)
    return kept.where(is_production).unionByName(rest).drop("_p")
