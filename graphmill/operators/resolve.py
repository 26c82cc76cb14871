"""From textual references to edges: candidates by name, strategies by confidence, and channels that pair symbols heuristically."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.operators.intervals import top_per_group
from graphmill.store import dealt, settled


def shared_folders(a: F.Column, b: F.Column) -> F.Column:
    """How many leading folders two paths share."""
    x, y = F.slice(F.split(a, "/"), 1, F.size(F.split(a, "/")) - 1), F.slice(F.split(b, "/"), 1, F.size(F.split(b, "/")) - 1)
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])


def proximity(a: F.Column, b: F.Column) -> F.Column:
    return F.least(15 * shared_folders(a, b), F.lit(80))


def candidate_score(ref_kind: F.Column) -> F.Column:
    """Of columns ref_file, ref_line, ref_language and a candidate's file_path, start_line, language, kind, is_exported."""
    near = F.col("file_path") == F.col("ref_file")
    kind = F.col("kind")
    fits = F.when((ref_kind == "calls") & kind.isin("function", "method"), 25).when((ref_kind == "instantiates") & kind.isin("class", "struct", "interface"), 25)
    fits = fits.when((ref_kind == "decorates") & kind.isin("function", "method"), 25).when((ref_kind == "decorates") & kind.isin("class", "interface"), 15).otherwise(0)
    return (
        F.when(near, 100).otherwise(0) + proximity(F.col("ref_file"), F.col("file_path")) + F.when(F.col("language") == F.col("ref_language"), 50).otherwise(-80)
        + fits + F.when(F.col("is_exported"), 10).otherwise(0) + F.when(near, F.greatest(F.lit(0.0), 20 - F.abs(F.col("start_line") - F.col("ref_line")) / 10)).otherwise(0.0)
    )


def by_name(refs: DataFrame, nodes: DataFrame, ceiling: int = 500) -> DataFrame:
    """ref_id, target, score, n, confidence: the best node of a reference's name. One candidate: 0.9 (0.5 in another language); several: 0.7
    where the best is near (30), else 0.4; more than `ceiling`: none, so common names cannot blow the join up.

    refs: ref_id, ref_name, ref_kind, ref_file, ref_line, ref_language.
    """
    crowd = nodes.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") <= ceiling)
    met = refs.join(nodes.join(crowd, "name"), refs["ref_name"] == F.col("name"))
    met = met.select("ref_id", F.col("id").alias("target"), "n", candidate_score(F.col("ref_kind")).alias("score"), proximity(F.col("ref_file"), F.col("file_path")).alias("near"), (F.col("language") == F.col("ref_language")).alias("same"))
    best = top_per_group(met, ["ref_id"], [F.desc("score"), "target"], 1).where("score > -1")
    sure = F.when(F.col("n") == 1, F.when(F.col("same"), 0.9).otherwise(0.5)).otherwise(F.when(F.col("near") >= 30, 0.7).otherwise(0.4))
    return best.select("ref_id", "target", F.col("score").cast("double").alias("score"), "n", sure.alias("confidence"))


def unique_match(refs: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """refs joined with the one candidate of their key; keys of several candidates match nothing."""
    one = candidates.groupBy(key).agg(F.count("*").alias("_n"), F.min("target").alias("target")).where("_n = 1").drop("_n")
    return refs.join(one, key)


def first_strategy(*found: tuple[str, DataFrame]) -> DataFrame:
    """ref_id, target, confidence, resolved_by: of strategies in order, the surest result; of equals the earlier strategy, then the smaller target."""
    every = reduce(DataFrame.unionByName, (df.select("ref_id", "target", "confidence").withColumn("resolved_by", F.lit(name)).withColumn("_rank", F.lit(i)) for i, (name, df) in enumerate(found)))
    return top_per_group(every, ["ref_id"], [F.desc("confidence"), "_rank", "target"], 1).select("ref_id", "target", "confidence", "resolved_by")


def promoted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose kind follows from their ends: a type that extends an interface implements it; a call of a class or struct makes one."""
    kind = nodes.select("id", "kind")
    e = edges.join(kind.select(F.col("id").alias("source"), F.col("kind").alias("_from")), "source").join(kind.select(F.col("id").alias("target"), F.col("kind").alias("_to")), "target")
    abstract = ("interface", "protocol", "trait")
    new = F.when((F.col("kind") == "extends") & F.col("_to").isin(*abstract) & ~F.col("_from").isin(*abstract), "implements").when((F.col("kind") == "calls") & F.col("_to").isin("class", "struct"), "instantiates").otherwise(F.col("kind"))
    return e.withColumn("kind", new).select(*edges.columns)


# ---- shapes of heuristic channels ----------------------------------------------------------------


def key_channel(senders: DataFrame, receivers: DataFrame, key: str, cap: int) -> DataFrame:
    """source, target, key: every sender with every receiver of a literal key, for keys with at most `cap` of each; crowded keys are
    left out on both sides before the join."""
    few = lambda df: df.join(df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") <= cap).select(key), key, "left_semi")
    s, r = few(senders.select(key, "source").distinct()), few(receivers.select(key, "target").distinct())
    return s.join(r, key).where("source != target").select("source", "target", key)


def covering(have: DataFrame, want: DataFrame) -> DataFrame:
    """owner, wanted: owners whose items hold all items of a wanted set (relational division). have: owner, item; want: wanted, item.

    Only owners of a set's rarest item can hold it, and of those only owners of its second; the other items are looked up for what is left. So
    the rows joined are those of rare items, not every item with all its owners.
    """
    have = settled(have.select("owner", "item").where("item is not null").distinct(), "have")
    want = want.select("wanted", "item").where("wanted is not null").distinct()
    spread = have.groupBy("item").agg(F.count("*").alias("_has"))
    of_set = Window.partitionBy("wanted")
    ranked = want.join(spread, "item", "left").withColumn("_nth", F.row_number().over(of_set.orderBy(F.coalesce("_has", F.lit(0)), "item"))).withColumn("size", F.count("*").over(of_set))
    ranked = settled(ranked.select("wanted", "item", "_nth", "size"), "want")
    second = ranked.where("_nth = 2").select("wanted", F.col("item").alias("_second"))
    open_ = ranked.where("_nth = 1").join(second, "wanted", "left").join(have, "item").select("owner", "wanted", "size", F.col("_second").alias("item"))
    holds = lambda df: df.alias("a").join(have.alias("b"), F.expr("a.owner <=> b.owner and a.item = b.item"), "left_semi")
    two = settled(holds(open_.where("size > 1")).select("owner", "wanted", "size"), "held")
    rest = two.where("size > 2").join(ranked.where("_nth > 2").select("wanted", "item"), "wanted")
    rest = holds(rest).groupBy("owner", "wanted", "size").agg(F.count("*").alias("_n")).where("_n = size - 2")
    return reduce(DataFrame.union, (df.select("owner", "wanted") for df in (open_.where("size = 1"), two.where("size = 2"), rest)))


def overriding(types: DataFrame, members: DataFrame, cap: int = 40) -> DataFrame:
    """source, target: members of a supertype with members of the same name of its subtypes, at most `cap` a pair of types.
    types: sub, super; members: owner, name, member."""
    up = types.join(members.select(F.col("owner").alias("super"), "name", F.col("member").alias("source")), "super")
    both = up.join(members.select(F.col("owner").alias("sub"), "name", F.col("member").alias("target")), ["sub", "name"]).where("source != target")
    return top_per_group(both, ["sub", "super"], ["name", "source", "target"], cap).select("source", "target")


#: Rows of one name and side that are paired in one piece of the work.
PIECE = 16_000


def same_name_elsewhere(nodes: DataFrame, mark: F.Column, piece: int = PIECE) -> DataFrame:
    """source, target: nodes of one qualified name in different files, of which the second alone bears the mark.

    A name of many nodes has a pair for every two, so its pairs are dealt to tasks as a grid: both sides fall into pieces of about `piece` rows, and
    each piece of one side goes to every piece of the other. A piece of the marked side is one row, with its ids by file, so that what is shuffled stays
    small beside the pairs and files are compared, not ids. A task holds one such piece at a time; the other side streams by.
    """
    key, known = "qualified_name", nodes.where("file_path is not null").withColumn("_mark", mark).where("_mark is not null")
    sides = known.groupBy(key).agg(F.count_if(~F.col("_mark")).alias("_na"), F.count_if("_mark").alias("_nb")).where("_na > 0 and _nb > 0")
    grid = sides.select(key, *(F.ceil(F.col(n) / piece).cast("int").alias(p) for n, p in (("_na", "_pa"), ("_nb", "_pb"))))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    a = known.where("not _mark").join(grid, key).select(key, own("_pa").alias("_x"), every("_pb").alias("_y"), F.col("id").alias("source"), F.col("file_path").alias("_a"))
    b = known.where("_mark").join(grid, key).withColumn("_y", own("_pb"))
    # The ids of a list of structs: a list of the ids themselves would lose nulls.
    b = b.groupBy(key, "_y", "_pa", "file_path").agg(F.collect_list(F.struct("id"))["id"].alias("ids"))
    b = b.groupBy(key, "_y", "_pa").agg(F.collect_list(F.struct("file_path", "ids")).alias("files")).withColumn("_x", every("_pa")).drop("_pa")
    spread = lambda df: dealt(df, key, "_x", "_y")
    met = spread(a).join(spread(b).hint("shuffle_hash"), [key, "_x", "_y"]).select("source", "_a", F.explode("files").alias("_b")).where("_a != _b.file_path")
    return met.select("source", F.explode("_b.ids").alias("target"))


def first_channel(*channels: tuple[str, DataFrame]) -> DataFrame:
    """source, target, synthesized_by: of edges that several channels give, the earlier channel's; kinds do not matter."""
    every = reduce(DataFrame.unionByName, (df.select("source", "target").withColumn("synthesized_by", F.lit(name)).withColumn("_rank", F.lit(i)) for i, (name, df) in enumerate(channels)))
    nth = F.row_number().over(Window.partitionBy("source", "target").orderBy("_rank"))
    return every.withColumn("_nth", nth).where("_nth = 1").select("source", "target", "synthesized_by")


def calls_in_text(texts: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """file_path, line, key: what a pattern captures in each line of each file. texts: file_path, text."""
    lines = texts.select("file_path", F.posexplode(F.split("text", "\n")).alias("_n", "_line")).where(F.col("_line").rlike(pattern))
    return lines.select("file_path", (F.col("_n") + 1).alias("line"), F.explode(F.regexp_extract_all("_line", F.lit(pattern), F.lit(group))).alias("key"))


def chase_exports(wanted: DataFrame, exports: DataFrame, declared: DataFrame, depth: int = 8) -> DataFrame:
    """ref_id, target: what a name imported from a file stands for, through re-exports by name (first) or of everything, at most depth files.
    wanted: ref_id, file_path, name; exports: file_path, name (null: everything), from_path, from_name; declared: file_path, name, target.

    A round goes one file further, from places not visited before for that reference, so files that re-export each other end; each is written. A reference
    goes on only while nothing has been found for it.
    """
    front = seen = settled(wanted.select("ref_id", "file_path", "name", F.lit(0).alias("cost")).distinct(), "wanted")
    found = []
    for d in range(depth):
        hit = settled(top_per_group(front.join(declared, ["file_path", "name"]).select("ref_id", "target", "cost"), ["ref_id"], ["cost", "target"], 1).select("ref_id", "target"), "found")
        found.append(hit)
        open_ = front.join(hit, "ref_id", "left_anti")
        named = open_.join(exports.where("name is not null"), ["file_path", "name"]).select("ref_id", F.col("from_path").alias("file_path"), F.col("from_name").alias("name"), "cost")
        every = open_.join(exports.where("name is null").drop("name"), "file_path").select("ref_id", F.col("from_path").alias("file_path"), "name", (F.col("cost") + 1).alias("cost"))
        more = named.union(every).groupBy("ref_id", "file_path", "name").agg(F.min("cost").alias("cost"))
        front = settled(more.join(seen, ["ref_id", "file_path", "name"], "left_anti"), "wanted")
        if d + 1 == depth or front.isEmpty():
            break
        seen = settled(seen.unionByName(front), "seen")
    return reduce(DataFrame.union, found)
