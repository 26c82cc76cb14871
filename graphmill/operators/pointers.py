"""Calls through function pointers: what each slot (a struct's field) may hold, by a fixpoint over copies, and which calls go through it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.operators.intervals import top_per_group
from graphmill.store import dealt, settled

#: Targets and calling functions of one set that meet in a task at a time.
PIECE = 10_000


def _first(held: DataFrame, keep: int | None) -> DataFrame:
    """slot, target: all of them, or of each slot the first `keep` by target."""
    return held if keep is None else top_per_group(held, ["slot"], ["target"], keep).drop("rank")


def _fixpoint(held: DataFrame, copies: DataFrame, keep: int | None) -> DataFrame:
    """What slots hold after copies. Semi-naive: a round joins only what the round before found with the copies, and keeps what is new. Each round
    is a table of its own; none is written again. With `keep`, a target behind the first `keep` of its slot is not handed on."""
    new, rounds = held, [held]
    while not new.isEmpty():
        found = new.join(copies, new["slot"] == copies["from_slot"]).select(F.col("to_slot").alias("slot"), "target").distinct()
        if keep is not None:
            found = _first(reduce(DataFrame.union, rounds, found).distinct(), keep)
        new = settled(reduce(lambda df, old: df.join(old, ["slot", "target"], "left_anti"), rounds, found), "facts")
        rounds.append(new)
        # A long row of copies makes many small tables; they are put together, so that a round reads few.
        if len(rounds) == 8:
            rounds = [settled(_first(reduce(DataFrame.union, rounds), keep), "facts")]
    return settled(_first(reduce(DataFrame.union, rounds), keep), "facts")


def shared_sets(bound: DataFrame, copies: DataFrame, keep: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(slot, of; of, target): what every slot may hold. A slot may name several sets, which share no target, and several slots may name one. With `keep`
    a slot names one set: of what it may hold, the first `keep` by target.

    A slot that copies from one other holds its own targets and those of the other. So it is taken out: those it is copied to get its targets and copy
    from the other. A round takes out no two slots that copy from each other and about a third of any long row or ring of copies, so rounds grow with the
    logarithm of its length; what is left (slots that copy from several) goes to the fixpoint. Then slots come back in reverse order, with the sets
    of the slot they copy from and one of what they hold beyond those; with `keep`, with one of their own in their place.
    """
    edges = settled(copies.select("to_slot", "from_slot").where("to_slot != from_slot").distinct(), "copies")
    now = settled(_first(bound.select("slot", "target").distinct(), keep), "facts")
    out = []
    while True:
        draw = lambda x: F.struct(F.xxhash64(x, F.lit(len(out))).alias("h"), F.col(x).alias("x"))
        single = edges.groupBy(F.col("to_slot").alias("slot")).agg(F.count("*").alias("n"), F.min("from_slot").alias("before")).where("n = 1").drop("n")
        up = lambda x, y: single.select(F.col("slot").alias(x), F.col("before").alias(y))
        met = single.join(up("before", "further"), "before", "left").join(up("further", "furthest"), "further", "left")
        # Next to a slot that stays; or where the slot before draws more than both its neighbours and is itself not next to one that stays.
        free = F.col("further").isNull() | (F.col("furthest").isNotNull() & (draw("slot") < draw("before")) & (draw("before") > draw("further")))
        gone = settled(met.where(free).select("slot", "before"), "gone")
        if gone.isEmpty():
            break
        left = edges.join(gone.select(F.col("slot").alias("to_slot")), "to_slot", "left_anti").join(gone.withColumnRenamed("slot", "from_slot"), "from_slot", "left")
        moved = settled(left.select("to_slot", F.coalesce("before", "from_slot").alias("from_slot"), F.when(F.col("before").isNotNull(), F.col("from_slot")).alias("over")), "copies")
        edges = moved.where("to_slot != from_slot").select("to_slot", "from_slot").distinct()
        out.append((gone, now))
        handed = moved.where("over is not null").select(F.col("over").alias("slot"), "to_slot").join(now, "slot").select(F.col("to_slot").alias("slot"), "target")
        now = settled(_first(now.join(gone, "slot", "left_anti").union(handed).distinct(), keep), "facts")
    if not edges.isEmpty():
        now = _fixpoint(now, edges, keep)
    sets = now.withColumnRenamed("slot", "of")
    names = settled(now.select("slot", F.col("slot").alias("of")).distinct(), "names")
    for gone, had in reversed(out):
        own = had.join(gone, "slot").select("slot", "before", "target")
        asked = gone.join(names.withColumnRenamed("slot", "before"), "before", "left").select("slot", "of")
        if keep is None:
            known = own.join(asked, "slot").join(sets, ["of", "target"], "left_semi").select("slot", "target")
            more = settled(own.select("slot", "target").join(known, ["slot", "target"], "left_anti"), "facts")
            names = names.union(settled(asked.where("of is not null").union(more.select("slot", F.col("slot").alias("of")).distinct()), "names"))
            sets = sets.union(more.select(F.col("slot").alias("of"), "target"))
            continue
        new = own.select("slot", "target").join(asked, "slot").join(sets, ["of", "target"], "left_anti")
        # A target behind the last of a full set is not among the first.
        full = sets.groupBy("of").agg(F.count("*").alias("n"), F.max("target").alias("last")).where(F.col("n") >= keep).drop("n")
        new = new.join(full, "of", "left").where("last is null or target < last")
        apart = new.select("slot", F.lit(True).alias("apart")).distinct()
        named = settled(asked.join(apart, "slot", "left").select("slot", F.col("of").alias("from"), F.when(F.col("apart"), F.col("slot")).otherwise(F.col("of")).alias("of")).where("of is not null"), "names")
        alone = named.where("slot = of")
        if not alone.isEmpty():
            both = own.select("slot", "target").join(alone, "slot", "left_semi").union(alone.select("slot", F.col("from").alias("of")).join(sets, "of").select("slot", "target"))
            sets = sets.union(settled(_first(both.distinct(), keep).withColumnRenamed("slot", "of").select("of", "target"), "facts"))
        names = names.union(named.select("slot", "of"))
    return settled(names, "names"), settled(sets, "facts")


def points_to(bound: DataFrame, copies: DataFrame) -> DataFrame:
    """slot, target: what every slot may hold. bound: slot, target; copies: to_slot, from_slot (what the second holds, the first may hold)."""
    names, sets = shared_sets(bound, copies)
    return names.join(sets, "of").select("slot", "target")


def _slot(owner: str | Column, field: str | Column) -> Column:
    return F.concat_ws(".", owner, field)


def _first_known(df: DataFrame, types: str, known: DataFrame, name: str) -> DataFrame:
    """df with `name`: the first of its types that is in known (type); null if none is. df has a unique `id`."""
    listed = df.select("id", F.posexplode(types).alias("_at", "type")).join(known, "type")
    return df.join(listed.groupBy("id").agg(F.min_by("type", "_at").alias(name)), "id", "left")


def _by_name(wanted: DataFrame, functions: DataFrame) -> DataFrame:
    """wanted with `target`: the function of its value, of the same file if there is one there, else the first."""
    names = wanted.select("value", "file_path").distinct()
    f = functions.select(F.col("id").alias("target"), F.col("name").alias("value"), F.col("file_path").alias("_file"))
    here = f.select("value", F.col("_file").alias("file_path"), "target").groupBy("value", "file_path").agg(F.min("target").alias("_here"))
    anywhere = f.groupBy("value").agg(F.min_by("target", F.struct("_file", "target")).alias("_any"))
    best = names.join(anywhere, "value").join(here, ["value", "file_path"], "left").select("value", "file_path", F.coalesce("_here", "_any").alias("target"))
    return wanted.join(best, ["value", "file_path"])


def slots(facts: DataFrame) -> DataFrame:
    """owner, field, pos, type, is_pointer of all fields; one is a pointer by its form, or if its type is a typedef of functions."""
    typedefs = facts.where("what = 'typedef'").select(F.col("owner").alias("value"), F.lit(True).alias("_fn")).distinct()
    fields = facts.where("what = 'field'").join(typedefs, "value", "left")
    pointer = (F.col("form") == "pointer") | F.col("_fn")
    return fields.groupBy("owner", "field", "pos", F.col("value").alias("type")).agg(F.coalesce(F.bool_or(pointer), F.lit(False)).alias("is_pointer"))


def bindings(facts: DataFrame, fields: DataFrame, functions: DataFrame) -> DataFrame:
    """slot, target: functions that tables and assignments put into fields."""
    pointers = fields.where("is_pointer")
    owners = pointers.select(F.col("owner").alias("type")).distinct()
    entries = facts.where("what = 'entry'").select("owner", F.col("field").alias("named"), F.col("pos").alias("at"), "value", "file_path")
    by_place = entries.where("named is null").join(pointers.select("owner", "field", "pos"), "owner").where("at = pos")
    by_field = entries.where("named is not null").join(pointers.select("owner", "field"), "owner").where("named = field")
    given = _first_known(facts.where("what = 'assign'").withColumn("id", F.monotonically_increasing_id()), "types", owners, "struct")
    given = given.drop("owner").withColumnRenamed("struct", "owner").join(pointers.select("owner", "field").distinct(), ["owner", "field"])
    every = reduce(DataFrame.union, (df.select(_slot("owner", "field").alias("slot"), "value", "file_path") for df in (by_place, by_field, given)))
    return _by_name(every, functions).select("slot", "target").distinct()


def copies(facts: DataFrame, fields: DataFrame) -> DataFrame:
    """to_slot, from_slot of assignments from one pointer field to another."""
    pointers = fields.where("is_pointer").select(_slot("owner", "field").alias("slot")).distinct()
    owners = fields.where("is_pointer").select(F.col("owner").alias("type")).distinct()
    c = facts.where("what = 'copy'").withColumn("id", F.monotonically_increasing_id())
    c = _first_known(_first_known(c, "types", owners, "_to"), "from_types", owners, "_from").where("_to is not null and _from is not null")
    c = c.select(_slot("_to", "field").alias("to_slot"), _slot("_from", "from_field").alias("from_slot")).distinct()
    known = lambda df, side: df.join(pointers.withColumnRenamed("slot", side), side, "left_semi")
    return known(known(c, "to_slot"), "from_slot")


def calls(facts: DataFrame, fields: DataFrame) -> DataFrame:
    """file_path, scope, line, slot of the calls through fields.

    The struct is the one at the end of the receiver's chain, whose first type is that of the variable (declared in the function, else of a table of
    that name); else the first declared type of the chain's last name that has pointers; else the only struct with a pointer of that field's name.
    """
    pointers = settled(fields.where("is_pointer").select("owner", "field").distinct(), "pointers")
    owners = pointers.select(F.col("owner").alias("type")).distinct()
    made = facts.where("what = 'variable'").groupBy(F.col("owner").alias("base")).agg(F.min("value").alias("_global"))
    c = facts.where("what = 'call'").select("file_path", "scope", "line", F.col("owner").alias("base"), "chain", F.col("field").alias("called"), F.get("types", F.lit(0)).alias("_local"), "from_types")
    c = settled(c.join(pointers.select(F.col("field").alias("called")).distinct(), "called", "left_semi").join(made, "base", "left").withColumn("at", F.coalesce("_local", "_global")).withColumn("id", F.monotonically_increasing_id()), "calls")
    types = settled(fields.where("type != ''").groupBy(F.col("owner").alias("at"), F.col("field").alias("step")).agg(F.min("type").alias("_next")), "types")
    for i in range(c.agg(F.max(F.size("chain"))).first()[0] or 0):
        step = F.get("chain", F.lit(i))
        c = c.withColumn("step", step).join(types, ["at", "step"], "left").withColumn("at", F.when(step.isNull(), F.col("at")).otherwise(F.col("_next"))).drop("step", "_next")
    slot = pointers.select(F.col("owner").alias("_o"), F.col("field").alias("_f"))
    has = lambda df, owner, name: df.join(slot.withColumnRenamed("_o", owner).withColumnRenamed("_f", "called").withColumn(name, F.lit(True)), [owner, "called"], "left")
    c = has(c, "at", "_exact")
    c = has(_first_known(c, "from_types", owners, "last"), "last", "_last")
    only = pointers.groupBy(F.col("field").alias("called")).agg(F.count("*").alias("_n"), F.min("owner").alias("_one")).where("_n = 1").drop("_n")
    struct = F.when(F.col("_exact"), F.col("at")).when(F.col("_last"), F.col("last")).otherwise(F.col("_one"))
    c = c.join(only, "called", "left").withColumn("struct", struct).where("struct is not null")
    return c.select("file_path", "scope", "line", _slot("struct", "called").alias("slot"))


def arrays(facts: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slot, target; file_path, scope, line, slot) of arrays of pointers and calls of their elements. An array has a type of functions and a star, or a type of
    pointers. Of arrays of one name the caller's file decides, else the name must be the only one."""
    kinds = facts.where("what = 'typedef'").select(F.col("owner").alias("type"), F.col("form").alias("_kind")).distinct()
    e = facts.where("what = 'element'").select("owner", "value", "file_path", "form", F.get("types", F.lit(0)).alias("type"))
    e = e.join(kinds, "type").where("_kind = 'pointer' or form = 'star'")
    slot = F.concat("file_path", F.lit("#"), "owner", F.lit("[]"))
    held = _by_name(e.select(slot.alias("slot"), "owner", "value", "file_path").distinct(), functions)
    tables = held.select("owner", "slot", F.col("file_path").alias("_file")).distinct()
    of_name = tables.groupBy("owner").agg(F.count("*").alias("_n"), F.min("slot").alias("_one"))
    c = facts.where("what = 'array_call'").select("file_path", "scope", "line", "owner").join(of_name, "owner")
    c = c.join(tables.select("owner", F.col("_file").alias("file_path"), F.col("slot").alias("_here")), ["owner", "file_path"], "left")
    c = c.withColumn("slot", F.coalesce("_here", F.when(F.col("_n") == 1, F.col("_one")))).where("slot is not null")
    return held.select("slot", "target").distinct(), c.select("file_path", "scope", "line", "slot")


def _met(sites: DataFrame, sets: DataFrame, piece: int = PIECE) -> DataFrame:
    """sites (source, of, ..) with `target`, one row for each target of the set `of` that is not the source.

    A set of many targets that many call has a row for every two, so its rows are dealt to tasks as a grid: sites and targets fall into pieces of about
    `piece`, and each piece of sites goes to every piece of targets, which is one row. A task holds one piece of targets at a time.
    """
    count = lambda df, n: df.groupBy("of").agg(F.ceil(F.count("*") / piece).cast("int").alias(n))
    grid = count(sites, "_px").join(count(sets, "_py"), "of")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda x, n: F.pmod(F.xxhash64(x), F.col(n)).cast("int")
    asked = sites.join(grid, "of").withColumn("_x", own("source", "_px")).withColumn("_y", every("_py")).drop("_px", "_py")
    listed = sets.join(grid, "of").withColumn("_y", own("target", "_py")).groupBy("of", "_y", "_px").agg(F.collect_list("target").alias("_targets"))
    listed = listed.withColumn("_x", every("_px")).drop("_px")
    spread = lambda df: dealt(df, "of", "_x", "_y")
    met = spread(asked).join(spread(listed).hint("shuffle_hash"), ["of", "_x", "_y"])
    return met.select(*sites.columns, F.explode("_targets").alias("target")).where("target != source")


def pointer_calls(facts: DataFrame, functions: DataFrame, fan_out: int | None = None) -> DataFrame:
    """source, target, line, via: calls of functions that slots may hold; a pair of functions once, at its first line. All of them, or of more than fan_out
    targets of one function the first by line, slot and target. facts: of sources.pointers (settle them first: they are read several times); functions: id, name, file_path."""
    fields = settled(slots(facts), "fields")
    in_arrays, array_calls = arrays(facts, functions)
    # Of the targets of one site, at most fan_out are those of earlier sites and one is the caller; fan_out more are enough.
    keep = None if fan_out is None else 2 * fan_out + 1
    names, sets = shared_sets(bindings(facts, fields, functions).union(in_arrays), copies(facts, fields), keep)
    sites = calls(facts, fields).union(array_calls).distinct()
    sources = functions.select(F.col("id").alias("source"), F.col("name").alias("scope"), "file_path")
    asked = sites.join(sources, ["scope", "file_path"]).groupBy("source", "slot").agg(F.min("line").alias("line")).withColumn("via", F.regexp_replace("slot", "^.*#", ""))
    asked = asked.withColumn("sites", F.count("*").over(Window.partitionBy("source"))).join(names, "slot")
    first = F.min(F.struct("line", "via")).alias("first")
    asked = settled(asked.groupBy("source", "of", "sites").agg(first).select("source", "of", "sites", "first.*"), "sites")
    # A function of one site needs no comparison of its targets with those of others.
    once = _met(asked.where("sites = 1").drop("sites"), sets).select("source", "target", "line", "via")
    several = _met(asked.where("sites > 1").drop("sites"), sets).groupBy("source", "target").agg(first).select("source", "target", "first.*")
    pairs = once.union(several)
    return pairs if fan_out is None else top_per_group(pairs, ["source"], ["line", "via", "target"], fan_out).select("source", "target", "line", "via")
