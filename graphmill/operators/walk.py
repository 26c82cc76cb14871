"""Random walks, flow chains and path enumeration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.operators.intervals import top_per_group
from graphmill.schema import RANK_KINDS
from graphmill.store import settled


def walk_with_restart(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, alpha: float = 0.25, rounds: int = 25, kinds: tuple[str, ...] | None = RANK_KINDS) -> DataFrame:
    """id, mass: where an undirected random walk is that returns to the seeds (or to any node, if no seed is one) with probability alpha.

    Parallel edges count, self-loops don't, and a node without edges keeps its mass, so masses sum to 1. Each round
    is one join and one sum that is combined before the shuffle; every fifth round is written.
    """
    ids = settled(nodes.select("id").distinct())
    e = (edges.where(F.col("kind").isin(*kinds)) if kinds else edges).where("source != target").select("source", "target")
    e = e.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    both = settled(e.select("source", "target").union(e.select("target", "source")).toDF("at", "to").groupBy("at", "to").agg(F.count("*").alias("n")))
    degree = both.groupBy(F.col("at").alias("id")).agg(F.sum("n").alias("degree"))
    seeds = seeds.select("id").distinct().join(ids, "id", "left_semi")
    seeds = ids if seeds.isEmpty() else seeds
    n = seeds.count()
    state = ids.join(degree, "id", "left").join(seeds.withColumn("r", F.lit(1.0) / n), "id", "left")
    state = settled(state.select("id", "degree", F.coalesce("r", F.lit(0.0)).alias("r"), F.coalesce("r", F.lit(0.0)).alias("mass")))
    for k in range(rounds):
        sent = both.join(state.where("degree is not null and mass > 0").select(F.col("id").alias("at"), "degree", "mass"), "at")
        got = sent.groupBy(F.col("to").alias("id")).agg(F.sum(F.col("mass") * F.col("n") / F.col("degree")).alias("got"))
        kept = F.when(F.col("degree").isNull(), F.col("mass")).otherwise(F.coalesce("got", F.lit(0.0)))
        state = state.join(got, "id", "left").select("id", "degree", "r", ((1 - alpha) * kept + alpha * F.col("r")).alias("mass"))
        if k % 5 == 4 or k == rounds - 1:
            state = settled(state)
    return state.select("id", "mass")


def flow(edges: DataFrame, named: DataFrame, hops: int = 7, bridge: int = 1, seeds: int = 8) -> DataFrame:
    """seed, id, depth: named nodes that calls reach from each of the first seeds over at most hops nodes, never through
    more than bridge unnamed ones in a row. A node counts at its least depth."""
    calls = settled(edges.where("kind = 'calls'").select(F.col("source").alias("at"), F.col("target").alias("to")).distinct())
    marks = settled(named.select("id").distinct())
    front = marks.orderBy("id").limit(seeds).select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth"), F.lit(0).alias("streak"))
    seen = settled(front)
    front = seen
    for d in range(1, hops):
        to = front.join(calls, front["id"] == calls["at"]).select("seed", F.col("to").alias("id"), "streak").join(marks.withColumn("named", F.lit(True)), "id", "left")
        to = to.select("seed", "id", F.when(F.col("named"), 0).otherwise(F.col("streak") + 1).alias("streak")).where(F.col("streak") <= bridge)
        to = to.groupBy("seed", "id").agg(F.min("streak").alias("streak"))
        front = settled(to.join(seen, ["seed", "id"], "left_anti").select("seed", "id", F.lit(d).alias("depth"), "streak"))
        if front.isEmpty():
            break
        seen = settled(seen.union(front))
    return seen.join(marks, "id", "left_semi").where("depth > 0").select("seed", "id", "depth")


#: Paths that are gone on with after each step.
BEAM = 2000


def _beam(front: DataFrame, beam: int) -> DataFrame:
    """The best `beam` states: those with most marks, then by their path. Each task keeps its own best before they meet."""
    return settled(front.orderBy(F.desc("marks"), F.array_join("path", ">")).limit(beam))


def paths(moves: DataFrame, roots: DataFrame, hops: int = 6, least: int = 3, least_roots: int = 2, keep: int = 3, beam: int = BEAM) -> DataFrame:
    """path: the longest simple paths from roots of at least `least` nodes with least_roots roots among them; no path within another.

    A search with a bound, as it is meant for a reader: after each step the `beam` paths with most roots (then the first by name) go on, so a step makes at most
    beam times a node's moves. Where no step has more, all paths are found.
    """
    m, r = settled(moves.select("at", "to").distinct()), settled(roots.select("id").distinct())
    front = _beam(r.select(F.array("id").alias("path"), F.lit(1).alias("marks")), beam)
    found = front
    for _ in range(hops):
        last = F.element_at("path", -1)
        front = front.withColumn("at", last).join(m, "at").where(~F.array_contains("path", F.col("to"))).join(r.select(F.col("id").alias("to"), F.lit(1).alias("mark")), "to", "left")
        front = _beam(front.select(F.array_append("path", F.col("to")).alias("path"), (F.col("marks") + F.coalesce("mark", F.lit(0))).alias("marks")), beam)
        found = found.union(front)
    good = settled(found.where((F.size("path") >= least) & (F.col("marks") >= least_roots)).select("path", F.concat(F.lit(">"), F.array_join("path", ">"), F.lit(">")).alias("line")))
    # All parts of a path are listed (it has at most hops + 1 nodes), so paths within others are found by equality.
    n = F.size("path")
    part = lambda i, size: F.struct(F.concat(F.lit(">"), F.array_join(F.slice("path", i, size), ">"), F.lit(">")).alias("line"))
    parts = good.select(F.inline(F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: part(i, size)))))).distinct()
    whole = good.join(parts, "line", "left_anti")
    return whole.orderBy(F.desc(F.size("path")), "line").limit(keep).select("path")


def longest_chains(moves: DataFrame, named: DataFrame, hops: int = 7, bridge: int = 1, seeds: int = 8, keep: int = 1, beam: int = BEAM) -> DataFrame:
    """seed, path: the longest chains of moves from each of the first `seeds` named nodes to another named one, over at most hops nodes, none twice, and
    never through more than bridge unnamed ones in a row; `keep` a seed. Of equally long ones that with more named nodes, then the first by name.

    As in `paths`, the best `beam` states go on after each step.
    """
    m, marks = settled(moves.select("at", "to").distinct(), "moves"), settled(named.select("id").distinct(), "named")
    start = marks.orderBy("id").limit(seeds)
    front = _beam(start.select(F.array("id").alias("path"), F.lit(1).alias("marks"), F.lit(0).alias("streak")), beam)
    found = []
    for _ in range(hops - 1):
        to = front.withColumn("at", F.element_at("path", -1)).join(m, "at").where(~F.array_contains("path", F.col("to")))
        to = to.join(marks.select(F.col("id").alias("to"), F.lit(1).alias("mark")), "to", "left")
        streak = F.when(F.col("mark") == 1, 0).otherwise(F.col("streak") + 1)
        to = to.select(F.array_append("path", F.col("to")).alias("path"), (F.col("marks") + F.coalesce("mark", F.lit(0))).alias("marks"), streak.alias("streak")).where(F.col("streak") <= bridge)
        front = _beam(to, beam)
        if front.isEmpty():
            break
        found.append(front.where("streak = 0"))
    ends = reduce(DataFrame.union, found, front.limit(0)).withColumn("seed", F.get("path", F.lit(0)))
    return top_per_group(ends, ["seed"], [F.desc(F.size("path")), F.desc("marks"), F.array_join("path", ">")], keep).select("seed", "path")
