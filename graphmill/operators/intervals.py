"""Ranges of lines or times: the tightest that holds a place, merging across gaps, and budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def enclosing(points: DataFrame, ranges: DataFrame, key: str, at: str) -> DataFrame:
    """points with `scope`: the id of the tightest range (latest start, then largest id) of the same key with start <= at <= end, if any.

    A range is listed at the level where it touches at most two buckets (of 2, 4, 8, .. places), so a wide one is two rows too. A point looks
    into its bucket at each level that occurs; there are fewer than 64, so the list of them is small whatever the data.
    points: id, key, at; ranges: scope, key, start, end.
    """
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    level = F.length(F.bin(F.greatest(end - start, F.lit(1))))
    bucket = lambda x: F.expr(f"shiftright({x}, _level)")
    listed = ranges.where(start <= end).withColumn("_level", level.cast("int")).withColumn("_s", start).withColumn("_e", end)
    listed = listed.withColumn("_bucket", F.explode(F.array_distinct(F.array(bucket("_s"), bucket("_e"))))).drop("_s", "_e")
    levels = [r[0] for r in listed.select("_level").distinct().collect()]
    looks = points.withColumn("_p", F.col(at).cast("long")).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    met = looks.withColumn("_bucket", bucket("_p")).join(listed, [key, "_level", "_bucket"]).where((F.col("start") <= F.col(at)) & (F.col("end") >= F.col(at)))
    best = met.groupBy("id").agg(F.max(F.struct("start", "scope")).alias("best")).select("id", F.col("best.scope").alias("scope"))
    return points.join(best, "id", "left")


def merged(ranges: DataFrame, key: str, gap, weight: str = "weight") -> DataFrame:
    """key, start, end, n, weight, top: runs of ranges that start at most gap after all before them have ended."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = ranges.withColumn("_new", F.when(F.col("start") <= reached + gap, 0).otherwise(1))
    runs = flagged.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.sum(weight).alias("weight"), F.max(weight).alias("top")).drop("_run")


def top_per_group(df: DataFrame, key: list[str], order: list, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("rank", nth).where(F.col("rank") <= k)


def within_budget(df: DataFrame, key: str, order: list, size: str, budget: int) -> DataFrame:
    """Rows of each key in order while their sizes sum to at most the budget."""
    total = F.sum(size).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("used", total).where(F.col("used") <= budget)


def greedy_budget(df: DataFrame, key: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Rows of each key taken in order whenever they still fit; the first is always taken. A null size takes nothing.

    What is taken depends on all before it, so a key is read in one task, but as a sorted stream of which only the sum is held: a key may be of any size.
    """
    at, sized = [f.name for f in df.schema].index(key), [f.name for f in df.schema].index(size)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, fresh = None, 0, True
        for b in batches:
            keep = []
            for k, n in zip(b.column(at).to_pylist(), b.column(sized).to_pylist()):
                if fresh or k != now:
                    now, left, fresh, first = k, budget, False, True
                else:
                    first = False
                keep.append(first or (n or 0) <= left)
                left -= (n or 0) if keep[-1] else 0
            yield b.filter(pa.array(keep, pa.bool_()))

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(take, df.schema)


def debounced(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """key, start, last, n: bursts of events, each ended by a gap without one; works on batches and streams."""
    got = events.groupBy(key, F.session_window(ts, gap)).agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("n"))
    return got.select(key, "start", "last", "n")
