"""Keeping an index fresh: reconcile by content, pending files, debounced change feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.operators.intervals import debounced
from graphmill.store import shared


def reconcile(disk: DataFrame, index: DataFrame, key: str = "path", hash: str = "hash") -> DataFrame:
    """path, change: added, modified or removed; files alike in both are left out."""
    d, i = disk.select(F.col(key).alias("path"), F.col(hash).alias("_d")), index.select(F.col(key).alias("path"), F.col(hash).alias("_i"))
    change = F.when(F.col("_i").isNull(), "added").when(F.col("_d").isNull(), "removed").when(F.col("_d") != F.col("_i"), "modified")
    return d.join(i, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def stale(disk: DataFrame, index: DataFrame) -> DataFrame:
    """path: files present in both whose hashes differ."""
    return disk.alias("d").join(index.alias("i"), "path").where("d.hash != i.hash").select("path")


def candidates(disk: DataFrame, index: DataFrame) -> DataFrame:
    """path: files whose size or whole-millisecond time differ from the index; only these need hashing. Both: path, size, modified_at."""
    met = disk.alias("d").join(index.alias("i"), "path", "left")
    return met.where("i.size is null or d.size != i.size or floor(d.modified_at) != floor(i.modified_at)").select("path")


def pending(events: DataFrame, sync_started: str, sync_in_flight: bool = False) -> DataFrame:
    """path, first_seen, last_seen, indexing of files not surely in the index: a sync clears only files last seen before it began
    (rather stale by mistake than fresh by mistake). events: path, ts."""
    at = F.lit(sync_started).cast("timestamp")
    seen = events.groupBy("path").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return seen.where(F.col("last_seen") > at).withColumn("indexing", F.lit(sync_in_flight) & (at >= F.col("last_seen")))


def banner(results: DataFrame, waiting: DataFrame) -> DataFrame:
    """results (with file_path) and whether each one's file is pending."""
    return results.join(waiting.select(F.col("path").alias("file_path")).distinct().withColumn("stale", F.lit(True)), "file_path", "left").withColumn("stale", F.coalesce("stale", F.lit(False)))


def bursts(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """path, start, last, n of bursts of a stream of changes (path, ts); a burst is done once the watermark, `late` behind, has passed its gap."""
    return debounced(stream.withWatermark("ts", late), "path", "ts", gap)


def run_feed(spark: SparkSession, source: DataFrame, gap: str, late: str, name: str) -> DataFrame:
    """All bursts of what the source holds now, through a streaming query into a table in the cluster's shared folder."""
    done, folder = bursts(source, gap, late), f"{shared(spark)}/graphmill-{name}"
    sink = done.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(done.schema).parquet(f"{folder}/rows")


def backoff(failures: int, debounce_ms: int = 2000, most_ms: int = 30_000, give_up: int = 5) -> int | None:
    """Milliseconds to wait after so many failed syncs in a row, or None: serve from a stale index and say so."""
    return None if failures > give_up else min(most_ms, debounce_ms * 2 ** max(0, failures - 1))


def on_each_batch(index_of, apply):
    """A foreachBatch function: the changes of a micro-batch of (path, hash), reconciled with index_of() and handed to apply(changes, batch)."""

    def step(batch: DataFrame, number: int) -> None:
        named = index_of().join(batch.select("path").distinct(), "path", "left_semi")
        apply(reconcile(batch.where("hash is not null"), named), number)

    return step
