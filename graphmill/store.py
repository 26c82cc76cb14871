"""Keeping a graph: tables between steps, upserts, deletes that cascade, and edges whose ends exist."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.schema import EDGE, FILE, NODE, Graph, conform

#: Rows below which a side is sent to all tasks; counted before it is sent.
BROADCAST_ROWS = 200_000


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; a session that names none must run on one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (folder or "file:///tmp/checkpoints").rstrip("/")


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """Written to the folder that the cluster shares, and read back: the plan starts anew and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared(spark)}/graphmill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tasks that rows are dealt to, at least, where a row is much work but few bytes.
TASKS = 200


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """df in many partitions by key. A number of partitions that is named is kept; else Spark puts rows that are few bytes once packed into few tasks, however much work they are."""
    return df.repartition(max(TASKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *key)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, marked for broadcast if it is counted to be small; otherwise Spark shuffles both sides."""
    n = rows if rows is not None else df.limit(BROADCAST_ROWS + 1).count()
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def latest(df: DataFrame, key: list[str], order: list[F.Column]) -> DataFrame:
    """One row for each key: the last by order."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new added, or put in place of those of the same key. new holds a key once."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new.select(*old.columns))


def upsert_nodes(nodes: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows without id, kind, name, file_path or language are skipped; the qualified name is the name unless given."""
    new = conform(batch, NODE).where("id is not null and kind is not null and name is not null and file_path is not null and language is not null")
    return upsert(nodes, new.withColumn("qualified_name", F.coalesce("qualified_name", "name")), ["id"])


def upsert_files(files: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch may name a path more than once; its latest indexed_at wins."""
    return upsert(files, latest(conform(batch, FILE), ["path"], [F.desc("indexed_at"), F.desc("content_hash")]), ["path"])


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both ends of which are nodes; parallel edges stay."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def insert_edges(edges: DataFrame, batch: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.unionByName(valid_edges(conform(batch, EDGE), nodes))


def delete_files(graph: Graph, paths: DataFrame) -> Graph:
    """Without the files' nodes, and without every edge that touches one of them. paths: file_path."""
    nodes = graph.nodes.join(paths, "file_path", "left_anti")
    return Graph(nodes, valid_edges(graph.edges, nodes))


def delete_references(refs: DataFrame, done: DataFrame) -> DataFrame:
    """Unresolved references without those resolved, by (from_node_id, reference_name, reference_kind)."""
    return refs.join(done, ["from_node_id", "reference_name", "reference_kind"], "left_anti")


def rekey_edges(edges: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges from elsewhere into re-indexed files, moved to the new ids of their targets.

    A target is found again by (file_path, kind, name); of several such new nodes the last by line and id is
    taken; edges whose target is gone are dropped. old and new: nodes of those files before and after.
    """
    key = ["file_path", "kind", "name"]
    to = latest(new, key, [F.desc("start_line"), F.desc("id")]).select(*(F.col(c).alias(f"_{c}") for c in key), F.col("id").alias("_new"))
    was = old.select(F.col("id").alias("target"), *(F.col(c).alias(f"_{c}") for c in key))
    # Ids are matched before edges are: names and files are few, and their edges many.
    moved = edges.join(was.join(to, [f"_{c}" for c in key]).select("target", "_new"), "target")
    return moved.select(*(F.col("_new").alias("target") if c == "target" else F.col(c) for c in edges.columns))


def write(graph: Graph, folder: str) -> None:
    """Nodes by language, sorted by place; edges by kind."""
    graph.nodes.repartition("language").sortWithinPartitions("file_path", "start_line").write.mode("overwrite").partitionBy("language").parquet(f"{folder}/nodes")
    graph.edges.repartition("kind").sortWithinPartitions("source").write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/edges")


def read(spark, folder: str) -> Graph:
    return Graph(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"))
