"""From raw documents to packed training sequences: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm import decontaminate, langid, linededup, neardup, packing
from graphmill.llm.common import row_key, stage, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text goes if its words give no language more than this share; texts without letters go too.
LEAST_LANGUAGE_SHARE = 0.4
#: Not expressible in SQL: a trained model, tokenizer ids, and greedy packing; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def _keep(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs that kept names by doc_id and row_hash; one row where docs repeats a row."""
    key = row_key(docs).select("doc_id", "row_hash")
    named = docs.select(*COLUMNS, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("row_id"), F.xxhash64(F.col("text").cast("string")).alias("row_hash"))
    wanted = kept.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("row_id"), "row_hash").distinct()
    twice = key.groupBy(F.col("doc_id").alias("row_id"), "row_hash").count().where("count > 1").select("row_id", "row_hash")
    met = named.join(wanted, ["row_id", "row_hash"], "left_semi")
    once = met.join(twice, ["row_id", "row_hash"], "left_anti").select(*COLUMNS)
    return once.union(met.join(twice, ["row_id", "row_hash"], "left_semi").dropDuplicates(["row_id", "row_hash"]).select(*COLUMNS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words a language claims; lang is what was predicted. Learned from the labels of this stage's input."""
    docs = docs.select(*COLUMNS)
    model = langid.train(docs)
    found = langid.predict(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SHARE)).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of three or more lines are deleted from the texts."""
    return linededup.dedup_lines(docs.select(*COLUMNS)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more) stays: the first."""
    return _keep(docs, neardup.near_duplicates(docs, size=5).where("kept"))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item, or a whole shorter item, go."""
    return _keep(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of at most 2048 tokens."""
    return packing.pack(docs, 2048)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmarks", benchmarks), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
