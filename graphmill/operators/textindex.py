"""A stored full-text index of symbols: postings by term, kept so that a search by prefix reads a few row groups of a few files."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions.text import search_terms
from graphmill.operators.search import COLUMN_WEIGHTS, K1, B, tokens
from graphmill.store import settled

#: Letters of a term that name the folder of its postings.
SHELF = 2
_POSTINGS = "shelf string, term string, field string, id string, tf int, len int"


class TextIndex(NamedTuple):
    """postings: shelf, term, field, id, tf, len; fields: field, n, words (of all nodes, those without text too); terms: shelf, term, field, df."""

    postings: DataFrame
    fields: DataFrame
    terms: DataFrame


def texts_of(nodes: DataFrame) -> DataFrame:
    """id, field, words: a row for every node and searched column that nodes has. One pass over nodes for all columns."""
    have = [c for c in COLUMN_WEIGHTS if c in nodes.columns]
    words = (F.struct(F.lit(c).alias("field"), tokens(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("words")) for c in have)
    return nodes.select("id", F.inline(F.array(*words)))


def postings_of(texts: DataFrame) -> DataFrame:
    """field, term, id, tf, len of every word of the texts, which are read twice. Of a text whose words differ, as those of names do, each is there once; only words of the others
    are shuffled to be counted."""
    differ = F.size(F.array_distinct("words")) == F.size("words")
    listed = lambda df: df.select("field", F.explode("words").alias("term"), "id", F.size("words").alias("len"))
    once = listed(texts.where(differ)).withColumn("tf", F.lit(1))
    return once.unionByName(listed(texts.where(~differ)).groupBy("field", "term", "id", "len").agg(F.count("*").cast("int").alias("tf")))


def write(nodes: DataFrame, folder: str) -> None:
    """Postings in folders by the first letters of their terms, within them sorted by term, so files and row groups hold ranges of terms. Terms are
    dealt out by ranges of (term, field, id), so one that a third of all nodes has fills several files. nodes are read once."""
    shelf = F.left("term", F.lit(SHELF)).alias("shelf")
    by = ["shelf", "term", "field", "id"]
    texts = settled(texts_of(nodes), "texts")
    stored = postings_of(texts).select(shelf, "term", "field", "id", "tf", "len").repartitionByRange(*by).sortWithinPartitions(*by)
    stored.write.mode("overwrite").partitionBy("shelf").parquet(f"{folder}/postings")
    terms = nodes.sparkSession.read.schema(_POSTINGS).parquet(f"{folder}/postings").groupBy("shelf", "term", "field").agg(F.count("*").alias("df"))
    terms.repartitionByRange("shelf", "term").sortWithinPartitions("shelf", "term", "field").write.mode("overwrite").partitionBy("shelf").parquet(f"{folder}/terms")
    have = [c for c in COLUMN_WEIGHTS if c in nodes.columns]
    of = lambda c: F.col("field") == c
    sums = texts.agg(*(x for c in have for x in (F.count_if(of(c)).alias(f"n_{c}"), F.coalesce(F.sum(F.when(of(c), F.size("words"))), F.lit(0)).alias(f"w_{c}"))))
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"n_{c}").alias("n"), F.col(f"w_{c}").cast("long").alias("words")) for c in have))
    sums.select(F.inline(rows)).write.mode("overwrite").parquet(f"{folder}/fields")


def read(spark: SparkSession, folder: str) -> TextIndex:
    load = lambda part, schema: spark.read.schema(schema).parquet(f"{folder}/{part}")
    return TextIndex(load("postings", _POSTINGS), load("fields", "field string, n long, words long"), load("terms", "shelf string, term string, field string, df long"))


def with_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Rows of postings or terms whose term begins with prefix: one folder of the table (all those of a letter, for a prefix of one), and there the range of terms."""
    shelf = F.col("shelf") == prefix[:SHELF] if len(prefix) >= SHELF else F.col("shelf").startswith(prefix)
    return df.where(shelf & F.col("term").startswith(prefix))


def completions(index: TextIndex, prefix: str, most: int = 20) -> DataFrame:
    """term, df: the words that begin with prefix, those of most nodes and columns first; from the dictionary alone."""
    return with_prefix(index.terms, prefix.lower()).groupBy("term").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "term").limit(most)


def scores(index: TextIndex, words: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """id, score: BM25 over the columns by prefix, weighed and summed; the same as reading every text. What is collected of it is nothing;
    what is broadcast is a row for each column, and one for each column and word."""
    weights = weights or COLUMN_WEIGHTS
    hits = reduce(DataFrame.unionByName, (with_prefix(index.postings, w).withColumn("word", F.lit(i)) for i, w in enumerate(words)))
    hits = hits.groupBy("field", "word", "id").agg(F.sum("tf").alias("tf"), F.max("len").alias("len"))
    spread = hits.groupBy("field", "word").agg(F.count("*").alias("df"))
    weight = reduce(lambda x, kv: F.when(F.col("field") == kv[0], kv[1]).otherwise(x), weights.items(), F.lit(0.0))
    of = hits.join(F.broadcast(spread), ["field", "word"]).join(F.broadcast(index.fields), "field")
    tf, mean = F.col("tf"), F.col("words") / F.col("n")
    idf: Column = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = weight * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / mean))
    return of.groupBy("id").agg(F.sum(score).alias("score"))


def full_text(index: TextIndex, query: str, nodes: DataFrame | None = None, most: int = 100) -> DataFrame:
    """id, score: the best nodes for a query (only those in nodes, where given), as search.full_text finds them by reading all texts."""
    found = scores(index, search_terms(query, with_stems=False) or [query.lower()])
    found = found if nodes is None else found.join(nodes.select("id"), "id", "left_semi")
    return found.orderBy(F.desc("score"), "id").limit(most)
