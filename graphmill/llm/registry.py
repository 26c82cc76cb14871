"""The queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm import ann, decontaminate, html, langid, linededup, neardup, packing, phrases, prefixes, runs, secrets, suffixes, tokenshards
from graphmill.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), 2048)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.dedup_phrases(table(spark, sf_dir, "documents"), 50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=2).select("doc_id", "n_shingles", "component_id", "kept")


def op4_training_order_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenshards.materialise(table(spark, sf_dir, "documents")).sequences


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10, near=True))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, model, keep=["doc_id"]).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours_of_rows(table(spark, sf_dir, "embeddings"), 5, 50)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.find_runs(table(spark, sf_dir, "documents"), 24, 3, arrange=runs.planted_order))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.digest(prefixes.trie(*prefixes.rebuilt(prefixes.ordered_turns(table(spark, sf_dir, "conversations")))))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.dedup_bytes(table(spark, sf_dir, "documents"), 100))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_substring_dedup, op3_minhash_near_dedup, op4_training_order_shards, op5_benchmark_decontamination, op6_language_id, op7_line_dedup, op8_nearest_neighbours, op9_secret_scan, op10_html_extraction, op11_word_runs, op12_conversation_trie, op13_suffix_dedup)}
ORACLE_SQL: dict[str, str] = {"op7_line_dedup": linededup.ORACLE_SQL, "op12_conversation_trie": prefixes.ORACLE_SQL}
