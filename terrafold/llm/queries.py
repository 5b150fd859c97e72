"""The registered queries of the operators, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, chat, divergence, ego, jaccard, kmtree, mixing, packing, spans, sstable, toxicity, warc
from .common import new_folder
from .oracles import SQL

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations")
    return chat.render(table, chat.fit(table))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    slim = docs.select("doc_id", "text")
    scored = toxicity.score(slim, toxicity.train(slim, labels))
    return scored.select("doc_id", "p_toxic", "expected_severity", "grade", "rejected")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=1)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_substring_dedup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op4_substring_dedup``, but whatever repeats as a run of two sentences counts, however short, and nothing else."""
    return spans.dedup_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=0, enough=2**31)


def op5_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmtree.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_kmeans_tree_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves that ``op5_kmeans_tree`` visits, and the recall of queries that calibration did not see."""
    return kmtree.recall_report(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_table(_table(spark, sf_dir, "pages"))


def op6_warc_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of every page whose id is divisible by 100, looked up in the capture index of all pages."""
    pages, folder = _table(spark, sf_dir, "pages"), new_folder(spark, "warc")
    directory = warc.write_index(warc.write_archives(pages, folder), folder)
    found = warc.lookup(pages.filter("page_id % 100 = 0"), directory)
    return found.groupBy("url").agg(F.count("*").alias("captures"), F.min("page_id").alias("first_page"), F.sum("page_id").alias("page_sum"))


def op7_sorted_string_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_table(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=2)


def op7_sorted_string_table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id is divisible by 100, looked up in shards of all documents."""
    docs = _table(spark, sf_dir, "documents")
    shards = sstable.write_shards(docs, new_folder(spark, "sstable"), public_tokenizers.path(BYTE_BPE), end_id=2)
    return sstable.lookup(docs.filter("doc_id % 100 = 0"), shards)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(_table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op11_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.document_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_toxicity": op2_toxicity,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_substring_dedup": op4_substring_dedup,
        "op4_substring_dedup_whole": op4_substring_dedup_whole,
        "op5_kmeans_tree": op5_kmeans_tree,
        "op5_kmeans_tree_recall": op5_kmeans_tree_recall,
        "op6_warc": op6_warc,
        "op6_warc_lookup": op6_warc_lookup,
        "op7_sorted_string_table": op7_sorted_string_table,
        "op7_sorted_string_table_lookup": op7_sorted_string_table_lookup,
        "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
        "op9_embedding_near_dedup": op9_embedding_near_dedup,
        "op10_mixing": op10_mixing,
        "op11_filter_interaction": op11_filter_interaction,
        "op12_source_divergence": op12_source_divergence,
        "op13_bpe_round_trip": op13_bpe_round_trip,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
