"""From raw documents to packed sequences: the stages of the corpus pipeline.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
kept, and returns a DataFrame, which is written as Parquet and read again for
the next stage. All but the last return the columns of ``documents``. No SQL
can express the whole (a trained model, a tokenizer), so ORACLE_SQL is None and
tests hold the pipeline against a brute-force version.

Nulls, empty and repeated rows are as each operator defines them: a null text is
never toxic, joins and loses nothing, has no words to mix and packs as its end
id alone; an empty table gives an empty one at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terrafold.llm.common import new_folder
from terrafold.llm.jaccard import representatives
from terrafold.llm.mixing import mixed
from terrafold.llm.packing import pack_documents
from terrafold.llm.spans import dedup_spans
from terrafold.llm.toxicity import acceptable

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not reject; all, if labels are too few to fit one."""
    return acceptable(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the least id."""
    return representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later occurrences of repeated runs of sentences."""
    return dedup_spans(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids (``ids``) and their places in sequences."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the documents of ``sf_dir``."""
    folder = new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
