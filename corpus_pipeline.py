"""From documents to ids for training: quality, rules, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, other
columns of docs too, whatever their names. Stages take whole texts of any length, rows that repeat, and nulls in any column;
an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import cotraining, mixing, pieces, rules, simhash
from tessera.llm.common import scratch, settle, table, unsettle


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps. Null texts and metadata are values like others; a null id isn't
    learned from. Without labels of both classes all stay."""
    return cotraining.keep_good(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source. A null text fails the rules; a
    null language or source is a value of its own."""
    return rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-copies; of the same ids the first row. Null ids come
    last. All wordless texts, null ones too, are one group."""
    return simhash.deduplicate(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Null sources are one source; documents without words stay."""
    return mixing.repeated(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, with an end id, and same, whether decoding gives the text back, of each document. A null text has the
    end id alone; null and repeated doc_ids come out as they went in."""
    return pieces.encode_documents(docs, pieces.default_model(), decoded=False)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing_sources),
    ("encoding", encoding),
]

#: Training, components and the piece model can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way is removed once the stage is written, and a stage's own rows
    once the next one's are."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            after = keep(settle(stage(spark, docs, sf_dir)))
        unsettle(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
