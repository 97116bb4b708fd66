"""A corpus pipeline of five operators of ``brindle.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last keep
the columns of documents, whatever they are called, and change the text only.

Defined cases, by stage: a null text is rejected by the quality rules, and
where a stage is run on its own it counts as empty, is kept and stays null
(near-dedup keeps one of all texts without words, decontamination and the
secret scan let it through, BPE gives it no ids and an empty text). Rows
without an identifier can't be told apart and are all kept by near-dedup; rows
that repeat an identifier are told apart by their texts, of which it keeps one
of each class. Texts of any length are treated
whole; a text must fit a task. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import bpe, decontaminate, quality_rules, secrets, simhash
from brindle.llm.queries import table, vocabulary_path
from brindle.llm.store import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that the rules reject."""
    return quality_rules.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets' values are replaced in the texts."""
    return secrets.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, the number of tokens and the text decoded from the ids."""
    from pyspark.sql import functions as F

    path = vocabulary_path()
    coded = bpe.decode(bpe.encode(docs, path), path)
    return coded.select(F.col("id").alias("doc_id"), "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")


STAGES = [
    ("quality_rules", quality),
    ("simhash_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe", encoding),
]

#: Fingerprints and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
