"""A corpus pipeline of the operators in provenant.llm: each stage's rows are written and read again as the next one's documents.

Toxic documents go; boilerplate lines go from the others, and with them documents that are nothing else; one document of each class of
near copies stays; documents that hold a passage of the benchmark go; what is left is encoded. All decisions of a stage are
about the documents it is given; only the toxicity classifier is learned from the whole table, as its labels are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provenant.llm import decontamination, linededup, nearduplicates, sentencepieces, toxicity
from provenant.llm.common import stored, table
from provenant.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.cleaned(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearduplicates.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.digest(sentencepieces.encode(docs, tokenizer_file("piece_bpe_32k.model").read_bytes()))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

# Signatures and the trained classifier cannot be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
