"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import functions as F

from provenant.llm import archives, decontamination, hardnegatives, languages, linededup, nearduplicates, neighbours, scaled, sentencepieces, spellings, substrings
from provenant.llm import tokencounts, topk, toxicity
from provenant.llm.common import table

MAX_TOKENS = 1024


def tokenizer_file(name: str) -> Path:
    """Where a vocabulary file lies; only the driver reads it."""
    return Path(public_tokenizers.path(name))


def op1_decontamination(spark, folder):
    return decontamination.digest(decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


def op2_line_dedup(spark, folder):
    return linededup.digest(linededup.clean(table(spark, folder, "documents"), copies_once=False))


def op3_near_duplicates(spark, folder):
    return nearduplicates.classes(table(spark, folder, "documents"))


def op4_sentencepiece(spark, folder):
    model = tokenizer_file("piece_bpe_32k.model").read_bytes()
    return sentencepieces.digest(sentencepieces.encode(table(spark, folder, "documents"), model))


def op5_token_counts(spark, folder):
    model = tokenizer_file("byte_bpe_50k.json").read_text()
    return tokencounts.count_tokens(table(spark, folder, "documents"), model).withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op6_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    return languages.identify(docs, languages.learn(docs))


def op7_substring_dedup(spark, folder):
    return substrings.digest(substrings.clean(table(spark, folder, "documents")))


def op8_warc(spark, folder):
    return archives.digest(archives.round_trip(table(spark, folder, "pages")))


def op9_nearest_neighbours(spark, folder):
    return neighbours.nearest(neighbours.usable(table(spark, folder, "embeddings")))


def op10_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, folder, "labels")))


def op11_topk(spark, folder):
    return topk.best(scaled.usable(table(spark, folder, "embeddings")))


def op12_spellings(spark, folder):
    found = spellings.runs(table(spark, folder, "documents")).select(spellings.damaged(F.col("run"), F.col("doc_id")).alias("word"))
    return spellings.forms(spellings.vocabulary(found))


def op13_hard_negatives(spark, folder):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.mine(scaled.usable(table(spark, folder, "embeddings"), keep={"label": label}).where("label IS NOT NULL"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_line_dedup, op3_near_duplicates, op4_sentencepiece, op5_token_counts, op6_language_id, op7_substring_dedup, op8_warc, op9_nearest_neighbours, op10_toxicity,
           op11_topk, op12_spellings, op13_hard_negatives)}
SQL = {"op1_decontamination": decontamination.SQL, "op2_line_dedup": linededup.SQL, "op7_substring_dedup": substrings.SQL, "op8_warc": archives.SQL,
       "op11_topk": topk.SQL, "op12_spellings": spellings.SQL, "op13_hard_negatives": hardnegatives.SQL}
