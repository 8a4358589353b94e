"""Token counts with a shortcut for whole tokens.

``whole_tokens`` proves, over the whole vocabulary and before any text is read, which strings are one pre-token and encode
alone as one token. In a text these pre-tokens count one each without being merged; only the other ones are given to
the library, once for each distinct one that a task meets while its store of them lasts. Counting needs no shuffle.

Defined results: a null text is empty and has no bytes and no tokens; special strings inside a text are one token each, as the
library's default has it; rows that repeat a document are counted each. Other columns are not read.
"""

from __future__ import annotations

import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

# Fixed value: how the byte-level tokenizers split a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Distinct merged pre-tokens that a task remembers; beyond it the store starts anew.
REMEMBERED = 500_000


def whole_tokens(tokenizer: Tokenizer) -> list[str]:
    """Strings of the vocabulary that are one pre-token and one token when they stand alone."""
    split = regex.compile(PATTERN).findall
    decoded = {tokenizer.decode([i], skip_special_tokens=False): i for i in range(tokenizer.get_vocab_size())}
    strings = [s for s in decoded if "�" not in s and split(s) == [s]]
    alone = tokenizer.encode_batch(strings, add_special_tokens=False)
    return [s for s, e in zip(strings, alone, strict=True) if e.ids == [decoded[s]]]


class Merged(dict):
    """Tokens of a pre-token: whole ones are there from the start, others are merged when first met."""

    def __init__(self, whole: list[str], tokenizer: Tokenizer):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.tokenizer = len(whole), tokenizer

    def __missing__(self, pre_token: str) -> int:
        if len(self) - self.whole >= REMEMBERED:
            kept = [k for k, _ in zip(self, range(self.whole), strict=False)]
            self.clear()
            self.update(dict.fromkeys(kept, 1))
        self[pre_token] = n = len(self.tokenizer.encode(pre_token, add_special_tokens=False).ids)
        return n


def counter(model: str, whole: list[str]):
    """A function that counts the tokens of a text."""
    tokenizer = Tokenizer.from_str(model)
    special = [t["content"] for t in json.loads(model)["added_tokens"]]
    known, split = Merged(whole, tokenizer), regex.compile(PATTERN).findall
    between = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))).split if special else lambda t: [t]

    def count(text: str | None) -> int:
        if not text:
            return 0
        parts = between(text)
        return len(parts) - 1 + sum(sum(map(known.__getitem__, split(p))) for p in parts)

    return count


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id``, bytes and tokens of ``docs(doc_id, text)``."""
    if not _plain(model):
        raise ValueError("special strings of this model take blanks or depend on their neighbours")
    shipped = docs.sparkSession.sparkContext.broadcast((model, whole_tokens(Tokenizer.from_str(model))))  # of the vocabulary's size

    def counted(batches):
        count = counter(*shipped.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array([count(t) for t in batch.column("text").to_pylist()], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")).mapInArrow(
        counted, "doc_id long, n_bytes long, n_tokens long")


def _plain(model: str) -> bool:
    return not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in json.loads(model)["added_tokens"])
