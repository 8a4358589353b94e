"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to ``LONGEST``-grams of the whole text in lower case, everything that is not a letter being a blank, hashed to
``BUCKETS``; a feature's value is its share of the text's n-grams times its inverse document frequency. Weights are learned by
follow-the-regularised-leader (FTRL-proximal) with an elastic net (L1 and L2), so that most are zero; a temperature fitted on labelled texts that were
not trained on calibrates the probabilities.

The classifier is fitted on at most about ``PER_LANGUAGE`` labelled documents of each of the ``LANGUAGES`` languages that have most of them (of
equally many, the first by name), drawn by a hash of doc_id; these are its only bounds, and the model has at most ``BUCKETS`` weights a language. Every text is read whole when it is judged. Fitting takes one task, judging no shuffle.

Defined results: texts that are null or have no letter are ``und`` with score 0; so are all texts if no language was learned; rows that repeat a
doc_id are judged each; rows without doc_id or language are not learned from, and the former are not held out. An empty
table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import rows

LONGEST = 3
BUCKETS = 1 << 17
PER_LANGUAGE = 1500
LANGUAGES = 100
HELD_OUT = 2
CALIBRATED_ON = 3
EPOCHS = 2
# FTRL: learning rate, its offset, and the strengths of L1 and L2; features are scaled so that a text's values have a length near 1.
ALPHA, BETA, L1, L2, SCALE = 0.5, 1.0, 3e-2, 1e-5, 3.0
UNKNOWN = "und"

MODEL = "lang string, bucket int, weight double, temperature double"


@functools.cache
def _letters() -> np.ndarray:
    """Code points in lower case by code point, blanks for what is no letter."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    known = [c for c in range(sys.maxunicode + 1) if chr(c).isalpha()]
    table[known] = known
    return table


def letters(text: str | None) -> np.ndarray:
    """Code points of the letters in lower case, with single blanks around and between words; empty without a letter."""
    found = _letters()[np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)]
    found = np.concatenate([[np.uint32(32)], found, [np.uint32(32)]])
    blank = found == 32
    kept = found[~(blank & np.concatenate([[False], blank[:-1]]))]
    return kept if len(kept) > 1 else kept[:0]


def grams(points: np.ndarray):
    """Buckets of all n-grams, one array for each length."""
    value = np.zeros(len(points), np.uint64)
    for n in range(1, LONGEST + 1):
        if len(points) < n:
            return
        value = value[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :]
        mixed = (value + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        yield (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


def shares(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their share of its n-grams."""
    parts = list(grams(letters(text)))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0)
    bucket, n = np.unique(np.concatenate(parts), return_counts=True)
    return bucket, n / n.sum()


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights (buckets by classes) after ``EPOCHS`` passes in the given order."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(at):
        rate = (BETA + np.sqrt(n[at])) / ALPHA + L2
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / rate)

    for _ in range(EPOCHS):
        for bucket, value, label in examples:
            w = weights(bucket)
            p = _softmax(value @ w)
            p[label] -= 1
            g = value[:, None] * p
            sigma = (np.sqrt(n[bucket] + g * g) - np.sqrt(n[bucket])) / ALPHA
            z[bucket] += g - sigma * w
            n[bucket] += g * g
    return weights(np.arange(BUCKETS))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """What logits are divided by so that the labels are likeliest; golden-section search on its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda s: -np.log(np.maximum(_softmax(logits / np.exp(s))[np.arange(len(labels)), labels], 1e-300)).mean()
    a, b, ratio = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _fit(batches):
    texts = [(draw, lang, part, *shares(text)) for draw, lang, part, text in rows(batches, "draw", "lang", "part", "text")]
    texts = sorted((t for t in texts if len(t[3])), key=lambda t: (t[0], t[1], len(t[3]), t[3].tobytes()))
    trained = [t for t in texts if t[2] != CALIBRATED_ON] or texts
    held = [t for t in texts if t[2] == CALIBRATED_ON] or trained
    names = sorted({t[1] for t in trained})
    if not names:
        return
    frequency = np.zeros(BUCKETS)
    for t in trained:
        frequency[t[3]] += 1
    idf = np.log((1 + len(trained)) / (1 + frequency)) + 1
    lengths = [np.sqrt(((t[4] * idf[t[3]]) ** 2).sum()) for t in trained]
    idf *= SCALE / np.mean(lengths)
    number = {lang: k for k, lang in enumerate(names)}
    w = ftrl([(t[3], t[4] * idf[t[3]], number[t[1]]) for t in trained], len(names))
    folded = idf[:, None] * w
    known = [t for t in held if t[1] in number]
    heat = temperature(np.array([t[4] @ folded[t[3]] for t in known]).reshape(-1, len(names)), np.array([number[t[1]] for t in known], np.int64))
    for k, lang in enumerate(names):
        at = np.flatnonzero(w[:, k])
        at = at if len(at) else np.zeros(1, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(folded[at, k]), pa.array(np.full(len(at), heat))], ["lang", "bucket", "weight", "temperature"])


def fold(doc_id, of: int):
    """The remainder that separates rows to learn from and held-out rows."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


def learn(docs: DataFrame) -> DataFrame:
    """Weights by language and bucket (the inverse document frequency folded in) from ``docs(doc_id, text, lang)``."""
    part = fold(F.col("doc_id"), 4)
    labelled = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (part != HELD_OUT)).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), part.alias("part"))
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.lit("lang")) / F.lit(2.0**64) + 0.5
    wanted = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang", (F.lit(float(PER_LANGUAGE)) / F.col("n")).alias("share"))
    # at most LANGUAGES rows; texts are drawn where they are read
    sample = labelled.withColumn("draw", draw).join(F.broadcast(wanted), "lang").where("draw < share").select("draw", "lang", "part", "text")
    return sample.repartition(1).mapInArrow(_fit, MODEL)


def identify(docs: DataFrame, model: DataFrame) -> DataFrame:
    """``doc_id``, predicted language and probability of ``docs(doc_id, text)``."""
    learned = model.collect()  # at most BUCKETS weights a language
    names = sorted({r.lang for r in learned})
    weights = np.zeros((BUCKETS, len(names)), np.float32)
    for r in learned:
        weights[r.bucket, names.index(r.lang)] = r.weight
    heat = learned[0].temperature if learned else 1.0
    shipped = docs.sparkSession.sparkContext.broadcast((names, weights, heat))

    def judged(batches):
        names, weights, heat = shipped.value
        for batch in batches:
            best, score = [], []
            for text in batch.column("text").to_pylist():
                total, n = np.zeros(len(names)), 0
                if names:
                    for found in grams(letters(text)):
                        for a in range(0, len(found), 1 << 16):
                            total += weights[found[a : a + (1 << 16)]].sum(axis=0, dtype=np.float64)
                        n += len(found)
                if n:
                    p = _softmax(total / n / heat)
                    best.append(names[int(p.argmax())])
                    score.append(float(p.max()))
                else:
                    best.append(UNKNOWN)
                    score.append(0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(score, pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(fold(F.col("doc_id"), 4) == HELD_OUT, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text")).select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(
        judged, "doc_id long, held_out boolean, lang_pred string, score double")
