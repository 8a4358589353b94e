"""Removal of passages that repeat across documents, by windows of doubling length.

1. Every text is cut into windows of half the length. Of each run of ``window // 2 + 1`` consecutive ones the one with the
   smallest hash is an anchor; each full window holds one, and equal windows hold equal ones. An anchor's hash
   together with the hash of the whole text is written.
2. Anchors that stand in one text only do not survive. Texts that equal the text of a smaller document are settled as a whole.
3. Surviving anchors are extended to twice the length: each window around them is hashed to 128 bits, dealt out and sorted
   by hash, and all but those of the smallest document are repeats. Windows around a frequent anchor are dealt out over
   several keys by document; what remains first under each of those keys meets in a second, small pass.

A passage longer than the window is the union of its windows, so nothing is left to extend at twice that length again.

Defined results: a null text has no words; a text shorter than the window loses nothing, even if it repeats; rows that repeat a doc_id
are never removed because of one another (the other document must have a smaller id); null doc_ids come after all
others and not before one another. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import Codes, blank_words, code_array, rows, stored

WINDOW = 50
# Documents with one anchor beyond which its windows are dealt out over several keys.
FREQUENT = 20_000
VOCABULARY = 300_000
LAST = 2**63 - 1
_BASE, _BASE_2 = (np.uint64(b) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))

ANCHORS = "doc long, row long, n int, pos int, hash long, text_hash long, text_hash_2 long"
WINDOWS = "h1 long, h2 long, salt int, doc long, row long, start int"


class _New(Codes):
    """Codes that also list what was numbered last."""

    def __init__(self):
        super().__init__()
        self.fresh = []

    def __missing__(self, key):
        self.fresh.append(key)
        return super().__missing__(key)


class WordHashes:
    """Two independent 64-bit hashes for each word of a text; each distinct word is hashed once while the store lasts."""

    def __init__(self):
        self.codes, self.known = _New(), np.zeros((2, 1 << 16), np.uint64)

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.codes) > VOCABULARY:
            self.codes = _New()
        codes = code_array(self.codes, words)
        if fresh := self.codes.fresh:
            n = len(self.codes)
            if n > self.known.shape[1]:
                self.known = np.concatenate([self.known, np.zeros((2, max(n, self.known.shape[1])), np.uint64)], axis=1)
            self.known[:, n - len(fresh) : n] = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, fresh)), "<u8").reshape(-1, 2).T
            self.codes.fresh = []
        return self.known[:, codes]


_known_powers: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    known = _known_powers.get(int(base))
    if known is None or len(known) < n:
        known = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(2 * n, 4096), base)]))
        _known_powers[int(base)] = known[: 1 << 20]
    return known[:n]


def window_hashes(hashes: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of each window of ``size`` words, in arithmetic modulo 2**64, mixed at the end."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    inverse = np.uint64(pow(int(base), -1, 2**64))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _powers(base, n), out=sums[1:])
    mixed = (sums[size:] - sums[: n - size + 1]) * _powers(inverse, n - size + 1)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def anchor_of_each(hashes: np.ndarray, run: int) -> np.ndarray:
    """For each run of consecutive values the place of its first smallest one."""
    if len(hashes) < run:
        return np.zeros(0, np.int64)
    order = np.argsort(hashes, kind="stable")
    low = np.empty(len(hashes), np.int64)
    low[order] = np.arange(len(hashes))
    width = 1
    while width < run:
        step = min(width, run - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    return order[low]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _anchors_of(window: int):
    half = window // 2
    run = window - half + 1

    def found(batches):
        known = WordHashes()
        for batch in batches:
            parts = []
            for doc, row, text in rows([batch], "doc", "row", "text"):
                words = blank_words(text)
                first = known.of(words)[0]
                small = window_hashes(first, half, _BASE)
                places = np.unique(anchor_of_each(small, run))
                whole = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), "<i8")
                parts.append((doc, row, len(words), places, small[places], whole))
            yield _anchor_rows(parts)

    return found


def _anchor_rows(parts) -> pa.RecordBatch:
    counts = np.array([1 + len(p[3]) for p in parts], np.int64)
    first = np.cumsum(counts) - counts
    pos, hashes, second = np.full(counts.sum(), -1, np.int32), np.zeros(counts.sum(), np.uint64), np.zeros(counts.sum(), np.int64)
    rest = np.ones(len(pos), bool)
    rest[first] = False
    if rest.any():
        pos[rest] = np.concatenate([p[3] for p in parts])
        hashes[rest] = np.concatenate([p[4] for p in parts])
    second[first] = [p[5][1] for p in parts]
    repeat = lambda i, kind: pa.array(np.repeat(np.array([p[i] for p in parts], kind), counts))
    return pa.RecordBatch.from_arrays(
        [repeat(0, np.int64), repeat(1, np.int64), repeat(2, np.int32), pa.array(pos), _signed(hashes),
         pa.array(np.repeat(np.array([p[5][0] for p in parts], np.int64), counts)), pa.array(second)],
        ["doc", "row", "n", "pos", "hash", "text_hash", "text_hash_2"])


def _windows_around(window: int):
    half = window // 2
    run = window - half + 1

    def found(batches):
        known = WordHashes()
        for batch in batches:
            for doc, row, text, survivors in rows([batch], "doc", "row", "text", "survivors"):
                hashes = known.of(blank_words(text))
                small = window_hashes(hashes[0], half, _BASE)
                salts = np.zeros(len(small), np.int64)
                for s in survivors:
                    salts[s["pos"]] = s["salts"]
                # the anchor of each window, and whether it survived
                at = anchor_of_each(small, run)
                starts = np.flatnonzero(salts[at] > 0)
                if not len(starts):
                    continue
                one, two = (window_hashes(h, window, b)[starts] for h, b in ((hashes[0], _BASE), (hashes[1], _BASE_2)))
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [_signed(one), _signed(two), pa.array((doc % salts[at[starts]]).astype(np.int32) + (salts[at[starts]] > 1).astype(np.int32)),
                     pa.array(np.full(n, doc)), pa.array(np.full(n, row)), pa.array(starts.astype(np.int32))],
                    ["h1", "h2", "salt", "doc", "row", "start"])

    return found


def _later(batches):
    """Of windows sorted by hash, salt and document: those after the first document, and the first ones of salted keys."""
    last, smallest = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, salt, doc = (batch.column(c).to_numpy() for c in ("h1", "h2", "salt", "doc"))
        new = np.ones(len(doc), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (salt[1:] != salt[:-1])
        new[0] = last != (h1[0], h2[0], salt[0])
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        firsts = doc[heads]
        least = np.where(group < 0, smallest if smallest is not None else 0, firsts[np.maximum(group, 0)] if len(firsts) else 0)
        last, smallest = (h1[-1], h2[-1], salt[-1]), least[-1]
        repeated = doc > least
        kept = repeated | (salt > 0)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).filter(pa.array(kept)) for c in ("h1", "h2", "doc", "row", "start")), pa.array(repeated[kept])],
            ["h1", "h2", "doc", "row", "start", "repeated"])


def repeats(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Starts of repeated windows, and the documents that repeat an earlier one as a whole."""
    if window < 2 or window % 2:
        raise ValueError("the window is twice the first length, an even number of words")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(docs)
    written = stored(keyed.mapInArrow(_anchors_of(window), ANCHORS))
    heads, inner = written.where("pos < 0"), written.where("pos >= 0")
    texts = heads.groupBy("text_hash", "text_hash_2").agg(F.min("doc").alias("rep"))
    copies = heads.join(texts, ["text_hash", "text_hash_2"]).where((F.col("doc") > F.col("rep")) & (F.col("n") >= window)).select("doc", "row").distinct()
    surviving = inner.groupBy("hash").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b"), F.count("*").alias("times")).where("a <> b")
    candidates = (
        inner.select("hash", "doc", "row", "pos")
        .join(surviving.select("hash", F.ceil(F.col("times") / FREQUENT).cast("int").alias("salts")), "hash")
        .join(copies, ["doc", "row"], "left_anti")
        .groupBy("doc", "row")
        .agg(F.collect_list(F.struct("pos", "salts")).alias("survivors"))
    )
    around = keyed.join(candidates, ["doc", "row"]).mapInArrow(_windows_around(window), WINDOWS)
    later = (
        around.repartition(parts, "h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", "doc")
        .mapInArrow(_later, "h1 long, h2 long, doc long, row long, start int, repeated boolean")
    )
    later = stored(later)
    open_ = later.where("NOT repeated")
    first = open_.groupBy("h1", "h2").agg(F.min("doc").alias("least"))
    found = later.where("repeated").select("doc", "row", "start").unionByName(
        open_.join(first, ["h1", "h2"]).where("doc > least").select("doc", "row", "start"))
    return found, copies


def clean(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, words, the removed spans (first word, number) and the kept words joined by single spaces."""
    starts, copies = repeats(docs, window)
    removal = starts.groupBy("doc", "row").agg(F.collect_set("start").alias("starts"))
    joined = (
        _keyed(docs).join(removal, ["doc", "row"], "left")
        .join(copies.withColumn("whole", F.lit(True)), ["doc", "row"], "left")
        .select("doc", "text", "starts", F.coalesce("whole", F.lit(False)).alias("whole"))
    )

    def cut(batches):
        for batch in batches:
            out = []
            for text, starts, whole in rows([batch], "text", "starts", "whole"):
                words = blank_words(text)
                edge = np.zeros(len(words) + 1, np.int64)
                if whole:
                    edge[0] += 1
                elif starts:
                    at = np.array(starts)
                    edge[at] += 1
                    edge[at + window] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                if gone.any():
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    spans = [{"first": int(a), "n": int(b - a)} for a, b in turns.reshape(-1, 2)]
                    words_kept = [words[i] for i in np.flatnonzero(~gone)]
                else:
                    spans, words_kept = [], words
                out.append((len(words), int(gone.sum()), spans, b" ".join(words_kept)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([o[2] for o in out], pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))),
                 pa.array([o[3] for o in out], pa.binary()).cast(pa.string())],
                ["doc", "n_words", "n_removed", "spans", "kept"])

    out = joined.mapInArrow(cut, "doc long, n_words long, n_removed long, spans array<struct<first: int, n: int>>, kept string")
    return out.select(F.nullif("doc", F.lit(LAST)).alias("doc_id"), "n_words", "n_removed", "spans", "kept")


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
o AS (SELECT doc_id, s, array_to_string(w[s:s + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS s FROM t WHERE len(w) >= {WINDOW})),
f AS (SELECT g, min(doc_id) AS least FROM o GROUP BY g HAVING count(*) > 1),
q AS (SELECT doc_id, unnest(range(s, s + {WINDOW})) AS p FROM o JOIN f USING (g) WHERE doc_id > least),
x AS (SELECT doc_id, list_distinct(list(p)) AS gone FROM q GROUP BY doc_id),
k AS (SELECT doc_id, len(w) AS n, coalesce(len(gone), 0) AS r, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END AS kept
      FROM t LEFT JOIN x USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k"""
