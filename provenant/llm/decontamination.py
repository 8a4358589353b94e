"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` turns the texts into segments of about ``SEGMENT_WORDS`` words or of ``SEGMENT_DOCS`` documents. A segment has one row per term with the
term's positions (as gaps) and one row, whose term is null, with its documents and their lengths. No shuffle is
needed to build it and a document never spans segments. ``matches`` joins the terms of the searched phrases with the
index, ranks the terms of each phrase by the number of postings, sends a phrase only to segments that hold its rarest
term, and there intersects the offset-adjusted lists from the rarest term on. It finds exact phrases, or all terms
of a phrase within a span of words (proximity).

Defined results: a null or empty text has no words and no matches; rows that repeat a document are judged one by one;
an item without words has no windows; an empty table on either side gives no matches. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import Codes, code_array, list_column, lists, rows, stored, without, words

SEGMENT_WORDS = 2_000_000
# Documents without words fill a segment too: each takes ``GAP`` positions, and positions must stay below 2 ** 31.
SEGMENT_DOCS = 500_000
# Unused positions between documents: no phrase or span of up to so many words crosses a boundary.
GAP = 1024
WINDOW = 10

INDEX = "segment long, term binary, n int, gaps array<int>, docs array<long>, lengths array<int>"
MATCH = "segment long, ordinal int, doc_id long, item_id long, position int, length int"


def build_index(docs: DataFrame) -> DataFrame:
    """Positional postings of ``docs(doc_id, text)``."""
    return stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_segments, INDEX))


def _segments(batches):
    part, number = TaskContext.get().partitionId(), 0
    vocabulary, docs, parts, held = Codes(), [], [], 0
    for doc_id, text in rows(batches, "doc_id", "text"):
        found = words(text)
        docs.append(doc_id)
        parts.append(code_array(vocabulary, found))
        held += len(found)
        if held >= SEGMENT_WORDS or len(docs) >= SEGMENT_DOCS:
            yield _segment((part << 32) + number, vocabulary, docs, parts)
            vocabulary, docs, parts, held, number = Codes(), [], [], 0, number + 1
    if docs:
        yield _segment((part << 32) + number, vocabulary, docs, parts)


def _segment(number: int, vocabulary: Codes, docs: list, parts: list[np.ndarray]) -> pa.RecordBatch:
    lengths = np.array([len(p) for p in parts], np.int64)
    codes = np.concatenate(parts)
    positions = np.arange(len(codes)) + np.repeat(np.arange(len(parts)) * GAP, lengths)
    counts = np.bincount(codes, minlength=len(vocabulary))
    by_term = positions[np.argsort(codes, kind="stable")]
    gaps = np.diff(by_term, prepend=0)
    first = np.cumsum(counts) - counts
    gaps[first] = by_term[first]
    n, none = len(vocabulary), np.zeros(len(vocabulary), np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + 1, number)),
            pa.array([None, *vocabulary], pa.binary()),
            pa.array(np.append(0, counts), pa.int32()),
            list_column(gaps, np.append(0, counts), pa.int32()),
            list_column(np.zeros(0), np.append(0, none), pa.int64()) if not docs else pa.array([docs] + [None] * n, pa.list_(pa.int64())),
            pa.array([lengths.tolist()] + [None] * n, pa.list_(pa.int32())),
        ],
        ["segment", "term", "n", "gaps", "docs", "lengths"],
    )


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Windows of ``size`` consecutive words of ``items(item_id, text)``; a shorter item is one window."""

    def cut(batches):
        for item, text in rows(batches, "item_id", "text"):
            found = words(text)
            starts = range(max(1, len(found) - size + 1)) if found else range(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * len(starts), pa.int64()), pa.array(list(starts), pa.int32()),
                 pa.array([found[s : s + size] for s in starts], pa.list_(pa.binary()))],
                ["item_id", "start", "terms"],
            )

    return items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        cut, "item_id long, start int, terms array<binary>")


def matches(index: DataFrame, phrases: DataFrame, span: int | None = None) -> DataFrame:
    """Where the ``phrases(item_id, start, terms)`` occur: exactly, or with ``span`` all terms within so many words.

    A proximity match is each shortest stretch of at most ``span`` words that holds every distinct term.
    """
    if span is not None and span > GAP:
        raise ValueError(f"a span has at most {GAP} words")
    phrases = phrases.select("item_id", "start", "terms").where(F.size("terms") > 0).distinct()
    if phrases.where(F.size("terms") > GAP).limit(1).count():
        raise ValueError(f"a phrase has at most {GAP} words")
    flat = phrases.select("item_id", "start", "terms", F.posexplode("terms").alias("offset", "term"))
    postings = index.where("term IS NOT NULL")
    frequency = postings.select("term", "n").join(flat.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    ranked = (
        flat.join(frequency, "term", "left")
        .groupBy("item_id", "start", "terms")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))).alias("ranked"))
        .where("ranked[0].n > 0")
    )
    ranked = stored(ranked.select("item_id", "start", F.col("ranked.offset").alias("offsets"), F.col("ranked.term").alias("terms")))
    placed = (
        postings.select("segment", "term")
        .join(ranked.withColumn("term", F.col("terms")[0]), "term")
        .select(F.col("segment").alias("place"), "item_id", "start", "offsets", "terms")
    )
    needed = ranked.select(F.explode("terms").alias("term")).distinct()
    lists_of = postings.join(needed, "term", "left_semi").select("segment", "term", "gaps", "docs", "lengths")
    heads = index.where("term IS NULL").select("segment", "term", "gaps", "docs", "lengths")

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return _search(key[0].as_py(), left, right, span)

    return lists_of.unionByName(heads).groupBy("segment").cogroup(placed.groupBy("place")).applyInArrow(search, MATCH)


def _search(segment: int, postings: pa.Table, phrases: pa.Table, span: int | None) -> pa.Table:
    hits = []
    if phrases.num_rows:
        terms = {t: i for i, t in enumerate(postings["term"].to_pylist())}
        values, offsets = lists(postings["gaps"])
        head = terms[None]
        docs, lengths = postings["docs"][head].as_py(), np.array(postings["lengths"][head].as_py(), np.int64)
        begins = np.cumsum(lengths) - lengths + np.arange(len(lengths)) * GAP
        known: dict[bytes, np.ndarray] = {}

        def places(term: bytes) -> np.ndarray:
            if term not in known:
                i = terms.get(term)
                known[term] = np.zeros(0, np.int64) if i is None else np.cumsum(values[offsets[i] : offsets[i + 1]], dtype=np.int64)
            return known[term]

        for item, shifts, wanted in zip(*(phrases[c].to_pylist() for c in ("item_id", "offsets", "terms")), strict=True):
            if span is None:
                starts = _exact(places, shifts, wanted)
                found = [(s, len(wanted)) for s in starts.tolist()]
            else:
                found = _near(places, list(dict.fromkeys(wanted)), span)
            for s, n in found:
                d = int(np.searchsorted(begins, s, side="right")) - 1
                hits.append((segment, d, docs[d], item, s - int(begins[d]), n))
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    columns = list(zip(*hits, strict=True)) or [[]] * len(kinds)
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                ["segment", "ordinal", "doc_id", "item_id", "position", "length"])


def _exact(places, shifts: list[int], wanted: list[bytes]) -> np.ndarray:
    """Starts of a phrase: the lists, each less its term's offset, from the rarest on."""
    found = None
    for shift, term in zip(shifts, wanted, strict=True):
        here = places(term) - shift
        if found is None:
            found = here
        elif len(here):
            found = found[here[np.minimum(np.searchsorted(here, found), len(here) - 1)] == found]
        else:
            return here
        if not len(found):
            return found
    return found


def _near(places, wanted: list[bytes], span: int) -> list[tuple[int, int]]:
    """Shortest stretches with all terms, looked for around the rarest term only."""
    around = places(wanted[0])
    near = []
    for k, term in enumerate(wanted):
        here = places(term)
        if not len(here) or not len(around):
            return []
        at = np.searchsorted(around, here)
        gap = np.minimum(np.abs(around[np.minimum(at, len(around) - 1)] - here), np.abs(here - around[np.maximum(at - 1, 0)]))
        near += [(int(p), k) for p in here[gap < span]]
    near.sort()
    found, last = [], {}
    for p, k in near:
        last[k] = p
        if len(last) == len(wanted):
            first = min(last.values())
            if p - first < span and (not found or found[-1][0] < first):
                found.append((first, p - first + 1))
    return found


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: words, words inside occurring windows, and the items they come from."""
    index = build_index(docs)
    per_row = (
        matches(index, windows(items, size))
        .groupBy("segment", "ordinal")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(position, position + length - 1)"))))).cast("long").alias("n_hit"),
            F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
        )
    )
    heads = index.where("term IS NULL").select("segment", F.posexplode(F.arrays_zip("docs", "lengths")).alias("ordinal", "d"))
    return (
        heads.select("segment", "ordinal", F.col("d.docs").alias("doc_id"), F.col("d.lengths").cast("long").alias("n_words"))
        .join(per_row, ["segment", "ordinal"], "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                F.coalesce("items", F.expr("cast(array() AS array<string>)")).alias("items"))
    )


def uncontaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in whose document no window of an item occurs."""
    return without(docs, contamination(docs, items, size).where("n_hit > 0").select("doc_id"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = """
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g
      FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM b WHERE len(w) > 0)),
o AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM t, (SELECT DISTINCT n FROM k) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, p, n FROM o JOIN k USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""
