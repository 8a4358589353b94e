"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

1. Lexicon. In a sample of labelled documents, words and their beginnings are counted by label, once for each pair of neighbours they
   stand between, so that copies of a document count once. Those that are far more frequent in toxic documents are its terms and stems.
2. A word is compared with all terms at once: the Levenshtein automaton of the word, of one edit and for long words of two, is run down
   a trie of the terms. Words that share no undamaged part of a term at its place are settled before (with d edits, one of d + 1 parts
   of a term stays as it is). The answer for a distinct word is kept.
3. Each hit is read in its context, ``CONTEXT`` words to either side: whether it stands in quotation marks, and how much likelier the
   words around it are near hits in toxic than near hits in other documents (quotation, reports, word lists). A logistic
   regression weighs exact and misspelled hits inside and outside quotation and the context score.

The classifier is fitted on at most about ``SAMPLE`` labelled documents, drawn by a hash of doc_id; that is its only bound. Every text is
judged whole, without a shuffle.

Defined results: a null or empty text has no hits and gets the score of none; without toxic labels to learn from the score is the share of
toxic ones (0 without labels); rows that repeat a doc_id are judged each, and are learned from once per label row; rows without doc_id are not
learned from and not held out. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import rows, stored
from provenant.llm.languages import fold

SAMPLE = 6_000
HELD_OUT = 0
CONTEXT = 6
# A term stands in at least so many different places in toxic documents, and is so many times as frequent there.
LEAST, RATIO = 4, 20.0
# Beginnings of words, of so many letters, that are terms for all words they begin if they are as telling.
STEMS = range(4, 8)
LEAST_STEM = 12
TERMS = 20_000
CUES = 5_000
REMEMBERED = 400_000
RIDGE = 1.0

_word = re.compile(r"\w+")
_mark = re.compile('["“”„«»]')
# Which marks close what a mark opens.
_CLOSED_BY = {"“": "”", "„": "“”", "«": "»", "»": "«"}
FEATURES = 6


def quotations(text: str) -> list[tuple[int, int]]:
    """Stretches in quotation marks, in order and apart from each other, of any length and over any number of lines.

    Marks of each kind are paired by themselves in one pass; marks that find no partner mean nothing. A straight mark opens only before
    what is no blank and not after a letter or digit, and closes only after what is no blank and not before a letter or digit.
    """
    opened: dict[str, int] = {}
    spans = []
    for m in _mark.finditer(text):
        c, i = m[0], m.start()
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        if c == '"':
            closes = before and not before.isspace() and not after.isalnum()
            partner = c if closes and opened.get(c, i) < i - 1 else None
        else:
            partner = max((o for o, closing in _CLOSED_BY.items() if c in closing and opened.get(o, i) < i - 1), key=opened.__getitem__, default=None)
        if partner:
            spans.append((opened.pop(partner), i + 1))
        elif c in _CLOSED_BY or c == '"' and after and not after.isspace() and not before.isalnum():
            opened[c] = i
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def edits(length: int) -> int:
    """Edits allowed in a term of so many letters."""
    return 0 if length < 4 else 1 if length < 9 else 2


class Lexicon:
    """A trie of terms that Levenshtein automata of words are run down."""

    def __init__(self, terms: list[str], stems: list[str] = ()):
        self.terms, self.trie = set(terms), {}
        parts: dict[int, dict[tuple[int, int], set[str]]] = {}
        self.stems, self.stem_lengths = set(stems), sorted({len(s) for s in stems})
        for term in terms:
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
            d = edits(len(term))
            if d:
                self._parts(term, d, parts)
        self.most = {length: max(edits(len(t)) for t in terms if abs(len(t) - length) <= edits(len(t))) for length in parts}
        self.parts = {length: [(a, b, found) for (a, b), found in at.items()] for length, at in parts.items()}

    @staticmethod
    def _parts(term: str, d: int, parts: dict) -> None:
        """Parts of a term, one of which is undamaged, by the word's length and the place of the part in it."""
        edges = [len(term) * k // (d + 1) for k in range(d + 2)]
        for a, b in zip(edges, edges[1:], strict=False):
            for length in range(len(term) - d, len(term) + d + 1):
                for shift in range(-d, d + 1):
                    # the letters before and after the part are shortened or lengthened by at most d edits in all
                    if 0 <= a + shift and b + shift <= length and abs(shift) + abs(length - len(term) - shift) <= d:
                        parts.setdefault(length, {}).setdefault((a + shift, b + shift), set()).add(term[a:b])

    def near(self, word: str) -> int:
        """0 for a term, else the least number of edits to one, or -1 if all are further than allowed."""
        if word in self.terms:
            return 0
        for n in self.stem_lengths:
            if word[:n] in self.stems:
                return 0
        for a, b, found in self.parts.get(len(word), ()):
            if word[a:b] in found:
                return self._run(word, self.most[len(word)])
        return -1

    def _run(self, word: str, most: int) -> int:
        """Depth first through the trie. A state of the automaton is, for each number of edits, the set (as bits) of letters read."""
        n, accept, best = len(word), 1 << len(word), -1
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        start, bits = [], 0
        for i in range(most + 1):
            bits |= 1 << i if i <= n else 0
            start.append(bits)
        stack = [(self.trie, tuple(start))]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c == "":
                    d = next((k for k, s in enumerate(state) if s & accept), None)
                    if d is not None and d <= edits(len(child)) and (best < 0 or d < best):
                        best = d
                    continue
                mask, following, before = masks.get(c, 0), [], 0
                for k, s in enumerate(state):
                    moved = (s & mask) << 1
                    if k:
                        # a letter too many in the term, another letter, a letter missing in it
                        moved |= state[k - 1] | state[k - 1] << 1 | before << 1
                    before = moved & ((accept << 1) - 1)
                    following.append(before)
                if any(following):
                    stack.append((child, tuple(following)))
        return best


class Reader:
    """Finds and describes the hits of a text."""

    def __init__(self, terms: list[str], stems: list[str] = (), cues: dict[str, float] | None = None):
        self.lexicon, self.cues, self.known, self.near = Lexicon(terms, stems), cues or {}, set(), {}

    def hits(self, text: str | None) -> tuple[list[tuple[bool, bool, list[str]]], int]:
        """For each hit whether it is misspelled, whether quoted, and the words around it; and the number of words."""
        found = _word.findall(text.lower()) if text else []
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.near.clear()
        distinct, near = set(found), self.near
        for w in distinct - self.known:
            if (d := self.lexicon.near(w)) >= 0:
                near[w] = d
        self.known |= distinct
        if near.keys().isdisjoint(distinct):
            return [], len(found)
        places = [i for i, w in enumerate(found) if w in near]
        lower = text.lower()
        spans = quotations(lower)
        at, edge = [m.start() for m in _word.finditer(lower)], 0
        out = []
        for i in places:
            while edge < len(spans) and spans[edge][1] <= at[i]:
                edge += 1
            quoted = edge < len(spans) and spans[edge][0] <= at[i]
            around = [w for j in range(max(0, i - CONTEXT), min(len(found), i + CONTEXT + 1)) if j != i and (w := found[j]) not in near]
            out.append((near[found[i]] > 0, quoted, around))
        return out, len(found)

    def features(self, text: str | None) -> list[float]:
        """Hits that are exact or misspelled and not quoted, quoted ones, context, density, and a constant."""
        found, n = self.hits(text)
        kinds = Counter((q, m) for m, q, _ in found)
        context = [sum(self.cues.get(w, 0.0) for w in around) / (len(around) + 2) for _, _, around in found]
        return [math.log1p(kinds[False, False]), math.log1p(kinds[False, True]), math.log1p(kinds[True, False] + kinds[True, True]),
                float(np.mean(context)) if context else 0.0, math.log1p(100 * len(found) / n) if n else 0.0, 1.0]


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton's method with a ridge on all but the constant."""
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic`` of about ``SAMPLE`` labelled documents that are not held out."""
    key = F.col("doc_id").cast("long")
    draw = lambda c: F.xxhash64(c.cast("string"), F.lit("toxic")) / F.lit(2.0**64) + 0.5
    known = labels.select(key.alias("doc"), F.col("toxic").cast("int").alias("toxic")).where("doc IS NOT NULL AND toxic IN (0, 1)").where(fold(F.col("doc"), 5) != HELD_OUT)
    share = SAMPLE / max(1, known.count())
    drawn = known.where(draw(F.col("doc")) < share)
    return docs.select(key.alias("doc"), F.col("text").cast("string").alias("text")).where(draw(F.col("doc")) < share).join(drawn, "doc").select("text", "toxic")


def _counted(batches):
    """Words of sampled texts with a hash of their neighbours."""
    for text, toxic in rows(batches, "text", "toxic"):
        found = ["", *_word.findall((text or "").lower()), ""]
        pairs = {(b, xxhash.xxh3_64_intdigest(f"{a} {c}") >> 1) for a, b, c in zip(found, found[1:], found[2:], strict=False)}
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in pairs], pa.string()), pa.array([h for _, h in pairs], pa.int64()), pa.array([toxic] * len(pairs), pa.int32())],
            ["word", "around", "toxic"])


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """Terms, cues and weights. What comes to the driver is bounded by ``TERMS``, ``CUES`` and ``SAMPLE``."""
    sample = stored(labelled_sample(docs, labels))
    counts = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n, n1 = sum(counts.values()), counts.get(1, 0)
    if not n1 or n1 == n:
        return {"terms": [], "stems": [], "cues": {}, "weights": None, "share": n1 / n if n else 0.0}
    counted = sample.mapInArrow(_counted, "word string, around long, toxic int").distinct()

    def telling(words: DataFrame, least: int) -> list[str]:
        ratio = ((F.col("a") + 0.5) / (n1 + 1)) / ((F.col("b") + 0.5) / (n - n1 + 1))
        by_label = words.groupBy("word").agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("a"), F.count(F.when(F.col("toxic") == 0, 1)).alias("b"))
        picked = by_label.where((F.col("a") >= least) & (ratio >= RATIO) & (F.length("word") >= 3)).orderBy(ratio.desc(), "word").limit(TERMS)
        return sorted(r.word for r in picked.select("word").collect())

    terms = telling(counted, LEAST)
    beginnings = F.explode(F.array([F.substring("word", 1, k) for k in STEMS]))
    longer = counted.where(F.length("word") > STEMS[0]).select(beginnings.alias("stem"), "word", "toxic", "around").where("length(stem) < length(word)")
    # a stem begins several words: one that begins a single frequent word is that word
    varied = longer.where("toxic = 1").groupBy("stem").agg(F.countDistinct("word").alias("n")).where(F.col("n") >= LEAST).select("stem")
    stems = telling(longer.join(varied, "stem", "left_semi").select(F.col("stem").alias("word"), "toxic"), LEAST_STEM)

    def around(batches):
        reader = Reader(terms, stems)
        for text, toxic in rows(batches, "text", "toxic"):
            seen = [w for _, _, words in reader.hits(text)[0] for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array([toxic] * len(seen), pa.int32())], ["word", "toxic"])

    near = stored(sample.mapInArrow(around, "word string, toxic int").groupBy("word").pivot("toxic", [0, 1]).count().na.fill(0))
    total = near.agg(F.sum("0").alias("b"), F.sum("1").alias("a")).first()
    cues = {}
    if (total.a or 0) >= 50 and (total.b or 0) >= 50:  # else there is nothing to tell quotation from abuse by
        log_odds = F.log((F.col("1") + 2) / (total.a + 4)) - F.log((F.col("0") + 2) / (total.b + 4))
        cues = {r.word: r.s for r in near.select("word", log_odds.alias("s")).where("abs(s) >= 0.5").orderBy(F.abs("s").desc(), "word").limit(CUES).collect()}

    def described(batches):
        reader = Reader(terms, stems, cues)
        for batch in batches:
            found = [reader.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    # equal feature rows are counted, so that at most the sample's distinct ones come to the driver
    described_rows = sample.mapInArrow(described, "x array<double>, toxic int").groupBy("x", "toxic").agg(F.count("*").alias("n")).orderBy("x", "toxic").collect()
    x, y, times = (np.array([r[k] for r in described_rows], np.float64) for k in ("x", "toxic", "n"))
    return {"terms": terms, "stems": stems, "cues": cues, "weights": _weighted(x, y, times), "share": n1 / n}


def _weighted(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A hit outside quotation never speaks against toxicity: such a feature is left out and the rest fitted anew."""
    at, used = np.repeat(np.arange(len(x)), times.astype(np.int64)), list(range(x.shape[1]))
    while True:
        w = np.zeros(x.shape[1])
        w[used] = logistic(x[np.ix_(at, used)], y[at])
        against = [k for k in (0, 1) if w[k] < 0]
        if not against:
            return w
        used = [k for k in used if k not in against]


def _scores(model: dict):
    """A function of texts to scores, with a store of the words it has met."""
    reader = Reader(model["terms"], model["stems"], model["cues"])

    def scores(texts: list[str | None]) -> np.ndarray:
        if model["weights"] is None:
            return np.full(len(texts), float(model["share"]))
        x = np.array([reader.features(t) for t in texts]).reshape(-1, FEATURES)
        return 1 / (1 + np.exp(-np.clip(x @ model["weights"], -30, 30)))

    return scores


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded, see learn

    def scored(batches):
        scores = _scores(shipped.value)
        for batch in batches:
            p = scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(fold(F.col("doc_id"), 5) == HELD_OUT, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(
        scored, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted to be toxic."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches):
        scores = _scores(shipped.value)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column("text").to_pylist()) < 0.5))

    return docs.mapInArrow(kept, docs.schema)
