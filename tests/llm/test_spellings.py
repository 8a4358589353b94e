"""Spelling variants against plain Python."""

import random
import re
import string
import zlib
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provenant.llm import spellings


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=2):
    forms, out = {}, []
    links = {w: [v for v in counts if near(w, v)] for w in counts}
    for w, n in counts.items():
        best = min(links[w], key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, len(links[w]), counts[forms[w]] if forms[w] else None))
    return sorted(out)


def answer(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(words=st.dictionaries(st.text("abé", min_size=1, max_size=6), st.integers(1, 40), min_size=1, max_size=80))
def test_forms_of_dense_vocabularies(spark, words):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert answer(spellings.forms(df)) == brute(words)


def test_chains_of_forms_repeats_and_odd_words(spark):
    words = {"a" * (5 + k): 3 * 2**k for k in range(20)} | {"ab𝄞cd": 4, "ab𝄞cx": 9, "": 5}
    rows = [(w, n) for w, n in words.items()] + [(None, 4), ("ab𝄞cd", 1)]
    want = brute({w: n + (w == "ab𝄞cd") for w, n in words.items() if w})
    assert answer(spellings.forms(spark.createDataFrame(rows, "word string, n long"))) == want
    assert answer(spellings.forms(spark.createDataFrame([], "word string, n long"))) == []


def test_words_of_any_length(spark):
    r = random.Random(2)
    long = "".join(r.choices(string.ascii_lowercase, k=4_000))
    words = {long: 9, long[:2_000] + long[2_001:]: 4, long[:-1] + "é": 3, long[:3_000]: 5}
    assert answer(spellings.forms(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute(words)


def test_a_common_prefix_is_no_hot_node(spark):
    words = {"q" * 30 + "".join(p): 3 + k % 7 for k, p in enumerate(zip(*[iter("".join(chr(97 + (i * i) % 23) for i in range(2400)))] * 4, strict=True))}
    assert answer(spellings.forms(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute(words)


def test_damaged_runs_of_whole_texts(spark):
    r = random.Random(5)
    base = ["station", "statiön", "garden", "ÀÉÎ÷×éé", "Straße", "x", "ab", "weather", "wEaTher"]
    docs = [(i, " ".join(r.choices(base, k=400)) + "1_" + r.choice(base), None, "w") for i in range(60)]
    docs += [(None, "Station station garden", None, "w"), (7, None, None, "w"), (8, "", None, "w"), (7, "station " * 30_000, None, "w")]
    want = Counter()
    for doc, text, _, _ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            want[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    df = spark.createDataFrame(docs, "doc_id long, text string, run string, word string")
    found = spellings.runs(df).select(spellings.damaged(F.col("run"), F.col("doc_id")).alias("word"))
    got = {r.word: r.n for r in spellings.vocabulary(found).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    assert answer(spellings.forms(spellings.vocabulary(found))) == brute(got)
    assert spellings.vocabulary(spellings.runs(df.limit(0)).select(F.col("run").alias("word"))).count() == 0
