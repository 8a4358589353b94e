"""Language ID and toxicity: held-out accuracy, automata against edit distances, odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenant.llm import languages as la
from provenant.llm import queries
from provenant.llm import toxicity as tx

FOLDER = "/root/testdata/sf0.01"


def remainder(doc_id, of):
    return zlib.crc32(str(doc_id).encode()) % of


def test_languages_of_the_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id: r for r in queries.op6_language_id(spark, FOLDER).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    held = [r for r in rows if remainder(r.doc_id, 4) == 2]
    assert {r.doc_id for r in held} == {i for i, g in got.items() if g.held_out}
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) >= 0.98
    assert all(0 <= g.score <= 1 for g in got.values())
    # labels of held-out rows, sources and ids say nothing
    blind = docs.selectExpr("doc_id", "text", "CASE WHEN pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) = 2 THEN 'xx' ELSE lang END AS lang")
    assert la.learn(blind).toPandas().equals(la.learn(docs).toPandas())


def test_languages_of_odd_rows(spark):
    rows = [(i, ("der die und nicht " if i % 2 else "the of and not ") * 5, "de" if i % 2 else "en", 0.0) for i in range(40)]
    rows += [(100, None, "de", 0.0), (101, "", "en", 0.0), (102, "12 34 !? \n", "en", 0.0), (103, "der die " * 20_000, None, 0.0), (None, "the of and", "fr", 0.0), (103, "the and not of", None, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = [(r.doc_id, r.held_out, r.lang_pred) for r in la.identify(df, la.learn(df)).collect()]
    assert {(i, p) for i, _, p in got if i in (100, 101, 102)} == {(100, "und"), (101, "und"), (102, "und")}
    assert sorted(p for i, _, p in got if i == 103) == ["de", "en"]
    assert [(h, p) for i, h, p in got if i is None] == [(False, "en")]
    assert {r.lang_pred for r in la.identify(df, la.learn(df.limit(0))).collect()} == {"und"}
    assert la.identify(df.limit(0), la.learn(df)).count() == 0


def test_temperature_makes_probabilities_honest():
    r = np.random.default_rng(3)
    p = r.dirichlet(np.ones(3), 4000)
    labels = np.array([r.choice(3, p=q) for q in p])
    assert abs(la.temperature(np.log(p) * 4, labels) - 4) < 0.3


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automata_equal_edit_distances():
    r = random.Random(1)
    terms = ["".join(r.choices("abc", k=r.randint(3, 12))) for _ in range(30)]
    lexicon = tx.Lexicon(terms)
    for _ in range(3000):
        word = "".join(r.choices("abc", k=r.randint(1, 14))) if r.random() < 0.5 else "".join(c for c in r.choice(terms) if r.random() < 0.9) + r.choice(["", "a", "b"])
        near = [d for t in terms if (d := distance(word, t)) <= tx.edits(len(t))]
        assert lexicon.near(word) == min(near, default=-1), word
    assert tx.Lexicon(["abc"], ["qrst"]).near("qrstuv") == 0 and tx.Lexicon(["abc"], ["qrst"]).near("qrs") == -1


def test_toxicity_of_the_table(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, FOLDER).collect()}
    assert len(got) == docs.count()
    known = [(got[r.doc_id], r.toxic) for r in labels.collect() if r.toxic is not None]
    assert all(g.held_out == (remainder(g.doc_id, 5) == 0) and g.predicted == (g.score >= 0.5) for g in got.values())
    clean, toxic = ([g.predicted for g, y in known if y == k and g.held_out] for k in (0, 1))
    assert np.mean(clean) <= 0.02 and np.mean(toxic) >= 0.8
    flipped = labels.selectExpr("doc_id", "CASE WHEN pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    assert {r.doc_id: r.score for r in tx.score(docs, tx.learn(docs, flipped)).collect()} == {i: g.score for i, g in got.items()}


@pytest.fixture(scope="module")
def insults(spark):
    """Abuse uses the terms about 'you'; reports quote them."""
    r = random.Random(6)
    plain = ["w" + "".join(r.choices("aeiou", k=4)) for _ in range(60)]
    say = lambda k: " ".join(r.choices(plain, k=k))
    rows, labels = [], []
    for i in range(600):
        term = r.choice(["blockhead", "scoundrel", "vermin"])
        kind = i % 4
        text = [f"{say(12)} you are a {term} you {term} {say(9)}", f'{say(8)} the report cites "{term}" as printed {say(9)}', say(25), f"{say(5)} {say(20)}"][kind]
        rows.append((i, text, 0.0))
        labels.append((i, int(kind == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_quotation_and_misspelling(spark, insults, monkeypatch):
    monkeypatch.setattr(tx, "RATIO", 1.5)
    docs, labels = insults
    model = tx.learn(docs, labels)
    assert {"blockhead", "scoundrel", "vermin"} <= set(model["terms"]) and model["cues"]
    odd = [(1000, "waeio you are a blokchead you scoundrl waeio", 0.0), (1001, 'the report cites "vermin" as printed waeio', 0.0), (1002, None, 0.0), (1003, "", 0.0),
           (1004, "waeio " * 30_000 + "you vermin you are a blockhead", 0.0), (None, "you are a blockhead you vermin", 0.0), (1001, "you are a vermin you vermin", 0.0)]
    got = [(r.doc_id, r.predicted, r.held_out) for r in tx.score(spark.createDataFrame(odd, docs.schema), model).collect()]
    assert [p for i, p, _ in got if i in (1001, 1002, 1003)] == [0, 0, 0, 1]
    assert [(p, h) for i, p, h in got if i is None] == [(1, False)]
    reader = tx.Reader(model["terms"], model["stems"], model["cues"])
    hits, n = reader.hits(odd[0][1])
    assert [m for m, _, _ in hits if m].count(True) >= 2 and n == 8
    assert [q for _, q, _ in reader.hits(odd[1][1])[0]][-1:] != [] and any(q for _, q, _ in reader.hits(odd[1][1])[0])


def plain_ftrl(examples, classes):
    """FTRL-proximal weight by weight, as it is published, with nothing kept sparse."""
    z, n = {}, {}

    def weight(b, k):
        zi, ni = z.get((b, k), 0.0), n.get((b, k), 0.0)
        if abs(zi) <= la.L1:
            return 0.0
        return -(zi - (1 if zi > 0 else -1) * la.L1) / ((la.BETA + ni**0.5) / la.ALPHA + la.L2)

    for _ in range(la.EPOCHS):
        for buckets, values, label in examples:
            w = {(b, k): weight(b, k) for b in buckets for k in range(classes)}
            logits = [sum(v * w[b, k] for b, v in zip(buckets, values, strict=True)) for k in range(classes)]
            e = [np.exp(x - max(logits)) for x in logits]
            for k in range(classes):
                p = e[k] / sum(e) - (k == label)
                for b, v in zip(buckets, values, strict=True):
                    g, old = v * p, n.get((b, k), 0.0)
                    sigma = ((old + g * g) ** 0.5 - old**0.5) / la.ALPHA
                    z[b, k] = z.get((b, k), 0.0) + g - sigma * w[b, k]
                    n[b, k] = old + g * g
    return {key: weight(*key) for key in z}


def test_weights_equal_plain_ftrl():
    r = np.random.default_rng(2)
    examples = []
    for _ in range(60):
        label = int(r.integers(0, 3))
        buckets = np.unique(r.integers(0, 40, 8) + 10 * label)
        examples.append((buckets.astype(np.int32), r.random(len(buckets)), label))
    got, want = la.ftrl(examples, 3), plain_ftrl([(b.tolist(), v.tolist(), y) for b, v, y in examples], 3)
    assert all(abs(got[key] - w) < 1e-9 for key, w in want.items())
    assert np.count_nonzero(got) == sum(w != 0 for w in want.values()) < len(want)


def test_most_weights_are_zero_and_languages_are_bounded(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = la.learn(docs).collect()
    buckets = {b for r in docs.select("text").collect() if r.text for b in la.shares(r.text)[0].tolist()}
    for lang in {r.lang for r in model}:
        assert sum(r.lang == lang and r.weight != 0 for r in model) < 0.3 * len(buckets)
    monkeypatch.setattr(la, "LANGUAGES", 2)
    most = [r.lang for r in docs.where("lang IS NOT NULL AND pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) <> 2").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(2).collect()]
    assert {r.lang for r in la.learn(docs).select("lang").distinct().collect()} == set(most)


def brute_quotations(text):
    """Every mark looks for its partner by itself: the nearest open mark before it that it closes."""
    closing = {"“": "”", "„": "“”", "«": "»", "»": "«", '"': '"'}
    opened, inside = {}, [False] * len(text)
    for i, c in enumerate(text):
        before, after = text[i - 1 : i] if i else "", text[i + 1 : i + 2]
        straight_opens, straight_closes = after and not after.isspace() and not before.isalnum(), before and not before.isspace() and not after.isalnum()
        partners = [(at, o) for o, at in opened.items() if c in closing[o] and at < i - 1 and (c != '"' or straight_closes)]
        if partners:
            at, o = max(partners)
            del opened[o]
            inside[at : i + 1] = [True] * (i + 1 - at)
        elif c in closing and (c != '"' or straight_opens):
            opened[c] = i
    return inside


def test_quotations_of_any_length_and_over_lines():
    r = random.Random(3)
    for _ in range(2000):
        text = "".join(r.choices('ab \n"“”„«»', k=r.randint(0, 40)))
        inside = [False] * len(text)
        spans = tx.quotations(text)
        for a, b in spans:
            inside[a:b] = [True] * (b - a)
        assert inside == brute_quotations(text), text
        assert all(p[1] <= q[0] for p, q in zip(spans, spans[1:], strict=False))
    reader = tx.Reader(["vermin"], [], {})
    for between in (" waeio" * 10, " waeio" * 100_000, "\n\n waeio \n"):
        for a, b in ('""', "“”", "„“", "«»", "»«"):
            hits = reader.hits(f"says {a}the{between} vermin{between}.{b} and vermin 5\" wide")[0]
            assert [q for _, q, _ in hits] == [True, False], (a, len(between))
    assert [q for _, q, _ in reader.hits('an open " mark and vermin “ still vermin')[0]] == [False, False]


def test_toxicity_without_labels(spark, insults):
    docs, labels = insults
    assert {r.score for r in tx.score(docs, tx.learn(docs, labels.limit(0))).collect()} == {0.0}
    assert {r.score for r in tx.score(docs, tx.learn(docs, labels.where("toxic = 1"))).collect()} == {1.0}
    assert tx.score(docs.limit(0), tx.learn(docs, labels)).count() == 0
    kept = tx.without_toxic(docs, tx.learn(docs, labels))
    assert kept.columns == docs.columns and 400 <= kept.count() < 600
