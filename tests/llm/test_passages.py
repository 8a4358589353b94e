"""Decontamination, line dedup and substring dedup against plain Python on hard rows."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest

from provenant.llm import decontamination as dc
from provenant.llm import linededup as ld
from provenant.llm import queries
from provenant.llm import substrings as ss

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    vocabulary = ["".join(r.choices("abcdeé", k=r.randint(1, 4))) for _ in range(60)]
    say = lambda k: " ".join(r.choices(vocabulary, k=k))
    items = [(1, say(14)), (2, say(10)), (10, say(4)), (3, "One. word"), (4, None), (5, ""), (6, "..."), (7, say(30)), (7, say(12)), (8, say(10)), (8, None)]
    items.append((9, items[0][1]))
    docs = [(i, say(r.randint(0, 80))) for i in range(40)]
    for k, (item, t) in enumerate(items):
        docs.append((100 + k, f"{say(7)} {(t or '').upper()}, {say(5)} {t or ''} {say(3)}"))
    docs += [(200, None), (201, ""), (202, " \n "), (203, items[7][1][:-1]), (204, items[0][1] + " " + " ".join(items[0][1].split()[5:])), (None, items[1][1]), (206, "one word one, word ONE-word"), (100, docs[-3][1]), (207, ("x " * 3000) + items[1][1])]
    return docs, items


def brute_contamination(docs, items):
    out = []
    wins = defaultdict(set)
    for item, t in items:
        w = WORD.findall(lower(t))
        for s in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[s : s + 10])].add(str(item))
    for doc, t in docs:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit.update(range(s, s + n))
                    found |= wins[tuple(w[s : s + n])]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=str)


def test_contamination(spark, texts, monkeypatch):
    docs, items = texts
    monkeypatch.setattr(dc, "SEGMENT_WORDS", 300)
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, items string, segment int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = sorted((tuple(r[c] for c in columns) for r in dc.digest(dc.contamination(d, b)).collect()), key=str)
    assert got == brute_contamination(docs, items)
    assert {r.n_hit for r in dc.digest(dc.contamination(d, b.limit(0))).collect()} == {0}
    assert dc.digest(dc.contamination(d.limit(0), b)).count() == 0
    kept = dc.uncontaminated(d, b)
    assert kept.columns == d.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == sorted((i or -1) for i, *_ in docs if i not in {x[0] for x in got if x[5]})


def test_proximity(spark):
    d = spark.createDataFrame([(1, "a b x c y z a"), (2, "c c b"), (3, "b a q q q q q q c"), (4, "a b"), (5, "c b a c b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    found = dc.matches(dc.build_index(d), dc.windows(b), span=4)
    got = {(r.doc_id, r.position, r.length) for r in found.collect()}

    def brute(text):
        w, out = text.split(), set()
        for s in range(len(w)):
            for e in range(s + 1, min(len(w), s + 4) + 1):
                if {"a", "b", "c"} <= set(w[s:e]) and not {"a", "b", "c"} <= set(w[s + 1 : e]) and not {"a", "b", "c"} <= set(w[s : e - 1]):
                    out.add((s, e - s))
        return out

    assert got == {(r.doc_id, *x) for r in d.collect() for x in brute(r.text)}
    with pytest.raises(ValueError, match="span"):
        dc.matches(dc.build_index(d), dc.windows(b), span=dc.GAP + 1)


def brute_lines(docs, least, copies_once=True):
    """The rule of the module's docstring, word by word."""
    strip, last = "".join(map(chr, range(0x21))), 2**63 - 1
    rows = [(last if doc is None else doc, t, site) for doc, t, site in docs if t is not None]
    if copies_once:
        sited, first = {}, {}
        for doc, t, site in rows:
            first[t] = min(first.get(t, last), doc)
            if site is not None:
                sited[t] = min(sited.get(t, (last + 1, "")), (doc, site))
        rows = [(doc, t, sited.get(t, (0, None))[1]) for t, doc in first.items()]
    sites, keeper = defaultdict(set), {}
    for doc, t, site in rows:
        for x in {x.strip(strip) for x in t.split("\n")} - {""}:
            keeper[x] = min(keeper.get(x, last), doc)
            sites[x] |= set() if site is None else {site}
    out = []
    for doc, t, _ in docs:
        if t is None:
            out.append((doc, 0, 0, None))
            continue
        lines, key = t.split("\n"), last if doc is None else doc
        kept = [x for x in lines if not (x.strip(strip) and len(sites[x.strip(strip)]) >= least and keeper[x.strip(strip)] < key)]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


@pytest.mark.parametrize("copies_once", [True, False])
@pytest.mark.parametrize("least", [1, 3, 10])
def test_lines(spark, least, copies_once):
    r = random.Random(2)
    common = [f"common line {k}" for k in range(14)]
    docs = []
    for i in range(300):
        lines = [f"own {r.random()}" if r.random() < 0.5 else r.choice(common[: 1 + i % 14]) for _ in range(r.randint(0, 6))]
        docs.append((i, "\n".join(lines), f"s{r.randrange(20)}"))
    copy = "a copied text\nof two lines\n" + common[0]
    docs += [(1000 + i, copy, f"s{i}") for i in range(20)]
    docs += [(2000, None, "s1"), (2001, "", "s1"), (2002, " \n\t\n", "s2"), (2003, "  common line 0 \r\nx\x00", None), (None, "common line 0\ncommon line 1", "s3"), (5, docs[5][1], "s9"), (2004, "common line 0", None), (5, "common line 1\nother", "s4")]
    df = spark.createDataFrame([(*d, 7, *"abcdefg") for d in docs], "doc_id long, text string, source string, n_chars int, line string, doc string, whole string, cut string, kept string, sites string, `a.b` string")
    got = sorted((tuple(x) for x in ld.digest(ld.clean(df, least, copies_once)).collect()), key=str)
    want = brute_lines(docs, least, copies_once)
    assert got == want and sum(w[2] for w in want) > (20 if least == 10 else 100)
    assert ld.digest(ld.clean(df.limit(0), least, copies_once)).count() == 0
    left = ld.cleaned(df, least, copies_once)
    assert left.columns == df.columns
    changed = {(r.doc_id, len(r.text)) for r in left.collect() if r.text is not None and r.n_chars != 7}
    assert {n for _, n in changed} == {r.n_chars for r in left.collect() if r.n_chars != 7}
    assert all(r.text is None or r.text.strip() or not (r.text == "" and r.doc_id == 2004) for r in left.collect())


@pytest.mark.parametrize("copies_once", [True, False])
def test_the_sql_states_the_rule(copies_once):
    """On rows that tell the rules apart: blocks of lines, copies of whole texts, texts without a site."""
    docs = [(i, f"own {i} a\nhead\nmiddle\nfoot\nown {i} b", f"s{i}") for i in range(1, 13)] + [(0, "own e\nhead\nmiddle\nfoot", None), (13, "", "s"), (14, None, "s")]
    docs += [(60 + i, "whole\ncopy", None if i < 3 else f"s{i}") for i in range(20)] + [(80 + i, f"nine {i}\nnine", f"s{i % 9}") for i in range(30)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    got = sorted(con.execute(ld.sql(10, copies_once)).fetchall(), key=str)
    want = brute_lines(docs, 10, copies_once)
    assert got == want
    assert sum(w[2] for w in want) == 12 * 3 + (0 if copies_once else 19 * 2)


def test_the_query_counts_every_document(spark, tmp_path):
    """A line on ten sites is boilerplate for the registered query and its SQL, though the pages are copies of one text."""
    docs = [(i, "whole\ncopy", f"s{i}") for i in range(12)] + [(20 + i, f"own {i}\nmixed", f"t{i}") for i in range(5)]
    docs += [(40 + i, "mixed\nsame", f"u{i}") for i in range(5)] + [(60 + i, f"own {60 + i}\nnine", f"s{i}") for i in range(9)] + [(80, None, "s")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = brute_lines(docs, 10, copies_once=False)
    assert sorted((tuple(x) for x in queries.QUERIES["op2_line_dedup"](spark, str(tmp_path)).collect()), key=str) == want
    assert sorted(con.execute(queries.SQL["op2_line_dedup"]).fetchall(), key=str) == want
    assert sum(w[2] for w in want) == 11 * 2 + 9


def test_long_documents_of_lines(spark):
    lines = [f"line {k}" for k in range(200_000)]
    docs = [(0, "\n".join(lines), "s0"), (1, "\n".join(lines[::-1]), "s1"), (2, "\n".join(lines[:150_000] + lines[:150_000]), "s2")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert sorted((tuple(x) for x in ld.digest(ld.clean(df, 3)).collect()), key=str) == brute_lines(docs, 3)


def test_runs_of_documents_without_words(spark):
    """Positions stay below 2 ** 31 however many documents have no words."""
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = spark.range(0, 2_200_000, 1, 1).selectExpr("id AS doc_id", "CASE WHEN id IN (0, 2199999) THEN 'alpha beta gamma' END AS text")
    assert sorted(r.doc_id for r in dc.matches(dc.build_index(docs), dc.windows(items)).collect()) == [0, 2_199_999]


def test_clashing_names_in_the_stages(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma", "x", 1), (2, "delta", "y", 2), (None, "eps", "z", 3)], "doc_id long, text string, gone string, __gone int")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    kept = dc.uncontaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == ["delta", "eps"]


def test_lines_of_blocks(spark):
    """Every line of a block on many sites goes, also where the first document has no site; copies of a whole text are one text."""
    strip = "".join(map(chr, range(0x21)))
    docs = [(i, f"own {i} a\nhead\nmiddle\nfoot\nown {i} b", f"s{i}") for i in range(1, 13)]
    docs += [(20 + i, f"first\nsecond\nown {i} c", f"s{i}") for i in range(12)] + [(40 + i, f"own {i} d\nlast but one\nlast", f"s{i}") for i in range(12)]
    docs += [(0, "own e\nhead\nmiddle\nfoot", None)] + [(60 + i, "whole\ncopy", f"s{i}") for i in range(20)] + [(80 + i, f"nine {i}\nnine", f"s{i % 9}") for i in range(30)]
    docs += [(120, "unsited", None), *[(121 + i, f"x{i}\nunsited", f"s{i}" if i else None) for i in range(10)]]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    texts = {}
    for doc, t, site in docs:
        texts[t] = min(texts.get(t, (True, 2**64, "")), (site is None, doc, site or ""))
    sites = defaultdict(set)
    for t, (none, _, site) in texts.items():
        for x in t.split("\n"):
            sites[x.strip(strip)] |= set() if none else {site}
    keeper = {x: min(doc for doc, t, _ in docs if x in t.split("\n")) for x in sites}
    gone = {x for x in sites if len(sites[x]) >= 10}
    assert gone == {"head", "middle", "foot", "first", "second", "last but one", "last"}
    want = {doc: "\n".join(x for x in t.split("\n") if x not in gone or keeper[x] == doc) for doc, t, _ in docs}
    assert {r.doc_id: r.text for r in ld.clean(df).collect()} == want


def brute_windows(docs, n=50):
    words = [(doc, re.findall("[^\x20\x09-\x0d]+", t or "")) for doc, t in docs]
    first = {}
    for doc, w in words:
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            first[k] = min(first.get(k, 2**64), doc if doc is not None else 2**63)
    out = []
    for doc, w in words:
        gone = set()
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] < (doc if doc is not None else 2**63):
                gone.update(range(s, s + n))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=str)


@pytest.mark.parametrize("frequent", [20_000, 3])
def test_substrings(spark, frequent, monkeypatch):
    monkeypatch.setattr(ss, "FREQUENT", frequent)
    r = random.Random(4)
    say = lambda k, n=400: " ".join(str(r.randrange(n)) for _ in range(k))
    passage, other = say(60), say(75)
    docs = [(i, say(r.randint(0, 120))) for i in range(15)]
    docs += [(50 + i, f"{say(i)} {passage}\n{say(20 - i)}") for i in range(20)]
    docs += [(80 + i, f"{say(9)}  {other[: -i or None]}") for i in range(8)]
    docs += [(90, passage), (91, passage), (92, " ".join(passage.split()[:50])), (93, " ".join(passage.split()[:49])), (7, passage), (7, passage + " end"), (None, passage), (None, passage)]
    docs += [(100, "tick " * 300), (101, "tick " * 120), (102, "tick tock " * 100), (103, None), (104, ""), (105, " \t\n"), (106, "e" * 10_000), (107, say(3000, 100_000)), (108, "x " + docs[-1][1])]
    docs += [(200 + i, docs[3][1] + " " + say(60) + " same tail " * 30) for i in range(3)]
    df = spark.createDataFrame([(i, t, 5, "k") for i, t in docs], "doc_id long, text string, n_words int, row string").repartition(3)
    got = sorted((tuple(x) for x in ss.digest(ss.clean(df)).collect()), key=str)
    assert got == brute_windows(docs)
    assert ss.digest(ss.clean(df.limit(0))).count() == 0
    spans = {x.doc_id: x.spans for x in ss.clean(df).collect() if x.doc_id in (91, 93)}
    assert [(s["first"], s["n"]) for s in spans[91]] == [(0, 60)] and spans[93] == []
    with pytest.raises(ValueError, match="even"):
        ss.repeats(df, 51)
