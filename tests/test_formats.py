import base64
import json

import pytest
from pyspark.sql import functions as F

from provenant.functions import paths as P
from provenant.functions import terms as N
from provenant.operators import calls as CA
from provenant.operators import compare as C
from provenant.operators import questions as Q
from provenant.operators import trust as T
from provenant.sources import quads, registries, results, store, tracelog


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_unescape_and_fields(spark):
    df = spark.createDataFrame([(r"a\\tb\tc\n\q\r" + "\\",)], "c string")
    assert df.select(tracelog.unescape(F.col("c")).alias("x")).first()["x"] == "a\\tb\tc\n\\q\r\\"
    assert one(spark, N.field_of(F.lit("sha256=a;new=1;sha256=b"), "sha256")) == "a"
    assert one(spark, N.field_of(F.lit("renew=1"), "new")) == ""


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    f = tmp_path / "big.log"
    f.write_text("".join(f"{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = [int(r["value"]) for r in tracelog.numbered_lines(spark, str(f)).orderBy("ord").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(range(5000))


def test_short_lines_and_v1(spark, tmp_path):
    f = tmp_path / "old.log"
    f.write_text("#xtrace v1\thash=/p\n1\t2\t3\topen\tr\t/p/a\\tb\t0\t0\t18446744073709551615\ta\tb\nshort\tline\n")
    rows = tracelog.read_traces(spark, str(f)).collect()
    assert [(r["path"], r["extra"], int(r["ino"])) for r in rows] == [("/p/a\\tb", "a\tb", 18446744073709551615)]


def test_origins_of_both_shapes(spark, tmp_path):
    f = tmp_path / "o.jsonl"
    loc = lambda a, b: {"codeLocation": {"uri": {"path": "/p/x.R"}, "range": {"start": {"line": a, "character": 0}, "end": {"line": b, "character": 0}}}}
    lines = [{"ts_ns": 5, "kind": "c", "file": "/f.R", "start_line": 2, "end_line": 3, "code": "x", "language": "R"},
             {"ts": 7, "event": "e", "payload": {"code": "y", "languageId": "python", "attribution": {"source": "s", "metadata": loc(4, 6)}}},
             {"ts": 8, "event": "e", "payload": {"code": "z", "attribution": {"source": "s", "metadata": loc(0, 0)}}},
             {"ts": 9, "event": "e", "payload": {"code": "q", "languageId": "sql"}}]
    f.write_text("\n".join(map(json.dumps, lines)))
    got = tracelog.read_origins(spark, str(f)).orderBy("ts").collect()
    assert [(r["ts"], r["start_line"], r["end_line"], r["language"]) for r in got] == [(5, 2, 3, "r"), (7000000, 5, 7, "python"), (8000000, None, None, "r")]


def envelope(statement):
    return {"payload": base64.b64encode(json.dumps(statement).encode()).decode(), "payloadType": "t", "signatures": [{"keyid": "k1", "sig": "s"}, {"keyid": "k2", "sig": "s"}]}


def claim(subject, **p):
    return envelope({"subject": subject, "predicateType": "pt", "predicate": {"predicate": {"uri": "urn:p"}, **p}})


def test_records_and_claims(spark, tmp_path):
    (tmp_path / "works.jsonl").write_text(json.dumps({"seq": 1, "recordId": "w1", "envelope": envelope({})}) + "\n")
    rows = [{"seq": 1, "claimId": "c1", "envelope": claim([{"digest": {"sha256": "ab"}}, {"uri": "urn:x"}], object={"level": "L1", "n": 3}, when="2024-01-02T03:04:05Z", scope="c1", genesis=True, name="area")},
            {"seq": 2, "claimId": "c2", "envelope": claim([{"uri": "urn:y"}], object="yes", scope="c1", prev="c1")}]
    (tmp_path / "claims.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    rec = registries.federation(spark, registries.places("directory", str(tmp_path)), {"partner": registries.places("directory", str(tmp_path))})
    assert rec.count() == 6 and registries.signatures(rec.filter("registry = 'own'")).filter("record_id = 'c1'").count() == 2
    c = registries.claims(rec.filter("registry = 'own'")).orderBy("seq").select("claim_id", "subjects", "subject", "genesis", "prev", F.try_variant_get("object", "$.level", "string").alias("level"), F.date_format("at", "HH:mm").alias("t")).collect()
    assert c[0]["subjects"] == ["sha256:ab", "urn:x"] and c[0]["level"] == "L1" and c[0]["genesis"] and c[0]["t"] == "03:04"
    assert c[1]["subject"] == "urn:y" and c[1]["level"] is None and c[1]["prev"] == "c1"
    with pytest.raises(ValueError):
        registries.federation(spark, registries.places("directory", str(tmp_path)), {"none": None})
    (tmp_path / "claims.jsonl").write_text(json.dumps({"seq": 1, "claimId": "bad"}) + "\n")
    with pytest.raises(Exception):
        registries.read_records(spark, *registries.places("directory", str(tmp_path))).collect()
    torn = tmp_path / "scope.jsonl"
    torn.write_text("\n".join([json.dumps(rows[0]), '{"torn', json.dumps({"seq": 9}), json.dumps(rows[1])]))
    assert [r["record_id"] for r in registries.read_scope_file(spark, str(torn)).orderBy("seq").collect()] == ["c1", "c2"]


def test_batches_are_checked_whole(spark, tmp_path):
    f = tmp_path / "b.jsonl"
    f.write_text('{"subject":"s","template":"t","fields":{"a":"1"}}\n{"subject":"","template":"t","fields":{"a":"1"}}\n{"subject":"s","template":"t","fields":{}}\n{"subject":"s","template":"u"}\n')
    tpl = spark.createDataFrame([("t", ["a"])], "name string, required array<string>")
    assert sorted(r["error"] for r in registries.batch_errors(registries.read_batch(spark, str(f)), tpl).collect()) == ["missing fields a", "no subject", "unknown template"]
    with pytest.raises(ValueError):
        registries.read_batch(spark, str(f), most=3)


def test_quads_there_and_back(spark, tmp_path):
    f = tmp_path / "g.nq"
    f.write_text('<urn:a> <urn:p> "x \\"q\\" \\\\n\\n\\u00e9"@en <urn:g> .\n# note\n\n_:b1 <urn:p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .\n<urn:a> <urn:p> "s"^^<http://www.w3.org/2001/XMLSchema#string> . # c\n<urn:a> <urn:q> _:b1 <urn:g> .\n')
    q = quads.read_quads(spark, str(f))
    rows = {(r["s"], r["p"], r["o"], r["o_type"], r["o_datatype"], r["o_lang"], r["g"]) for r in q.collect()}
    assert rows == {("urn:a", "urn:p", 'x "q" \\n\né', "literal", None, "en", "urn:g"), ("b1", "urn:p", "5", "literal", N.XSD + "integer", None, None),
                    ("urn:a", "urn:p", "s", "literal", None, None, None), ("urn:a", "urn:q", "b1", "bnode", None, None, "urn:g")}
    quads.write_quads(q, str(tmp_path / "out"))
    again = quads.read_quads(spark, str(tmp_path / "out"))
    assert rows == {(r["s"], r["p"], r["o"], r["o_type"], r["o_datatype"], r["o_lang"], r["g"]) for r in again.collect()}
    (tmp_path / "bad.nt").write_text('<urn:a> <urn:p> "bare " quote" .\n')
    with pytest.raises(Exception):
        quads.read_quads(spark, str(tmp_path / "bad.nt")).collect()


def test_long_literals_do_not_recurse(spark):
    text = 'ab\\n\\"' * 60_000
    line = spark.createDataFrame([("f", 0, f'<urn:a> <urn:p> "{text}" .')], "file string, ord bigint, value string")
    assert quads.parse_quads(line).select(F.length("o")).first()[0] == 4 * 60_000


def test_loading_graphs(spark, tmp_path):
    files = spark.createDataFrame([("f1", "aa", 10), ("f2", "bb", 10)], "file string, sha string, size bigint")
    st = spark.createDataFrame([("f1", None, "s", "p", "o"), ("f2", None, "s", "p", "o"), ("f2", None, "s", "p", "o2")], "file string, g string, s string, p string, o string")
    none = spark.createDataFrame([], "repo string, sha string, graph string, file string, triples bigint")
    ids = spark.createDataFrame([("sha256:cc",)], "record_id string")
    cat = quads.load_graphs(files, st, ids, none, "r1", 10, 100)
    assert sorted((r["sha"], r["triples"]) for r in cat.collect()) == [("aa", 1), ("bb", 2)]
    for kw in ({"most_triples": 2, "most_bytes": 100}, {"most_triples": 10, "most_bytes": 5}):
        with pytest.raises(ValueError):
            quads.load_graphs(files, st, ids, none, "r1", **kw)
    with pytest.raises(ValueError):
        quads.load_graphs(files, st, spark.createDataFrame([("sha256:aa",)], "record_id string"), none, "r1", 10, 100)
    quads.replace_graphs(st, cat, str(tmp_path / "loaded"))
    quads.replace_graphs(st, cat, str(tmp_path / "loaded"))
    assert quads.read_graphs(spark, str(tmp_path / "loaded")).count() == 3
    both = cat.unionByName(cat.filter("sha = 'aa'").withColumn("repo", F.lit("r2")))
    assert [r["graph"] for r in quads.droppable(both, "r1", cat.select("graph")).collect()] == ["urn:sha256:bb"]
    assert {r["repo"]: r["triples"] for r in quads.loaded_triples(both).collect()} == {"r1": 3, "r2": 1}


def test_many_graphs_in_few_files(spark, tmp_path):
    path, n = str(tmp_path / "loaded"), 3000
    graphs = spark.range(n).selectExpr("'f' || id AS file", "'urn:sha256:' || id AS graph")
    of = lambda times: spark.range(n).selectExpr("'f' || id AS file", "cast(NULL AS string) AS g", "id AS s", f"explode(sequence(1, cast(1 + id % {times} AS int))) AS o").selectExpr("file", "g", "cast(s AS string) AS s", "'p' AS p", "cast(o AS string) AS o")
    files = lambda: sorted(str(p) for p in (tmp_path / "loaded").rglob("*.parquet"))
    quads.replace_graphs(of(3), graphs, path, 8)
    assert len(files()) == 8
    before = files()
    one = graphs.where("graph = 'urn:sha256:7'")
    quads.replace_graphs(of(9), one, path, 8)
    assert len(files()) == 8 and len(set(files()) & set(before)) == 7
    quads.drop_graphs(graphs.where("graph LIKE '%5'"), path, 8)
    want = {f"urn:sha256:{i}": 8 if i == 7 else 1 + i % 3 for i in range(n) if i % 10 != 5}
    assert {r["g"]: r["triples"] for r in quads.graph_statistics(quads.read_graphs(spark, path)).collect()} == want
    assert {r["g"] for r in quads.read_graphs(spark, path, ["urn:sha256:7", "urn:sha256:5"], 8).collect()} == {"urn:sha256:7"}
    quads.drop_graphs(graphs, path, 8)
    assert quads.read_graphs(spark, path).count() == 0 and len(files()) == 8


def test_results_documents(spark, tmp_path):
    doc = {"head": {"vars": ["a", "b"]}, "results": {"bindings": [{"a": {"type": "uri", "value": "u"}}, {"a": {"type": "literal", "value": "1", "datatype": "d"}, "b": {"type": "literal", "value": "x", "xml:lang": "en"}}]}}
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=1))
    r = results.read_results(spark, str(tmp_path / "r.json"))
    assert sorted((x["a"], x["b"] or "") for x in results.values(r, ["a", "b"]).collect()) == [("1", "x"), ("u", "")]
    (tmp_path / "r.csv").write_text('"",n\np1,5\n')
    assert [tuple(x) for x in results.read_csv(spark, str(tmp_path / "r.csv")).collect()] == [("p1", "5")]


def test_versioned_table_switches_whole(spark, tmp_path):
    v = store.VersionedTable(spark, str(tmp_path / "view"))
    assert v.refresh(lambda: spark.range(3), "a") and v.read().count() == 3
    assert not v.refresh(lambda: spark.range(9), "a") and v.read().count() == 3
    assert v.refresh(lambda: spark.range(5), "b") and v.read().count() == 5


def test_manifest_and_pending(spark, tmp_path):
    d = tmp_path / "files"
    d.mkdir()
    (d / "x").write_text("x")
    m = store.read_manifest(spark, str(d))
    sha = m.first()["sha"]
    ops = spark.createDataFrame([("/p/a", sha), ("/p/b", "new"), ("/p/c", "new"), ("/p/d", None)], "path string, sha string")
    assert [tuple(r) for r in store.pending(ops, ops.limit(0), m).collect()] == [("new", "/p/b")]
    assert store.intact(m).count() == 0


def test_reports_take_same_from_hashes(spark, tmp_path):
    rep = {"project": "p", "target": "t", "recorded": "a", "reproduced": "b", "same": True, "when": "2024", "steps": [{"session": "s", "task": "1", "outputs": [{"path": "/x", "recorded": "a", "reproduced": "a", "same": False}]}]}
    (tmp_path / "r.json").write_text(json.dumps(rep))
    r = store.read_reproductions(spark, str(tmp_path / "*.json"), "p")
    assert r.first()["same"] is False and store.report_rows(r).first()["same"] is True


def test_paths(spark):
    cls = lambda p: one(spark, P.path_class(F.lit(p), F.lit("/p"), home="/h"))
    assert [cls(x) for x in ("/p/a", "/p/.git/x", "/p/.Rprofile", "/tmp/Rtmpx/y", "/usr/lib/z", "/h/.cache/q", "/etc/x", "/x/site-packages/y", "/pq/a", "/usr/lib/os-release")] == [
        "project", "env", "env", "temp", "env", "env", "system", "env", "outside", "env"]
    assert one(spark, P.relative(F.lit("/a/b/c"), F.lit("/a/x/y"))) == "../../x/y" and one(spark, P.relative(F.lit("/a"), F.lit("/a/b"))) == "b"
    assert one(spark, P.clean(F.lit("/a/./b/../c//d"))) == "/a/c/d"
    assert one(spark, P.words(F.lit("a 'b c' \"d e\" f\\ g 'it'\\''s' x=\\'y 'no end "))) == ["a", "b c", '"d', 'e"', "f\\", "g", "it's", "x='y", "no end "]
    assert one(spark, P.program_name(F.lit(None).cast("string"), F.lit("/usr/bin/python3 -c pass x.py"))) == "python3"


def calls_fixture(spark):
    cmd = [("s", 0, 1, 10, 1, "nmfe75 run1.mod run1.lst", "/p/m"), ("s", 0, 2, 20, 10, "/bin/sh -c x", "/p/m"), ("s", 0, 3, 30, 20, "Rscript plot.R", "/p/m")]
    c = spark.createDataFrame(cmd, "session string, task_no bigint, ord bigint, pid bigint, ppid bigint, cmdline string, cwd string")
    ops = [(1, 10, "r", "/p/d.csv", "d", False), (2, 10, "w", "/p/m/run1.lst", None, False), (3, 10, "c", "/p/m/run1.lst", "l", False), (4, 30, "r", "/p/m/run1.lst", "l", False),
           (5, 30, "w", "/p/m/plot.png", None, False), (6, 30, "c", "/p/m/plot.png", "g", False), (7, 20, "m", "/p/m/opt.cfg", None, False), (8, 30, "r", "/x/lib.dat", "o", True),
           (9, 10, "w", "/p/m/tmpf", None, False), (10, 10, "c", "/p/m/tmpf", "t", False), (11, 10, "d", "/p/m/tmpf", None, False), (12, 10, "c", "/p/m/redirect", "z", False)]
    o = spark.createDataFrame([("s", 0, a, p, x, f, h, out) for a, p, x, f, h, out in ops], "session string, task_no bigint, at bigint, pid bigint, op string, path string, sha string, outside boolean")
    return c, o


def test_calls_and_keys(spark):
    c, o = calls_fixture(spark)
    calls = CA.tool_calls(c, ["nmfe75", "Rscript"])
    trees = CA.subtrees(calls, CA.process_edges(c))
    assert sorted((r["pid"], r["parent"]) for r in CA.enclosing(calls, trees).collect()) == [(10, None), (30, 10)]
    files = CA.call_files(calls, trees, o)
    got = sorted((r["call"].split("\u0001")[2], r["role"], r["rel"], r["sha"]) for r in files.collect())
    assert got == [("10", "missing", "opt.cfg", ""), ("10", "outside", "../../x/lib.dat", "o"), ("10", "read", "../d.csv", "d"), ("10", "write", "plot.png", "g"), ("10", "write", "run1.lst", "l"),
                   ("30", "outside", "../../x/lib.dat", "o"), ("30", "read", "run1.lst", "l"), ("30", "write", "plot.png", "g")]
    keys = {r["pid"]: r["key"] for r in CA.call_keys(calls, files).collect()}
    import hashlib
    ref = hashlib.sha256(b'{"argv":["nmfe75","run1.mod","run1.lst"]}').hexdigest()
    want = hashlib.sha256(('{"inputs":{"../d.csv":"d"},"protocol":{"kind":"cmd","ref":"sha256:' + ref + '"}}').encode()).hexdigest()
    assert keys[10] == "sha256:" + want
    now = spark.createDataFrame([("/x/lib.dat", "o"), ("/p/m/opt.cfg", "c")], "path string, sha string")
    assert [(r["code"], r["path"]) for r in CA.reuse_blocked(files, now).collect()] == [("appeared", "/p/m/opt.cfg")]


def test_control_files_and_cycles(spark):
    ctl = spark.createDataFrame([("/m/run1.mod", "$PROB x\n$DATA ../d.csv IGNORE=@\n$INCLUDE a.inc\n"), ("/m/a.inc", "$MSFI m.msf\n")], "path string, text string")
    roots = ctl.select("path").filter("path LIKE '%mod'")
    got = sorted((r["kind"], r["path"]) for r in CA.control_files(ctl, roots).collect())
    assert got == [("DATA", "/m/../d.csv"), ("INCLUDE", "/m/a.inc"), ("MSFI", "/m/m.msf")]
    loop = spark.createDataFrame([("/m/a", "$INCLUDE b\n"), ("/m/b", "$INCLUDE a\n")], "path string, text string")
    with pytest.raises(ValueError):
        CA.control_files(loop, loop.select("path"))


def test_compare_files(spark):
    rows = []
    for pair, a, b in [("same", "x 1", "x 1"), ("within", "a 1.000 2\n", "a 1.0001 2\n"), ("far", "1.0", "2.0"), ("word", "a 1", "b 1"), ("lines", "1\n2", "1"), ("fortran", "1.0D+02", "100.0"), ("bin", "a\0", "b\0")]:
        rows += [(pair, "a", a, a), (pair, "b", b, b)]
    got = {r["pair"]: r["verdict"] for r in C.compare_files(spark.createDataFrame(rows, "pair string, side string, text string, sha string"), 1e-3).collect()}
    assert got == {"same": "same", "within": "within", "far": "different", "word": "different", "lines": "different", "fortran": "within", "bin": "different"}


def test_what_is_excluded_shows_no_content(spark):
    rec = spark.createDataFrame([("a", "asia", "secret a"), ("b", None, "secret b"), ("c", "europe", "secret c")], "record_id string, tier string, cmd string")
    keep, idle = T.work_keeps(tier="asia", level="L1")
    got = {r["record_id"]: (r["included"], r["cmd"]) for r in T.split(rec, keep, ["cmd"]).collect()}
    assert got == {"a": (True, "secret a"), "b": (False, None), "c": (False, None)} and idle == ["level"]
    with pytest.raises(ValueError):
        T.check_filter(rec.select(F.col("record_id").alias("keyid"), "tier"), level="L7")
    with pytest.raises(ValueError):
        T.check_trust(rec.select(F.col("record_id").alias("keyid"), "tier"))


def test_pairs_of_signers_without_pairs(spark):
    import itertools
    import random
    r = random.Random(2)
    rows = [(f"h{h}", "p", f"s{r.randrange(3)}", f"k{r.randrange(3)}") for h in range(120) for _ in range(r.randrange(1, 4))]
    df = spark.createDataFrame(rows, "hash string, path string, record_id string, keyid string")
    wf = df.select("hash", "path", "record_id", F.lit("out").alias("role")).distinct()
    # One signer per step and file, so that the plain pair form can be written down.
    att = spark.createDataFrame(sorted({(s, k) for _, _, s, k in rows}), "record_id string, keyid string")
    signers = {}
    for s, k in {(s, k) for _, _, s, k in rows}:
        signers.setdefault(s, set()).add(k)
    want = {h for h in {x[0] for x in rows} for a, b in itertools.permutations({x[2] for x in rows if x[0] == h}, 2) if any(i != j for i in signers[a] for j in signers[b])}
    assert {x["hash"] for x in Q.files_of_several(wf, att).collect()} == want


def test_result_hash_is_of_the_multiset(spark):
    h = lambda rows: tuple(Q.result_hash(spark.createDataFrame(rows, "a string, b bigint")).first())
    assert h([("x", 1), ("y", None)]) == h([("y", None), ("x", 1)])
    assert h([("x", 1), ("x", 1)]) != h([("x", 1)]) != h([("x", 2)])


def test_typed_terms(spark):
    t = lambda k, v: one(spark, N.typed(F.lit(k), F.lit(v)))
    assert t("date", "2024-13-30").datatype.endswith("#date") and t("date", "2024-2-29").datatype is None
    assert tuple(t("ref", "sha256:AB12")) == ("iri", "urn:sha256:ab12", None) and t("ref", "urn:person:1").type == "literal"
    assert t("enum", "urn:x:1").type == "literal" and t("enum", "approve").type == "literal" and t("iri", "https://x/{y}").type == "literal"
    assert one(spark, N.typed(F.lit("enum"), F.lit("v:ok"), F.lit("https://v/ok"))).value == "https://v/ok"
    assert one(spark, N.reads_as("double", F.lit("-INF"))) and not one(spark, N.reads_as("double", F.lit("+INF")))
    assert t("integer", "+5").datatype.endswith("#integer") and t("integer", "5.0").datatype is None
    assert t("iri", "urn:x").type == "iri" and t("ref", "plain").type == "literal" and t("enum", "https://x/y").type == "iri"
    assert one(spark, N.reads_as("double", F.lit("-1.5e3"))) and not one(spark, N.reads_as("boolean", F.lit("yes")))


def test_common_base_of_a_call(spark):
    calls = spark.createDataFrame([("x", "/a/b", ["t"]), ("y", "/a/b/c", ["t", "../../z"]), ("z", "/a/b", ["t"])], "call string, cwd string, argv array<string>")
    ins = spark.createDataFrame([("x", "/a/b-x/f"), ("x", "/a/b/c/g"), ("y", "/a/b/c/f"), ("z", "/a/b/c/d/f")], "call string, path string")
    assert {r["call"]: r["base"] for r in CA.common_base(calls, ins).collect()} == {"x": "/a", "y": "/a", "z": "/a/b"}
