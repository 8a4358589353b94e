from pyspark.sql import functions as F

from provenant.operators import scopes as S
from provenant.operators import view as V

CLAIM = "claim_id string, scope string, prev string, genesis boolean, keyid string, seq bigint"


def claims(spark, rows):
    return spark.createDataFrame(rows, CLAIM)


def trust(spark):
    return spark.createDataFrame([("k1", "t1", "One"), ("k2", "t2", "Two")], "keyid string, tier string, name string")


def chains(spark):
    return claims(spark, [
        ("w", "w", None, True, "k1", 0), ("w1", "w", "w", False, "k1", 1), ("w2", "w", "w1", False, "x", 2),
        ("b", "b", None, True, "k1", 0), ("b1", "b", "b", False, "k1", 1), ("b2", "b", "b", False, "k1", 2),
        ("g", "g", None, True, "x", 0), ("g2", "g", "g1", False, "k1", 2), ("g3", "g", "g2", False, "k1", 3),
        ("m", "m", None, True, "k1", 0), ("m1", "m", "m", False, "k1", 1), ("m2", "m", "m", False, "k1", 2), ("m9", "m", "lost", False, "k1", 3),
        ("n1", "n", None, False, "k1", 1)])


def test_seal_says_whole_branch_gap_or_both(spark):
    got = {r["scope"]: (r["complete"], r["reason"], r["heads"], r["unresolved"], r["seed_tier"], r["seq"]) for r in S.seal(chains(spark), trust(spark), ["seq"]).collect()}
    assert got == {"w": (True, None, 1, 0, "t1", 0), "b": (False, "branch", 2, 0, "t1", 0), "g": (False, "gap", 1, 2, None, None),
                   "m": (False, "both", 2, 1, "t1", 0), "n": (False, "no-seed", 0, 1, None, None)}


def test_positions_count_untrusted_claims(spark):
    got = {r["claim_id"]: r["position"] for r in S.positions(chains(spark)).collect()}
    assert got["w2"] == 2 and got["g3"] is None and got["b2"] == 1 and got["n1"] is None


def test_writers_and_what_is_left_out(spark):
    got = {(r["writer"], r["claims"]) for r in S.writers(chains(spark), trust(spark)).filter("scope = 'w'").collect()}
    assert got == {("k1", 2), ("(unverified)", 1)}
    shown = {r["claim_id"]: r["seq"] for r in S.scope_answer(chains(spark), trust(spark), ["seq"]).filter("scope = 'w'").collect()}
    assert shown == {"w": 0, "w1": 1, "w2": None}


def test_ancestors_stop_at_untrusted_missing_and_repeats(spark):
    seed = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("c", "d", None), ("d", None, "t"), ("x", "gone", "t"), ("p", "q", "t"), ("q", "p", "t")], "scope string, parent string, tier string")
    got = {(r["scope"], r["ancestor"], r["state"]) for r in S.ancestors(seed.select("scope").filter("scope IN ('a', 'x', 'p')"), seed).collect()}
    assert got == {("a", "b", "ok"), ("a", "c", "untrusted"), ("x", "gone", "missing"), ("p", "q", "ok")}


def test_batches_follow_heads_and_each_other(spark):
    batch = spark.createDataFrame([("n1", "w", 1, "k1", "p", "s"), ("n2", "w", 2, "k1", "p", "s"), ("n3", "b", 3, "k1", "p", "s")],
                                  "claim_id string, scope string, ord bigint, keyid string, predicate string, subject string")
    stored = spark.createDataFrame([("k1", "p", "s", "old")], "keyid string, predicate string, subject string, claim_id string")
    got = {r["claim_id"]: (r["prev"], r["length"], r["replaces"]) for r in S.chain_batch(batch, S.append_points(chains(spark)), stored).collect()}
    assert got == {"n1": ("w2", 3, "old"), "n2": ("n1", 4, "n1"), "n3": ("b1", 2, "n2")}
    states = {r["claim_id"]: r["state"] for r in S.batch_states(batch, F.col("claim_id") == "n1").collect()}
    assert states == {"n1": "refused", "n2": "behind", "n3": "whole"}


def test_a_replacement_needs_every_signer_the_predicate_and_a_subject(spark):
    rows = [("x", ["k1", "k2"], ["s"], "p", []), ("one", ["k1"], ["s"], "p", ["x"]), ("both", ["k1", "k2"], ["s", "t"], "p", ["x", "both"]),
            ("other", ["k1", "k2"], ["s"], "q", ["x"]), ("apart", ["k1", "k2"], ["u"], "p", ["x", "nowhere"])]
    nodes = spark.createDataFrame(rows, "claim_id string, signers array<string>, about array<string>, predicate string, replaces array<string>")
    for seed in (1, 2):
        assert [tuple(r) for r in V.replaced_by(nodes.repartition(3).orderBy(F.rand(seed))).collect()] == [("x", "both")]


def test_claims_from_quads_and_bad_iris(spark):
    c = spark.createDataFrame([("c1", "s1", "p", "k1", "L1", None, "c1", None, True), ("c2", "s 2", "p", "k1", "L1", None, "c1", "c1", False), ("c3", "s3", "p", "x", "L1", "C1", "c1", "c1", False)],
                              "claim_id string, subject string, predicate string, keyid string, level string, replaces string, scope string, prev string, genesis boolean").withColumn("at", F.timestamp_seconds(F.lit(5)))
    n = V.claim_nodes(V.project_claims(c, trust(spark)), trust(spark)).collect()
    assert [(r["claim_id"], r["signers"], r["about"], r["genesis"]) for r in n] == [("c1", ["k1"], ["s1"], True)]


def test_nested_objects_end_at_scalars(spark):
    o = spark.createDataFrame([("c", '{"a":"1","ref":{"hash":"h"},"in":{"x":"2","deep":{"y":"3"}}}')], "claim_id string, object string")
    assert sorted((r["path"], r["key"], r["value"]) for r in V.nested_fields(o).collect()) == [("", "a", "1"), ("", "ref", "h"), ("in/", "x", "2"), ("in/deep/", "y", "3")]
