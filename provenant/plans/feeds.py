"""Queries over feeds, and readers of formats run over text made from the tables."""

from pyspark.sql import functions as F

from provenant.plans.registry import query
from provenant.plans.unions import CURSOR, HELD, cursor, held_claims
from provenant.operators.unions import after_cursor
from provenant.sources.quads import lines_of, parse_quads
from provenant.sources.results import bindings
from provenant.sources.tracelog import parse_lines, unescape
from provenant.streaming import feeds


def held(t):
    return held_claims(t).select("registry", "registry_ord", F.lit("claim").alias("layer"), F.lit(1).alias("epoch"), "seq", "record_id", "scope")


@query("feed_page", f"""WITH {HELD}, {CURSOR}, n AS (SELECT h.*, CASE registry WHEN 'own' THEN 0 ELSE 1 END AS ro FROM held h JOIN cur USING (registry) WHERE seq>cseq ORDER BY ro, seq LIMIT 500)
SELECT claim_id AS record_id, registry, keyid AS signers FROM n JOIN trust_key USING (keyid)""")
def _(t):
    signers = t.claim.join(t.trust_key, "keyid").select(F.col("claim_id").alias("record_id"), F.col("keyid").alias("signers"))
    return feeds.feed(held(t), cursor(t), signers, 500)[0].select("record_id", "registry", "signers")


@query("feed_present", f"WITH {HELD} SELECT registry, max(seq) AS seq FROM held GROUP BY registry")
def _(t):
    return feeds.present(held(t)).select("registry", "seq")


@query("change_events", f"""WITH {HELD}, {CURSOR}, n AS (SELECT * FROM held JOIN cur USING (registry) WHERE seq>cseq)
SELECT 'said' AS event, claim_id AS record_id, NULL AS source, NULL AS records FROM n WHERE registry='own' UNION ALL SELECT 'pulled', NULL, 'partner', count(*) FROM n WHERE registry='partner'""")
def _(t):
    return feeds.events(after_cursor(held(t), cursor(t)))


@query("view_changes", f"""WITH {HELD}, {CURSOR} SELECT DISTINCT CASE WHEN registry='own' THEN scope END AS scope FROM held JOIN cur USING (registry) WHERE seq>cseq""")
def _(t):
    return feeds.view_changes(after_cursor(held(t), cursor(t)))


@query("parsed_trace_lines", "SELECT session, ord, ts_ns, pid, op, mode, path, extra FROM trace_event")
def _(t):
    e = t.trace_event
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in ("ts_ns", "pid", "ppid", "op", "mode", "path", "size", "mtime_ns")], F.lit("7"), F.when(F.col("extra") == "", "-").otherwise(F.col("extra")))
    return parse_lines(e.select(F.col("session").alias("file"), "ord", line.alias("value"))).select("session", "ord", "ts_ns", "pid", "op", "mode", "path", "extra")


@query("unescaped_texts", "SELECT doc_id, sha256(text) AS h FROM documents")
def _(t):
    esc = F.col("text")
    for raw, e in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        esc = F.replace(esc, F.lit(raw), F.lit(e))
    return t.base("documents").select("doc_id", F.sha2(unescape(esc), 256).alias("h"))


@query("quads_round_trip", "SELECT 'urn:doc:'||doc_id AS s, 'urn:g:'||source AS g, sha256(text) AS h, lang AS o_lang FROM documents")
def _(t):
    d = t.base("documents")
    none = F.lit(None).cast("string")
    q = d.select(F.concat(F.lit("urn:g:"), "source").alias("g"), F.lit("iri").alias("s_type"), F.concat(F.lit("urn:doc:"), "doc_id").alias("s"), F.lit("urn:text").alias("p"),
                 F.lit("literal").alias("o_type"), F.col("text").alias("o"), none.alias("o_datatype"), F.col("lang").alias("o_lang"))
    text = lines_of(q).select(F.lit("mem").alias("file"), F.lit(0).alias("ord"), "value")
    return parse_quads(text).select("s", "g", F.sha2("o", 256).alias("h"), "o_lang")


@query("result_bindings", """SELECT '{"claim":{"type":"uri","value":"urn:claim:'||claim_id||'"},"position":{"type":"literal","value":"'||seq||'","datatype":"http://www.w3.org/2001/XMLSchema#integer"}}' AS value FROM claim""")
def _(t):
    a = t.claim.select(F.concat(F.lit("urn:claim:"), "claim_id").alias("claim"), F.col("seq").alias("position"), F.lit(None).cast("string").alias("unbound"))
    return bindings(a, {"claim": "uri"})
