"""Projection of records and claims to quads, and the claim view: one row per trusted claim.

A quad is ``g, s, p, o, o_type (iri or literal), o_datatype``. The claim view replaces the several graphs a
claim is projected to, so that a question about claims is one scan and not a join of their graphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions.terms import XSD, typed, valid_iri
from provenant.operators.scopes import positions
from provenant.operators.trust import verified
from provenant.session import cut

# Names of this vocabulary.
NS = "urn:prov:"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
USED = "http://www.w3.org/ns/prov#used"
GENERATED = "http://www.w3.org/ns/prov#wasGeneratedBy"
DERIVED = "http://www.w3.org/ns/prov#wasDerivedFrom"
ATTRIBUTED = "http://www.w3.org/ns/prov#wasAttributedTo"
CREATED = "http://purl.org/dc/terms/created"
UNSCOPED = "-"


def iri(kind: str, c) -> Column:
    return F.concat(F.lit(f"urn:{kind}:"), F.col(c) if isinstance(c, str) else c)


def _quad(g, s, p: str, o, literal: str | None = None) -> Column:
    return F.struct(
        g.alias("g"), s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"),
        F.lit("iri" if literal is None else "literal").alias("o_type"),
        F.lit(XSD + literal if literal else None).cast("string").alias("o_datatype"))


def _explode(df: DataFrame, quads: list[Column]) -> DataFrame:
    return df.select(F.explode(F.array_compact(F.array(*quads))).alias("q")).select("q.*").filter("o IS NOT NULL")


def project_work(work: DataFrame, work_file: DataFrame, signature: DataFrame, trust: DataFrame) -> DataFrame:
    """Quads of work records, each record its own graph; attributed to trusted keys only, untrusted records stay.

    Derivation is used ∘ generated and not stored per pair of files: see ``derived_from``.
    """
    rec = iri("work", "record_id")
    facts = _explode(work, [_quad(rec, rec, TYPE, F.lit(NS + "Work")), _quad(rec, rec, NS + "kind", F.col("kind"), "string"),
                            _quad(rec, rec, LABEL, F.col("cmd"), "string")])
    file = iri("file", "hash")
    files = _explode(work_file, [
        F.when(F.col("role") == "in", _quad(rec, rec, USED, file)),
        F.when(F.col("role") == "out", _quad(rec, file, GENERATED, rec)),
        _quad(rec, file, LABEL, F.col("path"), "string")])
    signers = _explode(verified(signature, trust), [_quad(rec, rec, ATTRIBUTED, iri("key", "keyid"))])
    return facts.unionByName(files.distinct()).unionByName(signers)


def derived_from(work_file: DataFrame, hashes: DataFrame) -> DataFrame:
    """``(hash, source)``: what the given files were directly derived from."""
    made = work_file.filter("role = 'out'").join(hashes, "hash", "left_semi").select("hash", "record_id").distinct()
    read = work_file.filter("role = 'in'").select("record_id", F.col("hash").alias("source"))
    return made.join(read, "record_id").select("hash", "source").distinct()


def project_claims(claims: DataFrame, trust: DataFrame) -> DataFrame:
    """Quads of claims: head, assertion, provenance, publication info and one attribution graph per key.

    Claims whose subject or id make no valid IRI are left out. Trust does not limit the projection: only
    the attribution graphs name keys, and which of them count is chosen when a question is asked.
    """
    c = iri("claim", "claim_id")
    graph = lambda part: F.concat(c, F.lit("#" + part))
    helper, subject = graph("o"), iri("file", "subject")
    head, assertion, prov, pub = graph("head"), graph("assertion"), graph("provenance"), graph("pubinfo")
    quads = [
        _quad(head, c, NS + "hasAssertion", assertion), _quad(head, c, NS + "hasProvenance", prov),
        _quad(head, c, NS + "hasPublicationInfo", pub), _quad(head, c, TYPE, F.lit(NS + "Nanopub")),
        F.struct(assertion.alias("g"), subject.alias("s"), iri("predicate", "predicate").alias("p"), helper.alias("o"),
                 F.lit("iri").alias("o_type"), F.lit(None).cast("string").alias("o_datatype")),
        _quad(assertion, helper, NS + "field:level", F.col("level"), "string"),
        _quad(assertion, helper, NS + "field:replaces", iri("claim", "replaces")),
        _quad(prov, assertion, ATTRIBUTED, iri("key", "keyid")),
        _quad(pub, c, CREATED, F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), "dateTime"),
        _quad(pub, c, NS + "scope", iri("claim", "scope")), _quad(pub, c, NS + "prev", iri("claim", "prev")),
        F.when(F.col("genesis"), _quad(pub, c, NS + "genesis", F.lit("true"), "boolean")),
        _quad(F.concat(F.lit("urn:attribution:"), "claim_id", F.lit("/"), "keyid"), c, ATTRIBUTED, iri("key", "keyid")),
    ]
    return _explode(claims.filter(valid_iri(c) & valid_iri(subject)), quads)


def trusted_only(claims: DataFrame, trust: DataFrame) -> DataFrame:
    return claims.join(trust.select("keyid"), "keyid", "left_semi")


def claim_nodes(quads: DataFrame, trust: DataFrame) -> DataFrame:
    """Claims put together again from their quads: signers, subjects, predicate, created, genesis, scope, prev."""
    claim = F.regexp_extract("g", r"^urn:(?:claim|attribution):([^#/]+)", 1)
    attribution = F.col("g").startswith("urn:attribution:")
    key = F.regexp_extract("o", r"^urn:key:(.*)$", 1)
    known = trust.select(F.col("keyid").alias("__key"), F.lit(True).alias("trusted"))
    rows = (quads.withColumn("claim_id", claim).filter("claim_id <> ''").withColumn("__key", F.when(attribution, key))
            .join(known, "__key", "left"))
    pred, about = F.col("p").startswith("urn:predicate:"), F.col("g").endswith("#assertion")
    value = lambda p: F.max(F.when(F.col("p") == p, F.col("o")))
    strip = lambda c: F.regexp_replace(c, "^urn:claim:", "")
    return rows.groupBy("claim_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("trusted"), F.col("__key")))).alias("signers"),
        F.array_sort(F.collect_set(F.when(pred & about, F.regexp_replace("s", "^urn:file:", "")))).alias("about"),
        F.max(F.when(pred, F.regexp_replace("p", "^urn:predicate:", ""))).alias("predicate"),
        value(CREATED).alias("created"), strip(value(NS + "scope")).alias("scope"), strip(value(NS + "prev")).alias("prev"),
        F.coalesce(value(NS + "genesis") == "true", F.lit(False)).alias("genesis"),
        F.array_sort(F.collect_set(F.when(F.col("p") == NS + "field:replaces", F.lower(strip(F.col("o")))))).alias("replaces"),
    ).filter(F.size("signers") > 0)


def replaced_by(nodes: DataFrame) -> DataFrame:
    """``(claim_id, replaced_by)``: r retires x when it names x, has the same predicate, shares a subject and
    carries every trusted signer of x. The join follows the names, so it is as large as they are."""
    names = nodes.select(F.col("claim_id").alias("r_id"), F.explode("replaces").alias("claim_id"), F.col("predicate").alias("r_pred"),
                         F.col("signers").alias("r_signers"), F.col("about").alias("r_about")).filter("r_id <> claim_id")
    return nodes.join(names, "claim_id").filter(
        (F.col("predicate") == F.col("r_pred")) & (F.size(F.array_except("signers", "r_signers")) == 0)
        & F.arrays_overlap("about", "r_about")).select("claim_id", F.col("r_id").alias("replaced_by")).distinct()


def claim_view(claims: DataFrame, nodes: DataFrame, templates: DataFrame) -> DataFrame:
    """One row per trusted claim with position, template, graph and whether it is replaced.

    ``claims`` is the untrusted superset the chains run through; ``nodes`` are the trusted claims.
    """
    gone = replaced_by(nodes).groupBy("claim_id").agg(F.count(F.lit(1)).alias("replacements"))
    return (nodes.join(positions(claims), "claim_id", "left").join(gone, "claim_id", "left")
            .join(templates.select("predicate", F.col("name").alias("template"), F.col("is_rows").alias("row")), "predicate", "left")
            .select("claim_id", "signers", "about", "predicate", "template", "row", "created", "scope", "prev", "genesis", "position",
                    "replaces", F.col("replacements").isNotNull().alias("replaced"), graph_of().alias("graph")))


def graph_of() -> Column:
    """The graph a claim belongs to: its scope, a seed's own id, else the unscoped graph."""
    return F.coalesce("scope", F.when(F.col("genesis"), F.col("claim_id")), F.lit(UNSCOPED))


def aliased(fields: DataFrame, templates: DataFrame, aliases: DataFrame) -> DataFrame:
    """Field keys as IRIs: the package's alias, else the repository's, else the field's own name.

    ``fields`` has (claim_id, predicate, key, value); ``aliases`` (owner, key, iri) with owner a template name
    or ``*`` for the repository. Claims of an unknown template get no aliases; reserved terms are never taken.
    """
    own = aliases.filter("owner <> '*'").select(F.col("owner").alias("template"), "key", F.col("iri").alias("pkg"))
    common = aliases.filter("owner = '*'").select("key", F.col("iri").alias("repo"))
    named = fields.join(templates.select("predicate", F.col("name").alias("template")), "predicate", "left")
    known = F.col("template").isNotNull()
    chosen = F.when(known & ~F.coalesce(reserved("pkg"), F.lit(False)), F.col("pkg"))
    other = F.when(known & ~F.coalesce(reserved("repo"), F.lit(False)), F.col("repo"))
    return named.join(own, ["template", "key"], "left").join(common, "key", "left").select(
        "claim_id", "template", "key", F.coalesce(chosen, other, F.concat(F.lit(NS + "field:"), "key")).alias("iri"), "value")


def reserved(c) -> Column:
    """An IRI of the view's namespace that is not a field term."""
    c = F.col(c) if isinstance(c, str) else c
    return c.startswith(NS) & ~c.startswith(NS + "field:")


def expand(curie, prefixes: DataFrame, df: DataFrame, name: str) -> DataFrame:
    """CURIEs with a known prefix as IRIs, others unchanged."""
    c = F.col(curie)
    pre = prefixes.select(F.col("prefix").alias("__p"), F.col("iri").alias("__i"))
    return df.withColumn("__p", F.substring_index(c, ":", 1)).join(pre, "__p", "left").withColumn(
        name, F.when(F.col("__i").isNotNull() & c.contains(":"), F.concat("__i", F.substring(c, F.length("__p") + 2, F.lit(1 << 30))))
        .otherwise(c)).drop("__p", "__i")


def typed_fields(fields: DataFrame, types: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """Fields with the type their template declares: ``types`` has (template, key, type), ``prefixes`` (prefix, iri)."""
    named = fields.withColumn("__r", F.col("value")) if prefixes is None else expand("value", prefixes, fields, "__r")
    return named.join(types, ["template", "key"], "left").withColumn("term", typed("type", "value", "__r", reserved)).select(
        "claim_id", "key", F.col("term.type").alias("term_type"), F.col("term.value").alias("value"), F.col("term.datatype").alias("datatype"))


def nested_fields(objects: DataFrame) -> DataFrame:
    """JSON objects as rows ``(claim_id, path, key, value)``, one per scalar, to any depth.

    An object whose only key is ``hash`` stands for what it names. The elements of a list are opened as well: its
    objects have the list's key and their place as a part of the path, its scalars are a row each. A layer is opened
    per round, until none is left.
    """
    fields = lambda c: F.explode(F.from_json(c, "map<string,string>")).alias("key", "value")
    items, out = objects.select("claim_id", F.lit("").alias("path"), fields("object")), None
    single, listed = F.from_json("value", "map<string,string>"), F.from_json("value", "array<string>")
    is_object, is_list = (F.coalesce(F.col("value").rlike(form) & read.isNotNull(), F.lit(False)) for form, read in ((r"^\s*\{", single), (r"^\s*\[", listed)))
    names = F.coalesce((F.size(single) == 1) & single["hash"].isNotNull(), F.lit(False))
    inside = lambda v: F.coalesce(v.rlike(r"^\s*[\[{]"), F.lit(False))
    place = lambda i: F.concat("key", F.lit("["), i.cast("string"), F.lit("]"))
    elements = F.transform(listed, lambda v, i: F.struct(F.when(inside(v), place(i)).otherwise(F.col("key")).alias("key"), v.alias("value")))
    while True:
        items = cut(items)
        opened = is_object & ~names | is_list
        plain = items.filter(~opened).select("claim_id", "path", "key", F.when(is_object, single["hash"]).otherwise(F.col("value")).alias("value"))
        out = plain if out is None else out.unionByName(plain)
        if items.filter(opened).isEmpty():
            return out
        deeper = items.filter(is_object & ~names).select("claim_id", F.concat("path", "key", F.lit("/")).alias("path"), fields("value"))
        items = deeper.unionByName(items.filter(is_list).select("claim_id", "path", F.explode(elements).alias("e")).select("claim_id", "path", "e.*"))


def signer_labels(nodes: DataFrame, trust: DataFrame) -> DataFrame:
    """Name and tier of every signer that occurs."""
    return nodes.select(F.explode("signers").alias("keyid")).distinct().join(trust, "keyid").select("keyid", "name", "tier")


def scope_graphs(view: DataFrame, sources: DataFrame, labels: DataFrame) -> DataFrame:
    """Per graph: claims besides the seed, its label, the sources that hold its claims, whether it is the unscoped one."""
    held = view.select("claim_id", "graph").join(sources, "claim_id", "left").select("graph", F.explode_outer("sources").alias("source")).distinct()
    where = held.groupBy("graph").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    counts = view.groupBy("graph").agg((F.count(F.lit(1)) - F.count_if("genesis")).alias("claims"))
    return counts.join(where, "graph", "left").join(labels, "graph", "left").withColumn("unscoped", F.col("graph") == UNSCOPED)


def repeated_labels(graphs: DataFrame) -> DataFrame:
    return graphs.filter("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("graphs")).filter("graphs > 1")


def dataset(holds: DataFrame, attests: DataFrame, trust: DataFrame) -> DataFrame:
    """Records with the trusted keys that attest them in a registry that holds them.

    ``holds`` has (registry, record_id), ``attests`` (registry, record_id, keyid); a record nobody trusted
    attests stays, with no keys.
    """
    counted = (attests.join(trust.select("keyid"), "keyid", "left_semi")
               .join(holds, ["registry", "record_id"], "left_semi").select("record_id", "keyid").distinct())
    return holds.select("record_id").distinct().join(counted, "record_id", "left").groupBy("record_id").agg(
        F.array_sort(F.collect_set("keyid")).alias("keyids"))
