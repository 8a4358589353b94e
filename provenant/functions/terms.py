"""Terms and values: IRIs, typed literals, canonical text, key=value fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prefixes of an absolute IRI and the lexical forms of typed fields.
IRI_FORM = r"^(https?://|urn:|tag:|did:|mailto:)\S+$"
INTEGER_FORM = r"^[+-]?\d+$"
NOT_IN_IRI = r"""[ <>"{}|^`\\]"""
DATE_FORM = r"^\d{4}-\d{2}-\d{2}$"
DATETIME_FORM = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"
XSD = "http://www.w3.org/2001/XMLSchema#"
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def valid_iri(c) -> Column:
    return F.coalesce(_c(c).rlike(IRI_FORM), F.lit(False))


def content_id(c) -> Column:
    """Any of ``urn:sha256:<hex>``, ``sha256:<hex>`` or hex as ``sha256:<hex>`` in lower case."""
    return F.concat(F.lit("sha256:"), bare(c))


def bare(c) -> Column:
    return F.lower(F.element_at(F.split(F.regexp_replace(_c(c), r"[/#]$", ""), "[:/#]"), -1))


def field_of(extra, key: str) -> Column:
    """First value of a ``;``-separated ``k=v`` field, else the empty string."""
    prefix = key + "="
    hit = F.filter(F.split(_c(extra), ";"), lambda x: x.startswith(prefix))
    return F.coalesce(F.substring(F.get(hit, 0), len(prefix) + 1, 1 << 30), F.lit(""))


def typed(kind, value, resolved=None, reserved=lambda c: F.lit(False)) -> Column:
    """(type, value, datatype) of a field value by its declared type; a misfit stays as it was signed.

    ``resolved`` is the value with its CURIE expanded, ``reserved`` says whether an IRI must not be taken. Dates go by
    their form. An enum is an IRI only if it resolves to one with ``://``, a ref only if it names content by hash.
    """
    kind, value = _c(kind), _c(value)
    resolved = value if resolved is None else F.coalesce(_c(resolved), value)
    usable = lambda c: ~c.rlike(NOT_IN_IRI) & ~F.coalesce(reserved(c), F.lit(False))
    named = F.when(resolved.contains("://"), resolved).otherwise(value)

    def term(kind_of_term: str, datatype: str | None, text: Column = value) -> Column:
        return F.struct(F.lit(kind_of_term).alias("type"), text.alias("value"), F.lit(datatype).cast("string").alias("datatype"))

    def lexical(form: str) -> Column:
        return value.rlike(form)

    return (
        F.when((kind == "date") & lexical(DATE_FORM), term("literal", XSD + "date"))
        .when((kind == "date") & lexical(DATETIME_FORM), term("literal", XSD + "dateTime"))
        .when((kind == "integer") & lexical(INTEGER_FORM), term("literal", XSD + "integer"))
        .when((kind == "enum") & value.contains(":") & resolved.contains("://") & usable(resolved), term("iri", None, resolved))
        .when((kind == "ref") & value.startswith("sha256:"), term("iri", None, F.concat(F.lit("urn:"), F.lower(value))))
        .when((kind == "iri") & named.rlike(IRI_FORM) & usable(named), term("iri", None, named))
        .otherwise(term("literal", None))
    )


# The lexical forms of bound literals.
LEXICAL_FORMS = {
    "string": r"(?s)^.*$",
    "integer": r"^[+-]?\d+$",
    "decimal": r"^[+-]?(\d+(\.\d*)?|\.\d+)$",
    "double": r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|-?INF|NaN)$",
    "boolean": r"^(true|false|1|0)$",
    "date": r"^-?\d{4,}-\d{2}-\d{2}(Z|[+-]\d{2}:\d{2})?$",
    "dateTime": r"^-?\d{4,}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$",
}


def reads_as(datatype: str, value) -> Column:
    """Whether a text is of the lexical form of an XSD datatype."""
    return _c(value).rlike(LEXICAL_FORMS[datatype])


def nt_quote(value) -> Column:
    """A literal's text with the escapes of the line format."""
    out = _c(value)
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


def nt_unquote(value) -> Column:
    """Undo ``nt_quote``: tokens first, so an escaped backslash never starts another escape."""
    tokens = F.regexp_extract_all(_c(value), F.lit(r"(?s)(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), 1)

    def plain(tok: Column) -> Column:
        code = F.conv(F.substring(tok, 3, 8), 16, 10).cast("int")
        wide = F.decode(F.to_binary(F.lpad(F.hex(code), 8, "0"), F.lit("hex")), "UTF-32")
        return (
            F.when(tok == "\\t", "\t").when(tok == "\\n", "\n").when(tok == "\\r", "\r").when(tok == "\\b", "\b")
            .when(tok == "\\f", "\f").when(tok.rlike(r"^\\[uU]"), wide)
            .when(tok.startswith("\\"), F.substring(tok, 2, 1 << 30)).otherwise(tok)
        )

    return F.when(F.contains(_c(value), F.lit("\\")), F.array_join(F.transform(tokens, plain), "")).otherwise(_c(value))


def nt_term(kind, value, datatype, lang) -> Column:
    """One term as text: <iri>, _:node or a literal with its datatype or language."""
    kind, value, datatype, lang = map(_c, (kind, value, datatype, lang))
    quoted = nt_quote(value)
    return (
        F.when(kind == "iri", F.concat(F.lit("<"), value, F.lit(">")))
        .when(kind == "bnode", F.concat(F.lit("_:"), value))
        .when(lang.isNotNull(), F.concat(quoted, F.lit("@"), lang))
        .when(datatype.isNotNull() & (datatype != XSD + "string"), F.concat(quoted, F.lit("^^<"), datatype, F.lit(">")))
        .otherwise(quoted)
    )


def hash_sum(digest: Column) -> Column:
    """A digest of a multiset of sha256 hex digests: their number and the sums of all their digits, in five pieces.

    Sums need no order and gather nothing in one place; no digit is left out.
    """
    piece = lambda at: F.sum(F.conv(F.substring(digest, at, 13), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[piece(at) for at in (1, 14, 27, 40, 53)]), 256)
