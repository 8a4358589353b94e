"""Claims by one axis: who signed, what kind, or a value of the object."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_axis(claims: DataFrame, axis: str, value: str) -> DataFrame:
    """``object`` is JSON text: a scalar object matches as a whole, an object by any of its scalar fields."""
    if axis == "signer":
        return claims.filter(F.col("keyid") == value)
    if axis == "predicate":
        return claims.filter(F.col("predicate") == value)
    if axis == "object":
        fields = F.from_json("object", "map<string,string>")
        scalar = F.regexp_replace("object", '^"|"$', "") == value
        return claims.filter(scalar | F.coalesce(F.array_contains(F.map_values(fields), value), F.lit(False)))
    raise ValueError("ask by signer, predicate or object")
