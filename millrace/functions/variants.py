"""JSON text whose shape is not known beforehand, as variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_variant(text: Column) -> Column:
    """The JSON value of a text; null for a null or malformed one (with a JSON null it is a variant that holds null).

    What follows a whole value is not looked at.
    """
    return F.try_parse_json(text)


def field(value: Column, path: str, kind: str) -> Column:
    """What stands at a path of a variant, as a type; null if nothing does or it cannot be cast."""
    return F.try_variant_get(value, path, kind)


def shape_of(rows: DataFrame, value: str) -> str:
    """The schema that all variants of a column have in common, merged over all rows; malformed rows say nothing."""
    return rows.agg(F.schema_of_variant_agg(F.col(f"`{value}`")).alias("s")).first()["s"]
