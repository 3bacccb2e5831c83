"""Canonical JSON and the content keys made from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """One JSON object with its keys in order, no spaces, and nulls kept."""
    ordered = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.to_json(ordered, {"ignoreNullFields": "false"})


def canonical_row(df: DataFrame) -> Column:
    """A row of ``df`` as canonical JSON; decimals are written as strings, as stored cases have."""
    fields = {}
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        fields[field.name] = column.cast("string") if "decimal" in field.dataType.simpleString() else column
    return canonical_json(**fields)


def content_key(**fields: Column) -> Column:
    """SHA-256 of the canonical JSON of what a model receives."""
    return F.sha2(canonical_json(**fields), 256)


def rounded(scores: Column, digits: int = 4) -> Column:
    """A map of scores at a fixed number of digits."""
    return F.transform_values(scores, lambda _, v: F.round(v, digits))
