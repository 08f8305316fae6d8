"""Whole-document JSON parsing on top of VARIANT.

The built-in parser stops after the first value and ignores what follows. Wrapping the text in an
array that ends with a marker only the row itself knows makes trailing text visible: the marker is
the second and last element exactly if the text was one complete JSON value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(raw: Column) -> Column:
    """VARIANT of ``[<document>, <marker>]``; null if the text is not JSON."""
    return F.try_parse_json(
        F.concat(F.lit("["), raw, F.lit(","), F.xxhash64(raw).cast("string"), F.lit("]"))
    )


def is_document(parsed: Column, raw: Column) -> Column:
    """True if ``raw`` was exactly one JSON value."""
    return F.coalesce(
        (F.try_variant_get(parsed, "$[1]", "bigint") == F.xxhash64(raw))
        & F.try_variant_get(parsed, "$[2]", "variant").isNull(),
        F.lit(False),
    )


def member(parsed: Column, name: str) -> Column:
    """A member of the top-level object; null if absent or if the document is not an object."""
    return F.try_variant_get(parsed, f"$[0].{name}", "variant")


def type_name(value: Column) -> Column:
    return F.schema_of_variant(value)


def text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def quote(value: Column) -> Column:
    """A JSON string literal."""
    as_array = F.to_json(F.array(value))
    return F.substring(as_array, F.lit(2), F.length(as_array) - 2)
