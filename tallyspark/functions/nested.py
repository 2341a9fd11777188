"""JSON columns: typed access that tells missing, null and wrong types apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def variant(text: Column) -> Column:
    """The parsed JSON; null for null, empty or malformed text."""
    return F.try_parse_json(text)


def text_field(v: Column, path: str) -> Column:
    """A string at the path; null if there is nothing or something else."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def number_field(v: Column, path: str) -> Column:
    """A number at the path; null if there is nothing or something else, a string too."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(v, path, "double"))


def has_key(text: Column, key: str) -> Column:
    """Is the key there, if only with null? False for anything but an object."""
    return F.coalesce(F.array_contains(F.json_object_keys(F.when(variant(text).isNotNull(), text)), key), F.lit(False))


def string_list(text: Column) -> Column:
    """A JSON array of strings; empty for null and malformed text."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def array_length(text: Column) -> Column:
    return F.coalesce(F.json_array_length(F.when(variant(text).isNotNull(), text)), F.lit(0))
