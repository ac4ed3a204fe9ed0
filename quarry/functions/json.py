"""Typed fields out of JSON text: absent, null and malformed kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def document(text: Column) -> Column:
    """The text as VARIANT; malformed text and null read as {}."""
    return F.coalesce(F.try_parse_json(text), F.parse_json(F.lit("{}")))


def field(doc: Column, path: str, kind: str) -> Column:
    """The value at a path in the code, null if absent, null or of another type."""
    return F.try_variant_get(doc, path, kind)


def state(doc: Column, path: str) -> Column:
    """absent, null or present."""
    v = F.try_variant_get(doc, path, "variant")
    return F.when(v.isNull(), "absent").when(F.is_variant_null(v), "null").otherwise("present")


def bounded_state(text: Column, path: str, most_bytes: int = 262_144) -> Column:
    """not_recorded, oversized, malformed, absent, null or present."""
    doc = F.try_parse_json(text)
    return (
        F.when(text.isNull() | (text == ""), "not_recorded").when(F.octet_length(text) > most_bytes, "oversized").when(doc.isNull(), "malformed")
        .otherwise(state(F.coalesce(doc, F.parse_json(F.lit("{}"))), path))
    )


def members(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, name, value)`` of the members of JSON objects. Names are data,
    never part of a path, so any punctuation in them is safe."""
    as_map = F.from_json(text, "map<string,string>")
    return df.select(key, F.explode(F.map_entries(as_map)).alias("m")).select(key, F.col("m.key").alias("name"), F.col("m.value").alias("value"))


def member(text: Column, name: Column) -> Column:
    """struct<present, value> of one member by a name that is data."""
    entry = F.get(F.filter(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: e["key"] == name), F.lit(0))
    return F.struct(F.coalesce(entry.isNotNull(), F.lit(False)).alias("present"), entry["value"].alias("value"))


def objects(df: DataFrame, key: str, text: str, fields: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """``(key, ordinal, fields...)``: the objects of a JSON array, others
    skipped; offset and limit count objects. ``fields`` is a schema string."""
    items = F.from_json(text, "array<string>")
    only = F.filter(items, lambda s: F.startswith(F.ltrim(s), F.lit("{")))
    cut = F.slice(only, offset + 1, limit if limit is not None else 2**31 - 1 - offset)
    rows = df.select(key, F.posexplode(cut).alias("ordinal", "object"))
    return rows.select(key, (F.col("ordinal") + offset).alias("ordinal"), F.from_json("object", fields).alias("o")).select(key, "ordinal", "o.*")
