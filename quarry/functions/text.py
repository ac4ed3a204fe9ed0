"""Strings, paths, hashes and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(text: Column, most: int = 80) -> Column:
    s = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.substring(s, 1, most), F.lit("")), F.lit("untitled"))


def package_name(name: Column) -> Column:
    """Without a @scope, the last segment, - as _, lower case."""
    return F.translate(F.lower(F.element_at(F.split(F.regexp_replace(name, "^@[^/]+/", ""), "/"), -1)), "-", "_")


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1)


def location(file: Column, description: Column) -> tuple[Column, Column]:
    """(file, line) from the fields or from ``file=name:12`` in a description."""
    path = F.coalesce(F.nullif(file, F.lit("")), F.nullif(F.regexp_extract(description, r"file=([^\s|:]+)", 1), F.lit("")))
    return path, F.nullif(F.regexp_extract(description, r":(\d+)\b", 1), F.lit("")).try_cast("long")


def route(path: Column) -> Column:
    """A URL path in one spelling: one slash in front and between, none behind, no query."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"[?#].*$", ""), "/+", "/")
    return F.coalesce(F.nullif(F.regexp_replace(F.concat(F.lit("/"), F.ltrim(bare, F.lit("/"))), "(.)/$", "$1"), F.lit("")), F.lit("/"))


def content_id(*parts: Column, length: int = 20) -> Column:
    """A stable id of a row's identity: sha256 of its parts, each with its length in front."""
    spelled = [F.concat_ws(":", F.length(p.cast("string")).cast("string"), p.cast("string")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *spelled), 256), 1, length)


def duration(seconds: Column) -> Column:
    """12.3s, 4m 5.0s, 2h 3m 4s. The tenth is that nearest to ten times the number, as
    a double; round(seconds, 1) goes by the number's decimal spelling and is a tenth off near halves."""
    s = F.round(seconds * 10) / 10
    minutes = F.floor(s / 60)
    return (
        F.when(s < 60, F.format_string("%.1fs", s)).when(s < 3600, F.format_string("%dm %.1fs", minutes, s - minutes * 60))
        .when(s.isNotNull(), F.format_string("%dh %dm %ds", F.floor(s / 3600), F.floor(minutes % 60), F.floor(s % 60)))
    )


def mebibytes(n: Column) -> Column:
    return F.when(n >= 1 << 30, F.format_string("%.1f GiB", n / (1 << 30))).otherwise(F.format_string("%.1f MiB", n / (1 << 20)))


def longest_prefix_candidates(name: Column) -> Column:
    """All prefixes of a dotted or slashed name at its boundaries, longest first."""
    parts = F.split(F.translate(name, ".", "/"), "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def body_markers(html: Column, most: int = 8) -> Column:
    """Titles and headings of 3 to 120 characters, trimmed, sorted, distinct."""
    found = F.concat(F.regexp_extract_all(html, F.lit(r"<title>([^<]+)</title>"), F.lit(1)), F.regexp_extract_all(html, F.lit(r"<h1>([^<]+)</h1>"), F.lit(1)))
    kept = F.filter(F.transform(found, lambda s: F.btrim(s)), lambda s: F.length(s).between(3, 120))
    return F.slice(F.array_sort(F.array_distinct(kept)), 1, most)
