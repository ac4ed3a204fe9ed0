"""Canonical JSON, its digest, and signatures with a secret key, in the JVM."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.arrays import bound

_ESCAPES = ["\\u000B", "\\u000E", "\\u000F", *(f"\\u001{x}" for x in "ABCDEF")]


def canonical(text: Column, ascii_only: bool = False) -> Column:
    """The document with names sorted at every depth and no white space, null if it
    is malformed or repeats a name. Numbers are spelled as values: 2.50 is
    2.5, 1.0 is 1, 1e3 is 1000.0. ``ascii_only`` escapes what is beyond ASCII."""
    # The parser stops after one value. Only a member after it shows that nothing else follows, and no text can spell its own
    # hash; what goes on with members of its own is no entry of a list.
    ends = F.concat(F.lit(',"~'), F.sha2(F.encode(text, "UTF-8"), 256), F.lit('":0}'))
    entry = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
    read = bound(ends, lambda end: F.struct(end.alias("end"), F.to_json(F.try_parse_json(F.concat(F.lit('{"a":'), text, end))).alias("both")))
    alone = bound(read, lambda x: F.when(F.endswith(x["both"], x["end"]) & entry, F.substring(x["both"], F.lit(6), F.length(x["both"]) - 5 - F.length(x["end"]))))
    out = F.replace(alone, F.lit("\\\\"), F.lit("\x01"))  # an escaped backslash begins no other escape
    for e in _ESCAPES:
        out = F.replace(out, F.lit(e), F.lit(e.lower()))
    out = F.replace(out, F.lit("\x01"), F.lit("\\\\"))
    if not ascii_only:
        return out
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    spelled = lambda o: F.array_join(F.transform(F.split(o, ""), lambda c: F.when(F.octet_length(c) == 1, c).otherwise(units(c))), "")
    return bound(out, lambda o: F.when(F.octet_length(o) == F.length(o), o).otherwise(spelled(o)))


def digest(text: Column, ascii_only: bool = True) -> Column:
    """SHA-256 of the canonical form, in hex."""
    return F.sha2(F.encode(canonical(text, ascii_only), "UTF-8"), 256)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 of a binary column, in hex. The key is part of the plan: where
    plans are shown, it is shown."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    block = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def signature(key: bytes, domain: bytes, text: Column) -> Column:
    """Signature of a document's canonical ASCII form under a domain's name."""
    return hmac_sha256(key, F.concat(F.lit(domain + b"\0"), F.encode(canonical(text, True), "UTF-8")))


def signed(df: DataFrame, payload: Column, key: bytes, domain: bytes, most_bytes: int | None = None) -> DataFrame:
    """``df`` with ``document``: {"payload": ..., "signature": ...}, canonical. The
    payload is a struct or map column. Documents beyond ``most_bytes`` are null."""
    text = canonical(F.to_json(payload, {"ignoreNullFields": "false"}), True)
    whole = F.concat(F.lit('{"payload":'), text, F.lit(',"signature":"'), signature(key, domain, text), F.lit('"}'))
    return df.withColumn("document", whole if most_bytes is None else F.when(F.octet_length(whole) <= most_bytes, whole))


def verdict_of_signed(document: Column, key: bytes, domain: bytes) -> Column:
    """missing, malformed, not-canonical, forged or valid."""
    payload = F.get_json_object(document, "$.payload")
    given = F.get_json_object(document, "$.signature")
    return (
        F.when(F.coalesce(document, F.lit("")) == "", "missing").when(canonical(document).isNull() | payload.isNull() | given.isNull(), "malformed").when(canonical(document, True) != document, "not-canonical")
        .when(signature(key, domain, payload) != given, "forged").otherwise("valid")
    )


def finding_fingerprint(title: Column, file: Column, line: Column, kind: Column) -> Column:
    """What a receipt binds of a finding: its title, place and class, trimmed."""
    said = lambda c: F.btrim(F.coalesce(c, F.lit("")))
    return digest(F.to_json(F.struct(said(title).alias("title"), said(file).alias("file"), F.coalesce(line, F.lit(0)).alias("line"), said(kind).alias("class"))))


def receipt_verdict(receipt: Column, hash_: Column, fingerprint: Column, row_fingerprint: Column, audit: Column, check: Callable[[Column], Column]) -> Column:
    """Does a receipt still stand for its finding? The first reason against it:
    missing, malformed, not-canonical, hash, unbound, fingerprint, row-changed,
    audit, signature; else valid. ``check`` says whether the receipt's own signature holds."""
    field = lambda name: F.coalesce(F.get_json_object(receipt, f"$.{name}"), F.lit(""))
    given, bound, job = (F.btrim(F.coalesce(c, F.lit(""))) for c in (hash_, fingerprint, audit))
    return (
        F.when((F.coalesce(receipt, F.lit("")) == "") | (given == ""), "missing").when(canonical(receipt).isNull(), "malformed").when(canonical(receipt) != receipt, "not-canonical")
        .when(F.sha2(F.encode(receipt, "UTF-8"), 256) != F.lower(given), "hash").when(bound == "", "unbound").when(field("finding_fingerprint") != bound, "fingerprint").when(row_fingerprint != bound, "row-changed")
        .when((job == "") | (field("audit_id") != job), "audit").when(~check(receipt), "signature").otherwise("valid")
    )
