"""What reports show of a finding: prose without bookkeeping, endpoints, hosts, priorities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an engine signs its confirmations with; a parameter of ``clean_prose()``.
ENGINE = "ENGINE"
#: Other bookkeeping that doesn't belong into prose, any case. Fixed values.
NOISE = r"(Harness iteration\s*\d+\s*\|?)|(Gates?\s*:\s*(passed|pass|ok)\b\.?)|(\bqualification\s*[:=]\s*\S+)|(\bconviction[_ ]level\s*[:=]\s*\d+)"
#: Names before an equals sign that are no parameters. Fixed values.
NO_PARAMETER = ["get", "post", "put", "delete", "patch", "http", "https", "user", "input", "the", "arg", "field"]
LABEL = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
DOMAIN = rf"{LABEL}(?:\.{LABEL})*\.[a-z]{{2,63}}"


def noise(engine: str = ENGINE) -> str:
    return rf"(?i)({engine}\s*CONFIRMED\s*\|?)|{NOISE}"


#: What is cleaned after the bookkeeping went, in this order. Fixed values.
TIDY = [(r"\|\s*\|", "|"), (r"^\s*[|·]\s*", ""), (r"\s*[|·]\s*$", ""), (r"[ \t]{2,}", " ")]


def clean_prose(text: Column, engine: str = ENGINE) -> Column:
    out = F.regexp_replace(F.coalesce(text, F.lit("")), noise(engine), "")
    for pattern, to in TIDY:
        out = F.regexp_replace(out, pattern, to)
    return F.btrim(out, F.lit(" |·\n\t"))


def endpoint(text: Column) -> Column:
    """struct<method, path, param>; GET and empty where nothing is said."""
    some = lambda c, otherwise: F.coalesce(F.nullif(c, F.lit("")), otherwise)
    method = some(F.regexp_extract(text, r"\b(GET|POST|PUT|DELETE|PATCH)\b", 1), F.lit("GET"))
    path = F.regexp_extract(text, r"(/[A-Za-z0-9_\-/{}.]+)", 1)
    guessed = F.get(F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)="), F.lit(1)), lambda x: ~F.lower(x).isin(NO_PARAMETER)), F.lit(0))
    param = some(F.regexp_extract(text, r"(?i)\bparam(?:eter)?\s*[=:]\s*([A-Za-z0-9_]+)", 1), F.coalesce(guessed, F.lit("")))
    return F.struct(method.alias("method"), path.alias("path"), param.alias("param"))


def domain(value: Column) -> Column:
    """The name in lower case without scheme and last dot, null if it isn't a DNS name alone."""
    bare = F.regexp_replace(F.lower(F.btrim(value)), r"\.$", "")
    host = F.regexp_replace(bare, r"^https?://([^/?#:@]*)/?$", "$1")
    labels = F.split(host, r"\.", -1)  # label by label: the whole pattern would call itself once a label
    named = (F.size(labels) > 1) & F.forall(labels, lambda x: x.rlike(rf"\A{LABEL}\z")) & F.element_at(labels, -1).rlike(r"\A[a-z]{2,63}\z")
    return F.when(~value.rlike(r"[\x00-\x1f]") & named, host)


def plan_band(cvss: Column, threshold: float) -> Column:
    return F.when(cvss >= 9, "critical").when(cvss >= threshold, "high").when(cvss >= 4, "medium").otherwise("informational")
