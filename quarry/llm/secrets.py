"""Secret scans: fixed patterns, and character Markov models of random strings
and of ordinary words compared by log-likelihood ratio. DataFrame functions only.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.arrays import bound, running
from quarry.llm.common import written

#: Base patterns by kind, in the order in which kinds are listed.
BASE = {
    "assign": r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",  # runs are maximal, so a shorter one holds no match either
    "hex": r"[0-9a-f]{24,}",
}
MIN_VALUE = 6
#: What the models look at: unbroken runs of the characters of keys.
MIN_RUN = 16
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}"
#: Candidates that are taken for ordinary in training: words of small letters. Others are still to be judged and teach nothing.
#: Possessive, since Java's matcher calls itself once a segment otherwise.
IDENTIFIER = r"^[a-z]++(?:[+/_=-]++[a-z]++)*+$"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Log-likelihood ratio a character from which a candidate counts as random.
MARGIN = 0.5
#: Transitions that the single characters' shares count for in each row.
PRIOR = 10.0
_SIZE = len(ALPHABET) + 1  # 0: the start of a string


_SPANS = "array<struct<start:int,kind:int,end:int,match:string>>"


def spans(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<start, kind, end, match>> of the leftmost matches that don't
    overlap, in code points. What split() leaves between the matches gives their places."""
    def placed(both: Column) -> Column:
        found, gaps = both["found"], both["gaps"]
        ends = running(F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: g + F.length(m)), lambda a, x: a + x, F.lit(0))
        return F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), m.alias("match")))

    matched = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.transform(F.split(text, pattern, -1), F.length).alias("gaps"))
    return F.when(text.rlike(pattern), bound(matched, placed)).otherwise(F.array().cast(_SPANS))


def clear_of(tried: Column, base: Column) -> Column:
    """The spans of ``tried`` that none of ``base`` overlaps. Both are put in
    order once; a span is clear if no base span before it ends beyond its start
    and none after it starts before its end."""
    far = 2**31 - 1
    is_base = lambda x: x["kind"] < len(BASE)

    def kept(both: Column) -> Column:
        ended = running(F.transform(both, lambda x: F.when(is_base(x), x["end"]).otherwise(0)), F.greatest, F.lit(0))
        begins = F.reverse(running(F.reverse(F.transform(both, lambda x: F.when(is_base(x), x["start"]).otherwise(far))), F.least, F.lit(far)))
        rows = F.zip_with(F.zip_with(both, ended, lambda x, e: F.struct(x.alias("x"), e.alias("e"))), begins, lambda r, b: F.struct(r["x"].alias("x"), ((r["e"] <= r["x"]["start"]) & (b >= r["x"]["end"])).alias("clear")))
        return F.transform(F.filter(rows, lambda r: r["clear"] & ~is_base(r["x"])), lambda r: r["x"])

    either = (F.size(base) == 0) | (F.size(tried) == 0)
    return F.when(either, tried).otherwise(bound(F.array_sort(F.concat(base, tried)), kept))


def base_spans(text: Column) -> dict[str, Column]:
    value = lambda x: F.regexp_extract(x["match"], BASE["assign"], 1)
    found = {kind: spans(text, pattern, i) for i, (kind, pattern) in enumerate(BASE.items())}
    return found | {"assign": F.filter(found["assign"], lambda x: F.length(value(x)) >= MIN_VALUE)}


def pairs(s: Column) -> Column:
    """Cells of the transition table that a string passes."""
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    before = F.concat(F.array(F.lit(0)), codes)
    return F.zip_with(F.slice(before, 1, F.size(codes)), codes, lambda a, b: a * _SIZE + b)


def train(random: DataFrame, ordinary: DataFrame) -> list[float]:
    """``(s)`` each -> ln P_random - ln P_ordinary of every transition.

    Equal strings are counted before they are taken apart. The driver gets the
    counts of at most 68 * 68 * 2 transitions.
    """
    strings = random.select(F.lit(1).alias("label"), "s").unionByName(ordinary.select(F.lit(0).alias("label"), "s")).groupBy("label", "s").agg(F.count("*").alias("times"))
    counted = strings.select("label", "times", F.explode(pairs(F.col("s"))).alias("cell")).groupBy("label", "cell").agg(F.sum("times").alias("n"))
    table = {(r["label"], r["cell"]): r["n"] for r in counted.collect()}
    out = []
    n = lambda label, a, b: table.get((label, a * _SIZE + b), 0)
    row = {(label, a): sum(n(label, a, b) for b in range(_SIZE)) for label in (0, 1) for a in range(_SIZE)}
    all_ = {(label, b): sum(n(label, a, b) for a in range(_SIZE)) + 0.5 for label in (0, 1) for b in range(_SIZE)}
    size = {label: sum(all_[label, b] for b in range(_SIZE)) for label in (0, 1)}
    # a rare character's row leans on how often each character stands anywhere
    p = lambda label, a, b: (n(label, a, b) + PRIOR * all_[label, b] / size[label]) / (row[label, a] + PRIOR)
    for a in range(_SIZE):
        for b in range(_SIZE):
            out.append(log(p(1, a, b)) - log(p(0, a, b)))
    return out


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """One row a document: ``(id_col, spans)``, an array of (start, kind, end) by
    start, then kind: 0 assign, 1 access, 2 hex, 3 what the models add.

    Labelled samples, from all documents: the values and keys of the base matches
    (random; values that are words of small letters teach nothing), and the runs of four key characters and more
    outside of base matches and candidates (ordinary). The models look at every run of key characters that
    no base match overlaps. If no base match exists they have nothing to learn from, and
    add nothing. Null and empty texts have no spans. Repeated ids are rows of their own.
    """
    base = base_spans(F.col("text"))
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seen = F.struct(F.concat(*base.values()).alias("base"), spans(F.col("text"), CANDIDATE, len(BASE)).alias("tried"))
    found = named.select("id", bound(seen, lambda s: F.struct(s["base"].alias("base"), clear_of(s["tried"], s["base"]).alias("tried"))).alias("s"))
    rows = written(found.select("id", "s.base", "s.tried"))
    value = lambda x: F.when(x["kind"] == 0, F.regexp_extract(x["match"], BASE["assign"], 1)).otherwise(x["match"])
    random = rows.where(F.size("base") > 0).select(F.explode(F.transform("base", value)).alias("s")).where(~F.col("s").rlike(IDENTIFIER))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", BASE["assign"], " "), BASE["access"], " "), BASE["hex"], " ")
    runs = named.select(F.explode(F.regexp_extract_all(plain, F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("s"))
    ordinary = runs.where((F.length("s") < MIN_RUN) | F.col("s").rlike(IDENTIFIER))
    ratio = F.from_json(F.lit(str(train(random, ordinary))), "array<double>")
    likely = lambda s: F.aggregate(pairs(s), F.lit(0.0), lambda x, c: x + F.element_at(ratio, c + 1)) / F.length(s)
    none = F.array().cast(_SPANS)
    added = F.filter("tried", lambda c: likely(c["match"]) >= margin) if random.head(1) else none
    bare = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    return rows.select(F.col("id").alias(id_col), F.sort_array(F.transform(F.concat("base", added), bare)).alias("spans"))


def spelled(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, (*BASE, "markov")))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
