"""Canonical JSON and signatures against Python's own; choices within a budget."""

import hashlib
import hmac
import json
import random

from pyspark.sql import functions as F

from quarry.functions import canonical as C
from quarry.operators import selection as S


def _value(rng, depth=0):
    kind = rng.randint(0, 7 if depth < 4 else 4)
    if kind == 0:
        return rng.choice([0, 1, -7, 12_345_678_901, 2.5, -0.25])
    if kind == 1:
        return "".join(rng.choice(["a", "é", "中", "😀", '"', "\\", "\\u001F", "\n", "\x1f", "\x0b", "/", "~", ","]) for _ in range(rng.randint(0, 6)))
    if kind < 5:
        return [None, True, False][kind - 2]
    if kind == 5:
        return [_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["b", "a", "B", "é", "a.b", "~", "z1", ""]): _value(rng, depth + 1) for _ in range(rng.randint(0, 4))}


def test_canonical_forms_and_signatures_are_pythons(spark):
    rng = random.Random(2)
    values = [_value(rng) for _ in range(800)]
    df = spark.createDataFrame([(i, json.dumps(v, indent=rng.choice([None, 2]), ensure_ascii=bool(i % 2))) for i, v in enumerate(values)], "i long, t string")
    for key in (b"k", b"x" * 80):
        got = df.select("i", C.canonical(F.col("t")).alias("c"), C.canonical(F.col("t"), True).alias("a"), C.digest(F.col("t")).alias("d"), C.signature(key, b"domain", F.col("t")).alias("s"))
        for r in got.collect():
            plain, ascii_ = (json.dumps(values[r["i"]], sort_keys=True, separators=(",", ":"), ensure_ascii=a) for a in (False, True))
            assert (r["c"], r["a"]) == (plain, ascii_)
            assert r["d"] == hashlib.sha256(ascii_.encode()).hexdigest() and r["s"] == hmac.new(key, b"domain\0" + ascii_.encode(), hashlib.sha256).hexdigest()


def test_what_is_no_single_document_has_no_canonical_form(spark):
    bad = [None, "", "{", '{"a":1}x', "1 2", '1,"b":2', "1} x", '{"a":1,"a":2}', "[1]]", "nul"]
    df = spark.createDataFrame([(t,) for t in bad], "t string")
    assert [r["c"] for r in df.select(C.canonical(F.col("t")).alias("c")).collect()] == [None] * len(bad)


def test_budgets_are_spent_in_order(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.choice([None, *range(9)]), rng.choice([None, 0, 3, 50, 400]), rng.random() < 0.02) for g in ("x", "y", None) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i long, score int, cost int, pinned boolean").withColumn("by", F.when(~F.col("pinned"), F.col("score")))
    for whole in (True, False):
        got = {(r["g"], r["i"]): (r["place"], r["spent"], r["given"]) for r in S.within_budget(df, ["g"], [("by", True), ("i", False)], F.col("cost"), 900, mandatory=F.col("pinned"), bucket=-F.col("score"), whole=whole).collect()}
        want = {}
        for g in ("x", "y", None):
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (not r[4], 0 if r[4] else -(r[2] if r[2] is not None else -1), r[1]))
            spent = 0
            for place, (_, i, _, cost, pinned) in enumerate(own, 1):
                start, spent = spent, spent + (cost or 0)
                if pinned or (spent <= 900 if whole else start < 900):
                    want[g, i] = (place, spent, (cost or 0) if pinned else min(cost or 0, 900 - start))
        assert got == want


def test_a_large_group_is_many_tasks(spark):
    df = spark.range(300_000).select(F.lit(1).alias("g"), "id", (F.col("id") % 1000).alias("score"))
    got = S.within_budget(df, ["g"], [("score", True), ("id", False)], F.lit(1), 1_500, bucket=-F.col("score"))
    assert {(r["id"], r["place"]) for r in got.collect()} == {(i * 1000 + (999 - k // 300), k + 1) for k in range(1500) for i in [k % 300]}
    assert S.first_in_order(df.limit(0), ["g"], [("id", False)], 5, bucket=F.lit(0)).count() == 0
