"""Null ids and repeated rows in op7 and in the pipeline's near-duplicate stage."""

import random

import corpus_pipeline as P
from pyspark.sql import functions as F

from quarry.llm import near_dup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def say(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"wort{rng.randrange(300)}" for _ in range(n))


def test_stage_keeps_one_row_of_each_group(spark):
    row = lambda d, t, lang="de": (d, t, lang, "web", None if t is None else len(t))
    rows = [
        row(1, say(1)), row(1, say(1)), row(1, say(1)),  # the same row thrice
        row(2, say(2)), row(2, say(22)),  # one id, two texts
        row(None, say(3)),  # unique text, null id
        row(None, say(4)), row(None, say(4)),  # null ids only
        row(None, say(5)), row(9, say(5)), row(7, say(5), None),  # nulls last
        row(11, None), row(12, ""), row(None, " "),
    ]
    expected = [row(1, say(1)), row(2, say(2)), row(2, say(22)), row(None, say(3)), row(None, say(4)), row(7, say(5), None), row(11, None)]
    got = P.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


def test_op7_chain_through_a_null_id(spark, monkeypatch):
    prints = {"a": 0b0001, "b": 0b0111, "c": 0b1_1111}  # a and c are 4 bits apart, b is 2 from each
    codes = F.create_map(*[F.lit(x) for pair in prints.items() for x in pair])
    monkeypatch.setattr(near_dup, "fingerprint_column", lambda text, k: codes[text].cast("long"))
    docs = spark.createDataFrame([(5, "a"), (None, "b"), (3, "c"), (3, "c")], "doc_id long, text string")
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == 4 and {r["component_id"] for r in got} == {3}
    alone = near_dup.near_duplicates(docs.where("text = 'b'")).collect()
    assert [r["component_id"] for r in alone] == [None]
