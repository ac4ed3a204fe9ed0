"""How many Python workers the pipeline's last stages hold beside each other."""

import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, packing
from quarry.llm.queries import tokenizer_path

ITEM = " ".join(f"w{i}" for i in range(14))


@pytest.mark.parametrize("block", [200_000, 12])
def test_decontaminate_matches_and_cuts_in_one_worker(spark, block):
    rows = [(1, "before " * 30 + ITEM + " after"), (2, ITEM), (3, None), (4, ""), (5, "nothing of it here"), (6, "x " * 20 + "né w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, "other words " * 6)], "item_id int, text string")
    out = decontaminate.decontaminate(docs, bench, block_words=block)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {1: "before " * 30 + "after", 3: None, 4: "", 5: "nothing of it here", 6: "x " * 20 + "né w1 w2"}


def test_pack_starts_no_workers_for_its_plan(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "some words " * (i % 40)) for i in range(60)], "doc_id long, text string")
    made, asked = type(spark).createDataFrame, []
    monkeypatch.setattr(type(spark), "createDataFrame", lambda s, data, *a, **k: asked.append(made(s, data, *a, **k)) or asked[-1])
    packed = packing.pack(docs, tokenizer_path=tokenizer_path())
    assert len(asked) == 1 and "ExistingRDD" not in asked[0]._jdf.queryExecution().executedPlan().toString()
    ends = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("past")).collect()
    assert all(r["n"] == r["past"] <= 1024 for r in ends) and packed.count() == 60
    assert packing.pack(docs.limit(0), tokenizer_path=tokenizer_path()).count() == 0
