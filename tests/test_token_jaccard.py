"""All documents against all benchmark items, by brute force."""

import random
from collections import Counter

import pytest

from quarry.operators import dedup
from quarry.plans import catalog


def overlap(x, y):
    return len(x & y) / len(x | y) if x | y else 0.0


def test_query_compares_every_pair(spark, tmp_path):
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(25)) + " the of and") for i in range(60)]
    docs = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(60)))) for i in range(80)]
    for i in range(60):  # near an item of another id modulo 40
        words = items[i][1].split()
        docs.append((100 + 41 * i, " ".join(words[: rng.randrange(15, 29)] + ["extra"])))
    docs += [(None, items[5][1]), (7, items[6][1]), (7, items[6][1]), (900, None), (901, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter((r["a"], r["b"], round(r["overlap"], 9)) for r in catalog.QUERIES["token_jaccard_all"](spark, str(tmp_path)).collect())
    sets = lambda rows: [(i, set((t or "").split())) for i, t in rows]
    want = Counter((a, b, round(overlap(x, y), 9)) for a, x in sets(docs) for b, y in sets(items) if overlap(x, y) >= 0.65)
    assert got == want and len(want) > 30 and any(a is not None and a % 40 != b % 40 for a, b, _ in want)


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
def test_similar_sets_of_frequent_tokens(spark, least):
    rng = random.Random(4)
    draw = lambda k: [(i, rng.sample([f"t{j}" for j in range(12)], rng.randrange(0, 10))) for i in range(k)]
    left, right = draw(50), draw(40)
    got = sorted((r["a"], r["b"]) for r in dedup.similar_sets(spark.createDataFrame(left, "a long, x array<string>"), spark.createDataFrame(right, "b long, y array<string>"), least).collect())
    assert got == sorted((a, b) for a, x in left for b, y in right if overlap(set(x), set(y)) >= least)
