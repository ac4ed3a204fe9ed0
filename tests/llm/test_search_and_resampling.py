"""Ranked search, resampling and token counts on awkward tables, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from test_registered_queries import empty, folder, tables  # noqa: F401

from quarry.llm import queries, ranked_search, resample, word_runs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def searched(docs, items, k=10):
    own = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n_docs, terms = len(own), sum(c.total() for _, c in own)
    df = Counter(w for _, c in own for w in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in own:
            m = 25 + (75 * c.total() * n_docs) // terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w in words(text) if c[w])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


def drawn(docs, items):
    def features(text):
        w = words(text)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for _, x in items for b in features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in range(10_000)]
    rows = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in rows)


def test_search_equals_brute_force(spark, folder):  # noqa: F811
    got = Counter(tuple(r) for r in queries.op11_ranked_search(spark, folder).collect())
    t = tables()
    assert got == searched([(r[0], r[1]) for r in t["documents"][1]], t["benchmark"][1])


@pytest.mark.parametrize(("k", "block"), [(3, 1), (10, 7)])
def test_search_in_blocks_and_small_shards(spark, monkeypatch, k, block):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(40)] + ["Café", "中", "a1b"]
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n"]) for _ in range(n))
    same = say(12)
    docs = [(i, same if i % 3 == 0 else say(rng.randint(0, 30))) for i in range(300)] + [(5, same), (None, same), (None, say(9))]
    items = [(i, say(rng.randint(0, 12))) for i in range(12)] + [(1, "w1 w1 W1"), (None, "w2"), (99, "absent"), (98, None)]
    monkeypatch.setattr(ranked_search, "SHARD_DOCUMENTS", 17)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r) for r in ranked_search.search(d, q, k=k, block_terms=block).collect())
    assert got == searched(docs, items, k)


def test_resampling_equals_brute_force(spark, folder):  # noqa: F811
    t = tables()
    got = Counter(tuple(r) for r in queries.op12_importance_resampling(spark, folder).collect())
    assert got == drawn([(r[0], r[1]) for r in t["documents"][1]], t["benchmark"][1])


def test_resampling_draws_with_ties_and_across_ranges(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["red", "green", "Blue", "größe", "one"]) for _ in range(n))
    same = say(30)
    docs = [(i, same if i % 2 else say(rng.randint(10, 40))) for i in range(800)] + [(7, same)] * 40
    items = [(1, "one one red red"), (2, None)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    assert Counter(tuple(r) for r in resample.resample(d, q).collect()) == drawn(docs, items)


def test_n_grams_span_blocks(monkeypatch):
    texts = [b"a b c d e f g " * 30, None, b"", b"x", b"a b", b"c d"]
    whole = sorted((int(o), int(b)) for _, owner, bucket in resample._features(texts, 10_000) for o, b in zip(owner, bucket, strict=True))
    monkeypatch.setattr(resample, "runs", lambda t: word_runs.runs(t, 5))
    monkeypatch.setattr(resample, "numbered", lambda blocks: word_runs.numbered(blocks, 2))
    cut = sorted((int(o), int(b)) for _, owner, bucket in resample._features(texts, 10_000) for o, b in zip(owner, bucket, strict=True))
    assert whole == cut


def test_words_in_runs_are_the_words_of_the_whole():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", " ", "  ", "é", "-", "\n", "longer"]) for _ in range(rng.randint(0, 40))).encode()
        for most in (1, 3, 100):
            found = [w for run in word_runs.runs(text, most) for w in run]
            assert found == text.translate(word_runs.LOWERED).split()
            assert ranked_search.n_terms(text) == len(found)


def test_counts_of_tokens(spark, folder):  # noqa: F811
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter()
    for r in tables()["documents"][1]:
        n = len(library.encode(r[1] or "", add_special_tokens=False).ids)
        want[r[0], len((r[1] or "").encode()), n, n > 1024] += 1
    assert Counter(tuple(r) for r in queries.op13_token_counts(spark, folder).collect()) == want


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_importance_resampling", "op13_token_counts"])
def test_empty_tables(spark, empty, name):  # noqa: F811
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two three", 5, "x", 2)], "doc_id long, text string, weight int, `row` string, m int")
    items = spark.createDataFrame([(1, "two", 3)], "item_id long, text string, query int")
    assert [r["doc_id"] for r in ranked_search.search(docs, items).collect()] == [1]
    assert resample.resample(docs, items).count() == 1
