"""What single cases don't show: cutoffs that fire, posteriors, precision, long texts, batches, blocks, columns that clash."""

import random
import time
from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quarry.llm import common, decontaminate, language_id, line_dedup, quality_fm, quality_rules, secrets

RNG = random.Random(21)
KEYS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def test_cutoffs_that_fire_keep_what_brute_force_keeps(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(9000):
        marks = rng.choice([0, 0, 0, 0, 1, 4]) if rng.random() < 0.02 or i % 3 == 0 and rng.random() < 0.3 else 0
        words = [rng.choice(["house", "tree", "water", "stone"]) + str(rng.randrange(999)) for _ in range(20)]
        docs.append((i, " ".join(words) + " #" * marks, ["a", "b"][i % 2]))
        labels.append((i, int(marks < 3)))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = quality_rules.apply_rules(d, spark.createDataFrame(labels, "doc_id long, quality int")).collect()

    def metrics(r):
        n = max(r["word_chars"], 1)
        return {"symbol_share": r["n_symbols"] / n, "dup_line_share": r["n_dup_lines"] / 1, "repeat_share": r["n_repeat_words"] / max(r["n_words"], 1), "word_length": r["word_chars"] / max(r["n_words"], 1)}

    lang, quality = {i: x for i, _, x in docs}, dict(labels)
    p, tests = quality_rules.RISK / 4, sum(map(len, quality_rules.CUTOFFS.values()))
    cut = {}
    for s in ("a", "b"):
        good = [metrics(r) for r in got if lang[r["doc_id"]] == s and not r["base_failed"] and quality[r["doc_id"]] > 0]
        n = len(good)
        for m, values in quality_rules.CUTOFFS.items():
            for c in values:
                k = sum(g[m] > c for g in good)
                if k <= n * p and sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) <= quality_rules.ERROR / (tests * 2):
                    cut[s, m] = c
                    break
    assert len(cut) == 8
    rejected = 0
    for r in got:
        own = metrics(r)
        kept = not r["base_failed"] and not any(own[m] > c for (s, m), c in cut.items() if s == lang[r["doc_id"]])
        rejected += not kept and not r["base_failed"]
        assert r["kept"] == kept
    assert rejected > 50


def test_language_posterior_is_naive_bayes(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("das Haus", "de"), ("the house", "en"), ("ein Baum", "de"), ("a tree", "en")] * 5)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {x: np.zeros(language_id.BUCKETS) for x in ("de", "en")}

    def buckets(t):
        t, out = t.lower(), []
        for order in language_id.ORDERS:
            for k in range(len(t) - order + 1):
                h = order
                for c in t[k : k + order]:
                    h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
                out.append((h >> 17) & (language_id.BUCKETS - 1))
        return out

    for _, t, x in rows:
        np.add.at(counts[x], buckets(t), 1)
    for text in ("der Baum", "the tree house", "x"):
        logs = [np.log(0.5) + sum(np.log((counts[x][b] + 0.1) / (counts[x].sum() + 0.1 * language_id.BUCKETS)) for b in buckets(text)) for x in ("de", "en")]
        assert model.score([text])[0] == pytest.approx(logs, rel=1e-4)


def test_markov_spans_are_precise(spark):
    rng = random.Random(6)
    key = lambda n: "".join(rng.choice(KEYS) for _ in range(n))
    parts = ["account", "settings", "user", "profile", "manager", "network", "request", "handler", "config", "default", "service", "worker"]
    name = lambda: rng.choice(["_", "-", "/"]).join(rng.choice(parts) for _ in range(4))
    docs, planted = [], 0
    for i in range(300):
        words = [rng.choice(parts) for _ in range(30)] + [name() for _ in range(3)]
        if i % 2:
            words.append(f"secret={key(32)}")
        if i % 3 == 0:
            words.append(key(36))
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    right = wrong = 0
    for i, t in docs:
        for s in found[i]:
            if s["kind"] == 3:
                w = t[s["start"] : s["end"]]
                right, wrong = right + (len(w) == 36 and w.isalnum()), wrong + (not (len(w) == 36 and w.isalnum()))
        planted += i % 3 == 0
    assert right / planted >= 0.95 and wrong / max(1, right + wrong) <= 0.05


def test_one_text_of_very_many_spans(spark):
    text = " ".join(f"token={i:08d}x AKIA{i:016d} {'q' * 20}" for i in range(12_000))
    began = time.time()
    spans = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()["spans"]
    assert Counter(s["kind"] for s in spans)[0] == Counter(s["kind"] for s in spans)[1] == 12_000 and time.time() - began < 120
    for s in spans[:50] + spans[-50:]:
        assert text[s["start"] : s["end"]].startswith(("token=", "AKIA"))


def test_candidates_clear_of_base_spans(spark):
    rng = random.Random(9)
    kinds = "struct<start:int,kind:int,end:int,match:string>"
    cases = []
    for _ in range(200):
        span = lambda k: (a := rng.randrange(60), k, a + rng.randint(1, 9), "m")
        cases.append(([span(rng.randrange(3)) for _ in range(rng.randrange(5))], [span(3) for _ in range(rng.randrange(5))]))
    df = spark.createDataFrame(cases, f"base array<{kinds}>, tried array<{kinds}>")
    for (base, tried), r in zip(cases, df.select(secrets.clear_of(F.col("tried"), F.col("base")).alias("c")).collect(), strict=True):
        assert sorted(map(tuple, r["c"])) == sorted(t for t in tried if not any(b[0] < t[2] and t[0] < b[2] for b in base))


def test_line_runs_go_on_from_their_manifest(spark, tmp_path):
    rng = random.Random(3)
    batches = [[(rng.randrange(40), 0) for _ in range(200)] for _ in range(7)]
    whole = Counter(k for b in batches for k in b)
    for k, batch in enumerate(batches):
        runs = line_dedup.LineRuns(spark, 30, fanout=2, folder=str(tmp_path))  # as a later application would
        runs.add(spark.createDataFrame(batch, "h1 long, h2 long"))
        assert runs.version == k
    got = {(r["h1"], r["h2"]) for r in line_dedup.LineRuns(spark, 30, fanout=2, folder=str(tmp_path)).frequent().collect()}
    assert got == {k for k, n in whole.items() if n >= 30} and 0 < len(got) < 40
    assert line_dedup.LineRuns(spark, 30, folder=str(tmp_path / "new")).frequent().count() == 0


@pytest.mark.parametrize("block", [30, 60])
def test_blocks_find_what_one_automaton_finds(spark, block):
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([3, 9, 10, 25, 70, 12])]
    docs = [(i, " ".join([say(8), rng.choice(items)[1], say(5), rng.choice(items)[1]])) for i in range(40)] + [(90, None), (91, ""), (None, items[2][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = decontaminate.with_matches(d, b, "m").collect()
    many = decontaminate.with_matches(d, b, "m", block_words=block).collect()
    key = lambda r: repr((r["doc_id"], r["text"], r["m"]))
    assert sorted(map(key, one)) == sorted(map(key, many))


def test_columns_that_clash_pass_through(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["careful", "study"] if i % 2 else ["buy", "now"]) for _ in range(30)), 30, f"own {i}", i, "x") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, score string, predicted long, Scored string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    kept = quality_fm.accepted(docs, labels)
    assert kept.columns == docs.columns
    got = {r["doc_id"]: (r["score"], r["predicted"], r["Scored"]) for r in kept.collect()}
    assert got and all(v == (f"own {i}", i, "x") for i, v in got.items()) and sum(i % 2 for i in got) / len(got) > 0.9


def test_repeated_ids_train_once(spark):
    rows = [(i % 20, f"word{i % 20} " * 5) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    model = quality_fm.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, chars_col=None)
    assert np.isfinite(model.w).all()


def test_scratch_deletes_what_was_written(spark):
    import os

    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with common.scratch() as kept:
        kept.append(common.written(spark.range(3)))
        common.written(spark.range(4))
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and kept[0].count() == 3
    common.discard(kept[0])
    assert set(os.listdir(folder)) == before


def test_stages_keep_null_and_empty_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "de", "web", 0), (None, "solo text here", "de", "web", 14)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    lines = P.lines(spark, docs, str(tmp_path))
    assert sorted(map(repr, lines.collect())) == sorted(map(repr, docs.collect()))
    assert {r["doc_id"] for r in P.near_duplicates(spark, docs, str(tmp_path)).collect()} == {1, None}  # no words: one group
    assert sorted(map(repr, P.benchmark(spark, docs, str(tmp_path)).collect())) == sorted(map(repr, docs.collect()))
    assert Counter(r["doc_id"] for r in P.pack(spark, docs, str(tmp_path)).collect()) == {1: 1, 2: 1, None: 1}
