"""Texts that once ended a JVM, ran for hours or filled a worker; the tokenizer as a transducer."""

import os
import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, packing, secrets, token_counts
from quarry.llm.queries import tokenizer_path

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PIECES = ["a", "the", " the", "'", "'s", "'ll", "'S", " ", "  ", "\n", "\r\n", "\t", " ", "\x1c", "\x85", "é", "ß", "中文", "語", "😀", "½", "²", "Ⅷ", "1", "23", "!", "--", "=" * 9, "...", "ing", "\x00", "<|endoftext|>", "ا", "́", "aaa", "xq"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    out = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 70))) for _ in range(n)]
    return [*out, "a" * 5_000, "-" * 9_999, "=" * 3_001, "中" * 2_000, " " * 3_000 + "a", "\n" * 999, "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABC0123456789+/") for _ in range(40_000)), "".join(rng.choice("etaoins") for _ in range(40_000))]


@pytest.mark.parametrize("block", [37, 64, 1 << 18])
def test_counts_and_ids_are_the_librarys(library, monkeypatch, block):
    monkeypatch.setattr(token_counts, "_BLOCK", block)
    texts = odd_texts(1500 if block > 64 else 300)
    counter = token_counts.Counter(token_counts.Vocabulary.read(tokenizer_path()))
    ids = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counter.count(texts).tolist() == list(map(len, ids))
    for text, own in zip(texts, ids, strict=True):
        if "<|endoftext|>" not in text:
            assert np.frombuffer(counter.encode(text), dtype="<u4").tolist() == own


def test_a_full_table_starts_anew(library, monkeypatch):
    monkeypatch.setattr(token_counts, "_MOST_STATES", 50)
    monkeypatch.setattr(token_counts, "_BLOCK", 100)
    texts = odd_texts(60, seed=8)
    counter = token_counts.Counter(token_counts.Vocabulary.read(tokenizer_path()))
    assert counter.count(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.Vocabulary.read(tokenizer_path("word_bpe_49k.json"))


def test_packing_cuts_where_pre_tokens_start(library, monkeypatch):
    monkeypatch.setattr(packing, "_BLOCK", 50)
    monkeypatch.setattr(packing, "_FAR", 200)
    texts = odd_texts(600, seed=5)
    for text, ids in zip(texts, packing.Encoder(tokenizer_path()).encode_default(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("between", ["\n", ""])
def test_packing_holds_a_long_text_in_bounded_memory(between):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    text = between.join(rng.choice(words) for _ in range(1_400_000 if between else 800_000))
    encoder = packing.Encoder(tokenizer_path())
    tracemalloc.start()
    encoder.encode([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * len(text) + 100e6


def test_equal_words_are_matched_in_linear_time():
    began = time.time()
    automaton = decontaminate.Automaton([("x", b"w " * 200_000), ("y", b"w " * 50)], 10)
    n, spans, found = automaton.match(b"w " * 200_000)
    assert (n, spans, found) == (200_000, [(0, 200_000)], {"x", "y"})
    assert time.time() - began < 20


def test_secret_patterns_survive_a_million_segments(spark):
    texts = ["token=abcdef12 " + "a-" * 1_000_000 + "a", "x" * 1_000_000, "a_" * 500_000, "password:" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert secrets.scan(docs).count() == 4
    same = spark.createDataFrame([(s,) for s in ("a", "a-b", "a--b", "a-", "-a", "", "a1", "a_b+c/d=e")], "s string")
    plain = r"^[a-z]+([+/_=-]+[a-z]+)*$"
    assert same.where(F.col("s").rlike(plain) != F.col("s").rlike(secrets.IDENTIFIER)).count() == 0
