"""op9 gives the ids of the tokenizer's default call, literal added tokens included."""

import random

from quarry.llm import packing
from quarry.llm.queries import tokenizer_path


def test_literal_added_tokens(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(6)
    parts = ["a", "word", " ", "  ", "\n", "'s", "é", "語", "<|endoftext|>", "<|endof", "text|>", "<|", " next"]
    texts = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "plain text", ""] + ["".join(rng.choices(parts, k=12)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.pack(docs, tokenizer_path=tokenizer_path(), size=1024, with_ids=True).collect()
    want = {i: (*tok.encode(t, add_special_tokens=False).ids, packing.END) for i, t in enumerate(texts)}
    assert {r["doc_id"]: tuple(r["ids"]) for r in got} == want and want[0] == (50256, packing.END)
