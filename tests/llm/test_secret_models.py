"""The spans that the character models add, against a plain recomputation."""

import math
import random
import re
from collections import Counter

from quarry.llm import secrets

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def base(text):
    out = [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= 24]


def is_plain(s):
    return all(part and part.isascii() and part.isalpha() and part.islower() for part in re.split(r"[+/_=-]+", s))


def steps(s):
    codes = [0, *(LETTERS.find(c) + 1 for c in s)]
    return list(zip(codes, codes[1:], strict=False))


def expected(texts, margin=0.5):
    random_, plain = Counter(), Counter()
    for t in texts:
        random_.update(s for *_, s in base(t) if not is_plain(s))
        bare = HEX.sub(lambda m: " " if len(m[0]) >= 24 else m[0], ACCESS.sub(lambda m: " " if len(m[0]) >= 20 else m[0], ASSIGN.sub(" ", t)))
        plain.update(s for s in re.findall(r"[A-Za-z0-9+/_=-]{4,}", bare) if len(s) < 16 or is_plain(s))
    size = len(LETTERS) + 1
    models = []
    for strings in (plain, random_):
        n = Counter()
        for s, times in strings.items():
            for step in steps(s):
                n[step] += times
        row, column = Counter(), Counter({b: 0.5 for b in range(size)})
        for (a, b), k in n.items():
            row[a] += k
            column[b] += k
        total = sum(column.values())
        models.append(lambda a, b, n=n, row=row, column=column, total=total: (n[a, b] + 10 * column[b] / total) / (row[a] + 10))
    out = []
    for t in texts:
        found = [x[:3] for x in base(t)]
        if random_:
            for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", t):
                ratio = sum(math.log(models[1](a, b)) - math.log(models[0](a, b)) for a, b in steps(m[0])) / len(m[0])
                if not any(s < m.end() and m.start() < e for s, _, e in found) and ratio >= margin:
                    found.append((m.start(), 3, m.end()))
        out.append(sorted(found))
    return out


def test_added_spans_are_those_of_a_plain_recomputation(spark):
    rng = random.Random(12)
    key = lambda n, letters=LETTERS[:62]: "".join(rng.choice(letters) for _ in range(n))
    words = ["alpha", "beta", "gamma_delta", "configuration-manager-service", "read_only_replica_settings", "Über", "the", "of"]
    texts = ["", "no secrets here", "token=short"]
    for _ in range(120):
        parts = [rng.choice([rng.choice(words), rng.choice(words), f"secret: '{key(rng.randint(4, 30))}'", "AKIA" + key(16, LETTERS[:26]), key(32, "0123456789abcdef"), key(rng.randint(14, 40)), "password=" + rng.choice(words)]) for _ in range(rng.randint(1, 25))]
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in secrets.scan(docs).collect()}
    want = expected(texts)
    assert sum(k == 3 for spans in want for _, k, _ in spans) > 50
    assert [got[i] for i in range(len(texts))] == want
