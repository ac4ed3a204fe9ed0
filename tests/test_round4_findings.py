"""One small case for each finding that was open after round 3."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from quarry.operators import search
from quarry.sources import json_tree


def _random_document(rng, depth=0):
    kind = rng.choice("oooaasnbz" if depth < 4 else "snbz")
    if kind == "o":
        return "{" + ", ".join(f'"{rng.choice(["path", "URL", "k", "a.b", "#1"])}": {_random_document(rng, depth + 1)}' for _ in range(rng.randrange(4))) + "}"
    if kind == "a":
        return "[" + ",".join(_random_document(rng, depth + 1) for _ in range(rng.randrange(4))) + "]"
    return {"s": json.dumps(rng.choice(["", "/x", 'q"\\é', "😀"])), "n": rng.choice(["0", "-0.0", "1E5", "12"]), "b": rng.choice(["true", "false"]), "z": "null"}[kind]


def test_members_and_routes_equal_those_of_the_node_table(spark):
    rng = random.Random(4)
    texts = [_random_document(rng) for _ in range(400)] + ["{", "[1,]", "", None, '{"a": "\\ud800"}', "NaN", '{"d":' * 1500 + '{"k": 1, "k": 2, "path": "/deep"}' + "}" * 1500]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, doc string")
    copies, routes, names = Counter(), Counter(), ["path", "url"]
    for i, text in enumerate(texts):
        read = json_tree.parse(text) if text and "\\ud800" not in text else None
        state = {}
        for n in read or []:
            up = n["parent"]
            if up is None:
                state[n["id"]] = "look"
                continue
            if read[up]["kind"] == "object":
                copies[i, up, None if n["path"] is None else "".join(n["path"][:-1]), n["key"]] += 1
                state[n["id"]] = ("value" if n["key"].lower() in names else "look") if state[up] in ("look", "item") else "closed"
            else:
                state[n["id"]] = {"look": "look", "value": "item"}.get(state[up], "closed")
            if n["kind"] == "string" and n["path"] is not None and state[n["id"]] in ("value", "item"):
                routes[i, "".join(n["path"]), n["atom"]] += 1
    repeated = json_tree.repeated_members(df, "k", "doc")
    found = json_tree.route_values(df, "k", "doc")
    assert Counter(map(tuple, repeated.collect())) == Counter((i, path, name, c) for (i, _, path, name), c in copies.items() if c > 1) and (406, None, "k", 2) in set(map(tuple, repeated.collect()))
    assert Counter(map(tuple, found.collect())) == routes and len(routes) > 20
    guarded = json_tree.guards(df, "k", "doc", [["path", "k"]])
    assert guarded.count() == len(texts)
    for made in (repeated, found, guarded):  # the nodes of a document, each with all its steps, don't leave the worker
        assert "parent" not in made._jdf.queryExecution().toString() and "Aggregate" not in made._jdf.queryExecution().toString()
    assert json_tree.nodes(df, "k", "doc").where("kind = 'malformed'").select(F.collect_set("k")).head()[0].__len__() == 4


def test_lexical_search_equals_that_by_joins(spark):
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice(["Ab", "c\x0bd", "é", "x", "yy", "z\u00a0w", "q1", "\t"]) for _ in range(n))
    rows = [(i, rng.choice([None, "", say(rng.randrange(1, 9))])) for i in range(200)] + [(300 + i, "x yy ab") for i in range(40)]
    docs = spark.createDataFrame(rows, "d long, t string").repartition(3)
    queries = spark.createDataFrame([(i, say(6)) for i in range(12)] + [(20, None), (21, "none here"), (22, "x yy x")], "q long, s string")
    ask = lambda how, *more: search.top_k(how(docs, queries, "d", "q", "t", "s", *more), "q", "d", 5).select("q", "d", "rank", F.round("score", 6))
    want = sorted(map(tuple, ask(search._tfidf_joined).collect()))
    found = ask(search.tfidf, 5)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 50
    assert "Join" not in found._jdf.queryExecution().toString()  # no words are shuffled
    known, search.BLOCK_CELLS = search.BLOCK_CELLS, 30
    try:  # many blocks of queries
        assert sorted(map(tuple, ask(search.tfidf, 5).collect())) == want
    finally:
        search.BLOCK_CELLS = known
    docs = docs.unionByName(docs.where("d % 7 = 0"))
    want = sorted(map(tuple, ask(search._tfidf_joined).collect()))
    assert sorted(map(tuple, ask(search.tfidf, 5).collect())) == want
