"""JSON documents as tables of nodes that keep what parsers drop: members of
equal names, their order, and any depth."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One token after white space: a mark, a string, a number or a word.
_TOKEN = re.compile(r'[ \t\n\r]*+(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?)|(true|false|null))')
#: Steps of a node's path at most; nodes deeper down have none, lest a text of brackets alone grow with its square.
DEEPEST = 1_000
_END = re.compile(r"[ \t\n\r]*\Z")


class _Object(list):
    """The members of an object, (name, value) each, as they stand there; a plain list is an array."""


class _Number(str):
    """A number as it is spelled."""


def _refused(word: str) -> None:
    raise ValueError(word)


_decode = json.JSONDecoder(object_pairs_hook=_Object, parse_int=_Number, parse_float=_Number, parse_constant=_refused).decode


class _Missing:
    """In place of a document: the text is null, empty or malformed. A class, so that it is the same in every process."""


def parse(text: str) -> list[dict] | None:
    """The nodes of a document in its own order, None if it is malformed. One
    pass with a stack of open containers, so no depth is too much."""
    nodes: list[dict] = []
    stack: list[list] = []  # of each open container: its node, how many children it has, the member's name that was read
    want, at = "value", 0  # value, first (a value or the end), name, first-name, colon, more (a comma or the end)

    def add(kind: str, atom: str | None) -> dict:
        if not stack:
            node = {"id": 0, "parent": None, "path": [], "key": None, "ordinal": 0, "kind": kind, "atom": atom}
        else:
            up, n, name = stack[-1]
            stack[-1][1] += 1
            step = f".{name}" if up["kind"] == "object" else f"#{n}"
            node = {"id": len(nodes), "parent": up["id"], "path": None if up["path"] is None or len(up["path"]) >= DEEPEST else [*up["path"], step], "key": name, "ordinal": n, "kind": kind, "atom": atom}
        nodes.append(node)
        return node

    while want != "done":
        m = _TOKEN.match(text, at)
        if m is None:
            return None
        at = m.end()
        mark, string, number, word = m.groups()
        if mark in ("}", "]"):
            if not stack or stack[-1][0]["kind"] != ("object" if mark == "}" else "array") or want not in ("more", "first-name" if mark == "}" else "first"):
                return None
            stack.pop()
            want = "more" if stack else "done"
        elif mark == ",":
            if want != "more":
                return None
            want = "name" if stack[-1][0]["kind"] == "object" else "value"
        elif mark == ":":
            if want != "colon":
                return None
            want = "value"
        elif want in ("name", "first-name"):
            if string is None:
                return None
            stack[-1][2] = json.loads(string)
            want = "colon"
        elif want not in ("value", "first"):
            return None
        elif mark:
            stack.append([add("object" if mark == "{" else "array", None), 0, None])
            want = "first-name" if mark == "{" else "first"
        else:
            if string is not None:
                add("string", json.loads(string))
            elif number is not None:
                add("number", number)
            else:
                add("null" if word == "null" else "boolean", None if word == "null" else word)
            want = "more" if stack else "done"
    return nodes if _END.match(text, at) else None


def document(text: str | None) -> object:
    """A document as objects, lists, numbers, strings, booleans and None, ``_Missing`` if there is none."""
    if not text:
        return _Missing
    try:
        read = _decode(text)
    except ValueError:
        return _Missing
    except RecursionError:  # deeper than the decoder goes
        read = _built(parse(text))
    # a lone half of a character can be spelled in JSON, but not be told in UTF-8
    return _Missing if "\\ud" in text.lower() and _lone(read) else read


def _built(nodes_: list[dict] | None) -> object:
    if nodes_ is None:
        return _Missing
    made: list = []
    for n in nodes_:
        kind, atom = n["kind"], n["atom"]
        value = {"object": _Object, "array": list, "null": lambda: None, "boolean": lambda: atom == "true", "number": lambda: _Number(atom), "string": lambda: atom}[kind]()  # noqa: B023
        if made:
            up = made[n["parent"]]
            up.append((n["key"], value) if isinstance(up, _Object) else value)
        made.append(value)
    return made[0]


def _lone(read: object) -> bool:
    stack = [read]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            if any("\ud800" <= c <= "\udfff" for c in x):
                return True
        elif isinstance(x, (list, tuple)):
            stack.extend(x)
    return False


def _kind(x: object) -> str:
    if isinstance(x, list):
        return "object" if isinstance(x, _Object) else "array"
    if isinstance(x, str):
        return "number" if isinstance(x, _Number) else "string"
    return "null" if x is None else "boolean"


def _atom(x: object) -> str | None:
    return None if x is None or isinstance(x, list) else str(x) if isinstance(x, str) else "true" if x else "false"


def _children(x: list) -> Iterator[tuple[str, object]]:
    """Each child with its step."""
    return ((f".{k}", v) for k, v in x) if isinstance(x, _Object) else ((f"#{i}", v) for i, v in enumerate(x))


def _spelled(at: tuple | None) -> str:
    steps = []
    while at is not None:
        at, step = at
        steps.append(step)
    return "".join(reversed(steps))


def _rows_of(text: Column, schema: str, rows: Callable[[str | None], Iterable[tuple]]) -> Column:
    """``rows`` of each text as an array of structs, made column by column."""
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    fields = [(n, kinds[t]) for n, t in (f.split(":") for f in schema.split(","))]

    @F.arrow_udf(f"array<struct<{schema}>>")
    def made(texts: pa.Array) -> pa.Array:
        found, ends = [], [0]
        for t in texts.to_pylist():
            found.extend(rows(t))
            ends.append(len(found))
        columns = list(zip(*found, strict=True)) or [()] * len(fields)
        flat = pa.StructArray.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, fields, strict=True)], fields=[pa.field(n, t) for n, t in fields])
        return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), flat)

    return made(text)


def _nodes(text: str | None) -> Iterator[tuple]:
    read = document(text)
    if read is _Missing:
        yield "", 0, None, 0, "malformed" if text else "not_recorded", None
        return
    stack: list[tuple] = [("", 0, None, 0, read)]
    while stack:
        path, depth, name, ordinal, x = stack.pop()
        yield path, depth, name, ordinal, _kind(x), _atom(x)
        if isinstance(x, list):
            deeper = None if depth is None or depth >= DEEPEST else depth + 1
            named = isinstance(x, _Object)
            stack.extend(reversed([(None if deeper is None else path + step, deeper, step[1:] if named else None, i, v) for i, (step, v) in enumerate(_children(x))]))


def nodes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, path, depth, name, ordinal, kind, atom)``, a row a node; a row of
    kind not_recorded or malformed where there are none. Nodes more than
    ``DEEPEST`` levels down have no path and no depth."""
    return df.select(key, F.explode(_rows_of(F.col(text), "path:string,depth:int,name:string,ordinal:int,kind:string,atom:string", _nodes)).alias("n")).select(key, "n.*")


def _nothing(x: object) -> bool:
    """Null, false, a number that is zero, an empty text or list. An object is something."""
    return not isinstance(x, _Object) and (float(x) == 0 if isinstance(x, _Number) else not x)


def _selected(read: object, path: list[str]) -> tuple[str, str | None]:
    at, copies, misplaced = [read], 0, False
    for k, name in enumerate(path):
        at = [v for x in at if isinstance(x, _Object) for n, v in x if n == name]
        copies = max(copies, len(at))
        misplaced |= k < len(path) - 1 and any(not isinstance(x, _Object) and not _nothing(x) for x in at)
    state = "duplicate" if copies > 1 else "misplaced" if misplaced else "absent" if not at else _kind(at[0])
    return state, _atom(at[0]) if state in ("string", "number", "boolean") else None


def guards(df: DataFrame, key: str, text: str, paths: list[list[str]]) -> DataFrame:
    """``(key, selected, state, atom)``, a row a document and path: not_recorded,
    malformed, duplicate (a name on the path is there twice), misplaced (a parent
    is no object, and not null, false, 0 or empty), absent, or the kind of what is there."""
    named = [(".".join(p), p) for p in paths]

    def told(t: str | None) -> Iterator[tuple]:
        read = document(t)
        why = "malformed" if t else "not_recorded"
        return ((n, why, None) if read is _Missing else (n, *_selected(read, p)) for n, p in named)

    return df.select(key, F.explode(_rows_of(F.col(text), "selected:string,state:string,atom:string", told)).alias("g")).select(key, "g.*")


def _repeated(text: str | None) -> Iterator[tuple]:
    read = document(text)
    stack: list[tuple] = [(read, None, 0)] if isinstance(read, list) else []
    while stack:
        x, at, depth = stack.pop()
        if isinstance(x, _Object) and len({n for n, _ in x}) < len(x):
            for name, copies in Counter(n for n, _ in x).items():
                if copies > 1:
                    yield _spelled(at) if depth < DEEPEST else None, name, copies
        stack.extend((v, (at, step), depth + 1) for step, v in _children(x) if isinstance(v, list))


def repeated_members(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, path, name, copies)``: names that an object, anywhere in a document, has more than once."""
    return df.select(key, F.explode(_rows_of(F.col(text), "path:string,name:string,copies:bigint", _repeated)).alias("r")).select(key, "r.*")


#: Names whose values are routes. Fixed values.
ROUTE_NAMES = ["path", "route", "endpoint", "url", "base_url", "health_url"]


def _follow(state: str, step: str) -> str | None:
    """The state below a step, None if nothing there counts."""
    if step[0] == "#":
        return {"look": "look", "value": "item"}.get(state)
    return None if state == "value" else "value" if step[1:].lower() in ROUTE_NAMES else "look"


def _routes(text: str | None) -> Iterator[tuple]:
    read = document(text)
    stack: list[tuple] = [(read, "look", None, 0)] if isinstance(read, list) else []
    while stack:
        x, state, at, depth = stack.pop()
        if depth >= DEEPEST:
            continue
        for step, v in _children(x):
            if isinstance(v, list):
                if (below := _follow(state, step)) is not None:
                    stack.append((v, below, (at, step), depth + 1))
            elif isinstance(v, str) and not isinstance(v, _Number) and _follow(state, step) in ("value", "item"):
                yield _spelled((at, step)), v


def route_values(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, path, route)``: strings that a member of a route's name holds, or
    a list that it holds. Objects in such a list are looked through like any
    other; objects and lists anywhere else below the name are not. Members of
    equal names count each. The state follows each node's own path, so
    nothing is joined."""
    return df.select(key, F.explode(_rows_of(F.col(text), "path:string,route:string", _routes)).alias("r")).select(key, "r.*")
