"""Stored documents as trees: nodes, repeated names, guarded paths, routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.plans.registry import query
from quarry.sources import json_tree as T
from quarry.sources.tables import spread, table

_B = "chr(92)"
#: Documents as a store holds them, from events: null, empty, malformed, lists
#: in lists, fifty levels, repeated names, routes, escapes, single values.
STORED = f"""CASE CAST(event_id % 12 AS INT) WHEN 0 THEN NULL WHEN 1 THEN ''
WHEN 2 THEN concat('{{"target": {{"name": "', event_type, '"')
WHEN 3 THEN concat('[[', CAST(user_id AS STRING), ', [2, [3, "x"]]], {{"route": "/in/', event_type, '"}}, []]')
WHEN 4 THEN concat(repeat('{{"d": ', 50), CAST(user_id AS STRING), repeat('}}', 50))
WHEN 5 THEN concat('{{"target": {{"name": "', event_type, '", "name": "b", "line": 1}}, "target": {{"name": null}}, "more": [{{"k": 1, "k": 2, "k": []}}]}}')
WHEN 6 THEN concat('{{"routes": [{{"path": "/u/', CAST(user_id AS STRING), '", "url": ["/health?x", "https://h/status", {{"endpoint": "/b", "x": "no", "deep": {{"route": "/c"}}}}, ["/never"]]}}, {{"Path": {{"route": "/dead"}}}}], "props": ', props, '}}')
WHEN 7 THEN concat('{{"a.b": "q', {_B}, '"', {_B}, {_B}, {_B}, 'u00e9", "', {_B}, 'u0074arget": {{"n', {_B}, 'u0061me": true}}}}')
WHEN 8 THEN concat(' ', CAST(user_id AS STRING), ' ')
WHEN 9 THEN concat('{{"target": "', event_type, '", "props": []}}')
WHEN 10 THEN concat('{{"target": {{}}, "props": null}} trailing ', event_type)
ELSE concat('{{"target": {{"name": "', event_type, '", "line": ', CAST(user_id AS STRING), '}}, "props": ', props, '}}') END"""
_TREE_SQL = f"""WITH RECURSIVE stored AS (SELECT event_id, {STORED} AS doc FROM events),
t AS (SELECT event_id, j.id, j.parent, j.key, j.type, CASE WHEN j.type = 'VARCHAR' THEN j.atom->>'$' WHEN j.type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN j.atom::VARCHAR END AS atom FROM stored, json_tree(CASE WHEN json_valid(doc) THEN doc END) j),
w AS (SELECT event_id, id, NULL::UBIGINT AS parent, NULL::VARCHAR AS name, '' AS path, '' AS up, 0 AS depth, type, atom, 'look' AS state FROM t WHERE parent IS NULL
 UNION ALL SELECT t.event_id, t.id, t.parent, CASE WHEN w.type = 'OBJECT' THEN t.key END, w.path || CASE WHEN w.type = 'ARRAY' THEN '#' ELSE '.' END || t.key, w.path, w.depth + 1, t.type, t.atom,
  CASE WHEN w.state IN ('look', 'item') AND w.type = 'OBJECT' THEN CASE WHEN lower(t.key) IN ({", ".join(f"'{n}'" for n in T.ROUTE_NAMES)}) THEN 'value' ELSE 'look' END
       WHEN w.state = 'look' THEN 'look' WHEN w.state = 'value' AND w.type = 'ARRAY' THEN 'item' ELSE 'closed' END
 FROM t JOIN w ON t.event_id = w.event_id AND t.parent = w.id),
n AS (SELECT *, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind FROM w)"""


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "events")).selectExpr("event_id", f"{STORED} AS doc")


@query(f"""{_TREE_SQL} SELECT event_id, path, depth::INT AS depth, name, kind, atom FROM n
UNION ALL SELECT event_id, '', 0, NULL, CASE WHEN coalesce(doc, '') = '' THEN 'not_recorded' ELSE 'malformed' END, NULL FROM stored WHERE NOT coalesce(json_valid(doc), false)""")
def json_nodes(spark: SparkSession, d: str) -> DataFrame:
    return T.nodes(_stored(spark, d), "event_id", "doc").drop("ordinal")


@query(f"""{_TREE_SQL} SELECT event_id, up AS path, name, count(*)::BIGINT AS copies FROM n WHERE name IS NOT NULL GROUP BY event_id, parent, up, name HAVING count(*) > 1""")
def repeated_json_members(spark: SparkSession, d: str) -> DataFrame:
    return T.repeated_members(_stored(spark, d), "event_id", "doc")


_PATHS = [["target"], ["target", "name"], ["target", "line"], ["props", "k"]]
_GUARD_SQL = f"""{_TREE_SQL}, g(selected, prefix, size) AS (VALUES {", ".join(f"('{'.'.join(p)}', '{''.join('.' + x for x in p[:k])}', {k - len(p)})" for p in _PATHS for k in range(1, len(p) + 1))}),
c AS (SELECT s.event_id, any_value(s.doc) AS doc, g.selected, g.prefix, g.size, count(n.id) AS copies, bool_or(n.kind <> 'object' AND NOT (n.kind = 'null' OR n.kind = 'boolean' AND n.atom = 'false' OR n.kind = 'number' AND n.atom = '0' OR n.kind = 'string' AND n.atom = '' OR n.kind = 'array' AND f.parent IS NULL)) AS other, any_value(n.kind) AS kind, any_value(n.atom) AS atom
 FROM stored s CROSS JOIN g LEFT JOIN n ON n.event_id = s.event_id AND n.path = g.prefix LEFT JOIN (SELECT DISTINCT event_id, parent FROM n) f ON f.event_id = n.event_id AND f.parent = n.id GROUP BY s.event_id, g.selected, g.prefix, g.size),
v AS (SELECT event_id, selected, CASE WHEN coalesce(any_value(doc), '') = '' THEN 'not_recorded' WHEN NOT json_valid(any_value(doc)) THEN 'malformed' WHEN max(copies) > 1 THEN 'duplicate'
 WHEN bool_or(coalesce(other, false)) FILTER (size < 0) THEN 'misplaced' WHEN max(copies) FILTER (size = 0) = 0 THEN 'absent' ELSE max(kind) FILTER (size = 0) END AS state, max(atom) FILTER (size = 0) AS atom FROM c GROUP BY event_id, selected)
SELECT event_id, selected, state, CASE WHEN state IN ('string', 'number', 'boolean') THEN atom END AS atom FROM v"""


@query(_GUARD_SQL)
def json_path_guards(spark: SparkSession, d: str) -> DataFrame:
    return T.guards(_stored(spark, d), "event_id", "doc", _PATHS)


@query(f"{_TREE_SQL} SELECT event_id, path, atom AS route FROM n WHERE type = 'VARCHAR' AND state IN ('value', 'item')")
def json_route_values(spark: SparkSession, d: str) -> DataFrame:
    return T.route_values(_stored(spark, d), "event_id", "doc")
