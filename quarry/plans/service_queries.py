"""Routes, handlers, authorisation and trust over the services' files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import authz as A
from quarry.operators import handlers as H
from quarry.operators import trust as U
from quarry.plans.registry import query
from quarry.sources import text as X
from quarry.sources.scratch import saved
from quarry.sources.services import SERVICES_SQL, services
from quarry.sources.webapps import WEBAPPS_SQL, webapps

_LINES_SQL = f"{SERVICES_SQL}, ls AS (SELECT path, content, string_split(content, chr(10)) AS l FROM services WHERE content IS NOT NULL), lines AS (SELECT path, unnest(range(len(l))) + 1 AS line, unnest(l) AS t FROM ls)"
_ROUTE = r"""\.(GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete)\(\s*["'']([^"'']+)["'']\s*,\s*([A-Za-z_][A-Za-z0-9_.]*)"""
_ROUTES_SQL = f"routes AS (SELECT path AS route_file, line::INT AS route_line, upper(regexp_extract(t, '{_ROUTE}', 1)) AS method, regexp_extract(t, '{_ROUTE}', 2) AS route, regexp_extract(regexp_extract(t, '{_ROUTE}', 3), '([^.]*)$', 1) AS handler FROM lines WHERE regexp_matches(t, '{_ROUTE}'))"
_SINKS_SQL = ", ".join("({}, '{}', {}::DOUBLE, '{}')".format(i, k, c, p.replace("'", "''")) for i, (k, c, p) in enumerate(H.SINKS))
_HAS = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_BODIES_SQL = rf"""opened AS (SELECT path, line, regexp_extract(t, '{H.OPENING['.go']}', 1) AS name FROM lines WHERE path LIKE '%.go' AND regexp_matches(t, '{H.OPENING['.go']}')),
ends AS (SELECT o.path, o.line, o.name, coalesce(min(s.line), 1000000000) AS stop FROM opened o LEFT JOIN (SELECT path, line FROM lines WHERE regexp_matches(t, '{H.STOP}')) s ON s.path = o.path AND s.line >= o.line + 4 WHERE o.name NOT IN ('if', 'for', 'switch', 'return', 'var', 'type') GROUP BY ALL),
bodies AS (SELECT e.name, e.path AS file, e.line, array_to_string(ls.l[e.line:least(e.line + 181 - 1, e.stop - 1)], chr(10)) AS body FROM ends e JOIN ls USING (path)),
sinks(i, kind, cvss, pattern) AS (VALUES {_SINKS_SQL})"""
_SCORE = f"""(CASE WHEN file = route_file THEN 120 ELSE 0 END + CASE WHEN regexp_replace(file, '/?[^/]*$', '') = regexp_replace(route_file, '/?[^/]*$', '') THEN 50 ELSE 0 END
 + 8 * len(list_filter(list_zip(string_split(file, '/'), string_split(route_file, '/'), true), lambda z: z[1] = z[2])) - CASE WHEN {_HAS('lower(file)', H.AWAY)} THEN 90 ELSE 0 END + CASE WHEN {_HAS('lower(file)', H.HOME)} THEN 30 ELSE 0 END
 + CASE WHEN contains(lower(route), 'isolated') AND contains(lower(file), 'isolated') THEN 45 ELSE 0 END
 + CASE WHEN contains(lower(route), '/files/') AND NOT contains(lower(route), 'isolated') AND contains(lower(file), 'filesystem') AND NOT contains(lower(file), 'isolated') THEN 45 ELSE 0 END
 + CASE WHEN contains(lower(route), 'upload') AND contains(lower(file), 'upload') THEN 20 ELSE 0 END)"""
_NEAR_SQL = f"""WITH {_LINES_SQL}, {_ROUTES_SQL}, {_BODIES_SQL},
near AS (SELECT route_file, route, handler, file, line, body, {_SCORE} AS affinity, row_number() OVER (PARTITION BY route_file, route, handler ORDER BY {_SCORE} DESC, file, line) AS rank
 FROM (SELECT DISTINCT route_file, route, handler FROM routes) r JOIN bodies b ON b.name = r.handler QUALIFY rank <= {H.MOST_BODIES})"""
#: The same with whole bodies: handler_bodies returns none, handler_sinks reads them.
_WHOLE_SQL = _NEAR_SQL.replace("least(e.line + 181 - 1, e.stop - 1)", "e.stop - 1")


@query(f"{_NEAR_SQL} SELECT route_file, route, handler, file, line::INT AS line, affinity::INT AS affinity, rank::INT AS rank FROM near")
def handler_bodies(spark: SparkSession, d: str) -> DataFrame:
    files = saved(services(spark, d))  # read once for the routes, and for the bodies
    routes = X.routes(files).select(F.col("path").alias("route_file"), "route", F.regexp_extract("handler", r"([^.]*)$", 1).alias("handler"))
    return H.nearest_bodies(routes, H.functions(files).select("name", "file", "line")).drop("name")


@query(rf"""{_WHOLE_SQL},
hits AS (SELECT route_file, route, handler, rank, 0 AS kind_of, i, kind, cvss, file || ':' || (line + len(string_split_regex(body, pattern)[1]) - len(replace(string_split_regex(body, pattern)[1], chr(10), ''))) AS spot FROM near JOIN sinks ON regexp_matches(body, pattern)
 UNION ALL SELECT route_file, route, handler, rank, 1, i, kind, cvss, file || ':' || (1 + len(string_split_regex(w.content, pattern)[1]) - len(replace(string_split_regex(w.content, pattern)[1], chr(10), '')))
 FROM near JOIN ls w ON w.path = file JOIN sinks ON regexp_matches(w.content, pattern) WHERE (contains(lower(file), 'controller') OR contains(lower(file), '/handlers/')) AND NOT contains(lower(file), '/routes/')),
firsts AS (SELECT *, row_number() OVER (PARTITION BY route_file, route, handler, kind ORDER BY rank, kind_of, i) AS n FROM hits QUALIFY n = 1),
lists AS (SELECT route_file, route, handler, string_agg(kind || '@' || spot, ',' ORDER BY rank, kind_of, i) AS sinks, arg_min(kind, (rank, kind_of, i)) AS primary_sink, arg_min(cvss, (rank, kind_of, i)) AS cvss, bool_or(kind IN ({", ".join(f"'{k}'" for k in H.HIGH)})) AS high FROM firsts GROUP BY ALL)
SELECT r.route_file, r.route_line, r.method, r.route, r.handler, n.file AS handler_file, n.line::INT AS handler_line, coalesce(l.sinks, '') AS sinks, coalesce(l.primary_sink, '') AS primary_sink, coalesce(l.cvss, 0) AS cvss, coalesce(l.high, false) AS high
FROM routes r LEFT JOIN near n ON n.rank = 1 AND n.route_file = r.route_file AND n.route = r.route AND n.handler = r.handler LEFT JOIN lists l ON l.route_file = r.route_file AND l.route = r.route AND l.handler = r.handler""")
def handler_sinks(spark: SparkSession, d: str) -> DataFrame:
    files = saved(services(spark, d))  # read once for the routes, and for the bodies
    return H.traced(X.routes(files), files)


_APP_LINES_SQL = f"{WEBAPPS_SQL}, app_lines AS (SELECT file_id, path, kind, content, unnest(range(len(l))) + 1 AS line, unnest(l) AS t FROM (SELECT *, string_split(content, chr(10)) AS l FROM webapps WHERE content IS NOT NULL))"
_KIND = lambda make, of: "CASE kind " + " ".join(f"WHEN '{k}' THEN ({make(v)})" for k, v in of.items()) + " ELSE false END"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_MATCH = lambda p: "regexp_matches(t, '{}')".format(p.replace("'", "''"))


@query(f"""WITH {_APP_LINES_SQL}, l AS (SELECT file_id, path, line, {_KIND(_MATCH, A.FETCH)} AS fetch, {_KIND(lambda w: _HAS('lower(t)', w), A.INPUT)} AS given, {_KIND(lambda w: _HAS('lower(t)', w), A.CHECKS)} OR {_HAS('lower(t)', A.SIGNED)} AS checked,
 CASE WHEN contains(t, 'def ') OR contains(t, 'function') OR regexp_matches(t, '=>\\s*\\{{|\\)\\s*=>') THEN {_KIND(lambda w: f"contains(lower(t), '{w}')", A.REQUEST)} END AS asks
 FROM app_lines WHERE kind IN ('python', 'ruby/rails', 'node') AND NOT list_has_any(string_split(lower(path), '/'), {_LIST(A.NO_HANDLERS)}) AND {_HAS('lower(content)', A.HINTS)}),
h AS (SELECT f.file_id, f.path, f.line, list_has_any(string_split(lower(f.path), '/'), {_LIST(A.HANDLERS)}) OR contains(lower(regexp_extract(f.path, '([^/]*)$', 1)), 'controller')
 OR coalesce((SELECT arg_max(x.asks, x.line) FROM l x WHERE x.file_id = f.file_id AND x.line BETWEEN f.line - 29 AND f.line AND x.asks IS NOT NULL), false) AS in_handler
 FROM l f WHERE f.fetch AND EXISTS (SELECT 1 FROM l x WHERE x.file_id = f.file_id AND x.given AND x.line BETWEEN f.line - 2 AND f.line + 2) AND NOT EXISTS (SELECT 1 FROM l x WHERE x.file_id = f.file_id AND x.checked AND x.line BETWEEN f.line - 25 AND f.line + 11))
SELECT file_id, path, line::INT AS line, in_handler, CASE WHEN in_handler THEN 7.5 ELSE 5.5 END::DOUBLE AS cvss, CASE WHEN in_handler THEN 'high' ELSE 'low' END AS confidence FROM h""")
def unchecked_object_fetches(spark: SparkSession, d: str) -> DataFrame:
    return A.unchecked_fetches(webapps(spark, d), ["file_id"])


@query(rf"""WITH {_APP_LINES_SQL}, l AS (SELECT file_id, path, line, {_KIND(lambda v: _MATCH(v[0]), A.GUARD)} AS guard, CASE kind {" ".join("WHEN '{}' THEN regexp_extract(t, '{}', 1)".format(k, v[1].replace("'", "''")) for k, v in A.GUARD.items())} END AS name
 FROM app_lines WHERE NOT list_has_any(string_split(path, '/')[:-2], {_LIST(A.UNSEEN)}) AND lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '')) NOT IN ({_LIST(A.GUARD_FILES)[1:-1]})),
m AS (SELECT *, EXISTS (SELECT 1 FROM l x WHERE x.file_id = l.file_id AND x.guard AND x.line BETWEEN l.line - 5 AND l.line) AS guarded FROM l WHERE name <> ''),
s AS (SELECT file_id, array_to_string(list_sort(list(DISTINCT name))[:3], ',') AS siblings FROM m WHERE guarded GROUP BY file_id)
SELECT file_id, path, line::INT AS line, name, siblings FROM m JOIN s USING (file_id) WHERE NOT guarded AND name NOT IN ({_LIST(A.NO_ENDPOINTS)[1:-1]}) AND lower(name) NOT IN ({_LIST(A.NO_ENDPOINTS_LOWER)[1:-1]}) AND NOT regexp_matches(name, '{A.NO_ENDPOINT}')""")
def unguarded_methods(spark: SparkSession, d: str) -> DataFrame:
    return A.unguarded_methods(webapps(spark, d), ["file_id"])


_G = lambda p: "'" + p.replace("'", "''") + "'"
_REGISTERED_SQL = rf"""{_LINES_SQL}, fl AS (SELECT path, regexp_matches(content, {_G(U.GATE)}) AS gate, regexp_matches(content, {_G(U.OPEN)}) OR regexp_matches(content, {_G(U.NO_TOKEN)}) AS opened, regexp_extract_all(content, {_G(U.GROUP)}, 1) AS gn, regexp_extract_all(content, {_G(U.GROUP)}, 2) AS gp,
 list_transform(regexp_extract_all(content, {_G(U.PREFIX)}, 1), lambda p: rtrim(p, '/')) AS prefixes FROM ls),
cl AS (SELECT path, line, t FROM lines WHERE NOT regexp_matches(trim(t), '^(?://|#|--)')),
rr AS (SELECT path, line, 'm' AS k, t, unnest(regexp_extract_all(t, {_G(U.ROUTE)}, 1)) AS a, unnest(regexp_extract_all(t, {_G(U.ROUTE)}, 2)) AS b, unnest(regexp_extract_all(t, {_G(U.ROUTE)}, 3)) AS raw FROM cl
 UNION ALL SELECT path, line, 'c', t, NULL, unnest(regexp_extract_all(t, {_G(U.CHAINED)}, 2)), unnest(regexp_extract_all(t, {_G(U.CHAINED)}, 1)) FROM cl UNION ALL SELECT path, line, 'h', t, NULL, NULL, unnest(regexp_extract_all(t, {_G(U.HANDLE)}, 1)) FROM cl),
px AS (SELECT rr.*, gate, opened, CASE WHEN k = 'm' THEN coalesce(nullif(rtrim(list_reverse(list_transform(list_filter(list_zip(gn, gp), lambda z: z[1] = a), lambda z: z[2]))[1], '/'), ''), CASE WHEN len(prefixes) > 0 AND len(list_filter(prefixes, lambda p: starts_with(raw, p))) = 0 THEN prefixes[1] END, '') ELSE '' END AS prefix,
 lower(raw || ' ' || regexp_extract(t, ',\s*(?:[A-Za-z_]\w*\.)*([A-Z]\w+)\s*\)?\s*$', 1)) AS said FROM rr JOIN fl USING (path)),
reg AS (SELECT path, min(line)::INT AS line, CASE WHEN k = 'h' THEN CASE WHEN NOT {_HAS('said', U.TELLS)} AND {_HAS('said', U.CHANGES)} THEN 'POST' ELSE 'ANY' END ELSE upper(b) END AS method, regexp_replace(CASE WHEN raw = '/' THEN coalesce(nullif(prefix, ''), '/') ELSE prefix || raw END, '/{{2,}}', '/', 'g') AS route, gate, opened FROM px GROUP BY ALL),
one AS (SELECT path, min(line) AS line, method, route, gate, opened FROM reg GROUP BY ALL)"""


@query(f"""WITH {_REGISTERED_SQL}, v AS (SELECT *, CASE WHEN method NOT IN ('POST', 'PUT', 'PATCH', 'DELETE') THEN 1 WHEN opened THEN 2 WHEN NOT gate AND {_HAS('lower(path)', U.ROUTERS)} THEN 3 WHEN gate THEN 4 ELSE 5 END AS n FROM one)
SELECT path, line, method, route, gate, opened, (['harmless', 'open', 'open', 'guarded', 'unknown'])[n] AS verdict, (['reads only', 'fail-open middleware', 'no auth middleware in route file', 'middleware in route file', 'no evidence'])[n] AS rule FROM v""")
def route_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return U.verdicts(U.registered(services(spark, d)))
