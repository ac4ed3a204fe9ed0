"""Source files of services made from ``part``: route tables, handlers, clients
and helpers whose functions share names, over several folders.

Each part is one file. The projection is SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import spread, table

_FOLDERS = ["svc{s}/web", "svc{s}/handlers", "svc{s}/sdk/client", "svc{s}/controller/files", "lib/isolated/run", "cmd/tool{s}", "svc{s}/routes", "svc{s}/filesystem"]
_NAMES = ["UploadFile", "RunJob", "DeleteItem", "Health", "GetIsolated", "CreateItem", "Reload"]
_ROUTES = ["/files/upload", "/jobs/run", "/items/{id}", "/health", "/isolated/files/run", "/items", "/admin/reload"]
_BODY = [
    "\\tout, err := exec.Command(\"sh\", \"-c\", cmd).Output()", "\\tos.WriteFile(name, data, 0644)", "\\tp := filepath.Join(root, name)", "\\tjson.Unmarshal(b, &v)", "\\tresp, err := http.Get(url)", "\\treturn nil", "\\tx := 1",
    "\\tb, err := os.ReadFile(p)", "\\tq.Enqueue(task)", "\\t// nothing", "\\ts.resumer.Resume(ctx)",
]
_GUARDS = ["RequireAuth(r)", "accessTokenMiddleware(r)", "s.log(r)", "if token == \"\" { return }", "s.log(r)", "checkAuth(r)", "limit(r)"]


def _pick(values: list[str], n: str) -> str:
    listed = "~".join(values).replace("'", "''").replace("\\t", "    ")
    return f"split_part('{listed}', '~', CAST(({n}) % {len(values)} + 1 AS INT))"


def _function(k: int) -> str:
    name = _pick(_NAMES, f"p_partkey * {k + 2} + p_size")
    body = ", ".join(_pick(_BODY, f"p_partkey * {i + 3} + p_size * {k + 1} + {i}") for i in range(3))
    return f"concat_ws(chr(10), concat('func (s *Server) ', {name}, '(w http.ResponseWriter, r *http.Request) {{'), concat('    ', {_pick(_GUARDS, f'p_partkey + p_size + {k}')}), {body}, '}}', '')"


def _route(k: int) -> str:
    n = f"p_partkey + {k}"
    return f"concat('r.', {_pick(['POST', 'GET', 'DELETE', 'Put'], f'p_partkey + p_size + {k}')}, '(\"', {_pick(_ROUTES, n)}, '\", ', {_pick(['', 's.', ''], f'p_size + {k}')}, {_pick(_NAMES, n)}, ')')"


def _prefixed(k: int) -> str:
    """Routes of groups, of other routers, and one that is commented out."""
    lines = ['g := r.Group("/api/")', 'g.POST("/jobs", s.RunJob)', '// r.POST("/old", Old)', 'r.Route("/agent", func(r Router) {', 'http.HandleFunc("/upload", UploadFile)', 'app.route("/rust", post(create_item))', 'http.Handle("/ping", Health)', 'g.Get("/", List)']
    return f"concat('    ', {_pick(lines, f'p_partkey * {k + 1} + p_size')})"


_ROUTE_FILE = f"concat_ws(chr(10), 'package web', 'func Register(r Router) {{', {', '.join(_route(k) for k in range(4))}, {_prefixed(0)}, {_prefixed(1)}, {_prefixed(2)}, '}}', '', {_function(0)})"
_PLAIN_FILE = f"concat_ws(chr(10), 'package work', '', {_function(0)}, {_function(1)}, {_function(2)})"
#: Columns of a file. One in 29 has no content, one in 31 is empty.
SERVICE = {
    "path": f"concat(replace({_pick(_FOLDERS, 'p_partkey + p_size')}, '{{s}}', CAST(p_size % 5 AS STRING)), '/', CASE WHEN p_partkey % 19 = 0 THEN 'router' ELSE concat('f', CAST(p_partkey % 40 AS STRING)) END, CASE WHEN p_partkey % 17 = 0 THEN '.md' ELSE '.go' END)",
    "file_id": "p_partkey",
    "content": f"CASE WHEN p_partkey % 29 = 0 THEN NULL WHEN p_partkey % 31 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN {_ROUTE_FILE} ELSE {_PLAIN_FILE} END",
}
#: Paths are files of their own: of parts with equal paths the smallest stays.
_ONE = "SELECT path, min(file_id) AS file_id FROM shaped GROUP BY path"
SERVICES_SQL = f"shaped AS (SELECT {', '.join(f'{e} AS {c}' for c, e in SERVICE.items())} FROM part), services AS (SELECT shaped.* FROM shaped JOIN ({_ONE}) o USING (path, file_id))"


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, file_id, content)``. There are some thousand paths at most, whatever
    the number of parts, so contents are made for the chosen rows only."""
    named = spread(table(spark, sf_dir, "part")).selectExpr(f"{SERVICE['path']} AS path", f"{SERVICE['file_id']} AS file_id", "p_partkey", "p_size")
    chosen = named.join(named.groupBy("path").agg(F.min("file_id").alias("file_id")), ["path", "file_id"])
    return chosen.repartition(2 * spark.sparkContext.defaultParallelism).selectExpr("path", "file_id", f"{SERVICE['content']} AS content")
