"""Web applications made from ``customer``: views, controllers and handlers that
fetch objects by a caller's number, some guarded, near or far from the fetch.

Each customer is one file. The projection is SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.services import _pick
from quarry.sources.tables import spread, table

_K = "c_custkey"
_FILL = "repeat(concat('    x = 1', chr(10)), CAST({} AS INT))"
_KINDS = ["python", "ruby/rails", "node", "java"]
_FOLDERS = ["shop/views", "shop/models", "app/controllers", "tests/views", "lib/api", "src/util", "vendor/web"]
_STEMS = ["items", "auth", "orders_controller", "helpers", "Permissions"]
_LINES = {
    "python": {
        "open": ["def get_item(request, pk):", "def _inner(request):", "def check_item(request):", "def load(key):", "def format_item(item):", "def update_item(request):"],
        "mark": ["@login_required", "@cached", "# plain", "@permission_required('a')", "y = 2", "z = 3"],
        "fetch": ["    item = Item.objects.get(pk=request.GET['n'])", "    item = get_object_or_404(Item, name=key)", "    item = cache.get(key)", "    rows = Item.objects.filter(name=self.kwargs['n'])"],
        "guard": ["    if item.owner != request.user: raise Http404", "    validate_access(item)", "    token = Signer().unsign(raw)", "    total += 1", "    y = 2", "    z = 3"],
    },
    "ruby/rails": {
        "open": ["def show", "def initialize", "def destroy(params)", "def authorize_item", "def build_row", "def update"],
        "mark": ["before_action :authenticate_user!", "# plain", "helper :x", "before_action :load", "y = 2", "z = 3"],
        "fetch": ["    @item = Item.find(params[:id])", "    Item.find_by(name: key)", "    list.find { |x| x }", "    Order.find_by_id(params.fetch(:n))"],
        "guard": ["    authorize @item", "    current_user.items", "    OpenSSL::HMAC.digest(k, v)", "    total += 1", "    y = 2", "    z = 3"],
    },
    "node": {
        "open": ["router.get('/items', async (req, res) => {", "function load(key) {", "app.post('/orders', (req, res) => {", "const f = (a) => {", "router.delete('/x', requireAuth, h)", "function wrapper(req) {"],
        "mark": ["app.use(verifyToken)", "// plain", "let y = 2", "let z = 3", "let u = 4", "let v = 5"],
        "fetch": ["    const item = await Item.findById(req.params.id)", "    Item.findOne({ key })", "    list.find(x => x)", "    await Order.findByPk(req.body.n)"],
        "guard": ["    if (item.ownerId !== uid) return", "    checkPermission(item)", "    verifySigned(raw, salt)", "    total += 1", "    y = 2", "    z = 3"],
    },
    "java": {
        "open": ["    public Item getItem(int id) {", "    public String toString() {", "    protected void deleteItem(int id) {", "    public void requireAdmin() {", "    int hidden() {", "    public List<Item> listItems() {"],
        "mark": ["    @Authorized(\"read\")", "    @Override", "    // plain", "    @PreAuthorize(\"x\")", "    int y = 2;", "    int z = 3;"],
        "fetch": ["        return repo.findById(id);", "        return null;", "        n++;", "        m++;"],
        "guard": ["        log(id);", "        n++;", "        m++;", "        k++;", "        j++;", "        i++;"],
    },
}


def _by_kind(part: str, n: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {_pick(_LINES[k][part], n)}" for i, k in enumerate(_KINDS))
    return f"(CASE CAST({_K} % {len(_KINDS)} AS INT) {whens} END)"


def _unit(i: int) -> str:
    return (
        f"concat({_by_kind('mark', f'{_K} + c_nationkey + {i}')}, chr(10), {_FILL.format(f'({_K} * {i + 1} + c_nationkey) % 7')}, {_by_kind('open', f'{_K} * {i + 2} + c_nationkey')}, chr(10), {_FILL.format(f'({_K} + {i}) % 3 * 13 + c_nationkey % 3')}, "
        f"{_by_kind('guard', f'{_K} * 5 + c_nationkey * {i + 1}')}, chr(10), {_FILL.format(f'({_K} * {i + 3} + c_nationkey) % 28')}, {_by_kind('fetch', f'{_K} + {i}')}, chr(10), {_FILL.format(f'({_K} * 7 + {i}) % 14')}, {_by_kind('guard', f'{_K} * 11 + {i}')}, chr(10), {_FILL.format('30')})"
    )


#: Columns of a file. One in 23 has no content, one in 27 is empty.
WEBAPP = {
    "path": f"concat({_pick(_FOLDERS, f'{_K} + c_nationkey')}, '/', {_pick(_STEMS, _K)}, CASE WHEN {_K} % 5 = 0 THEN '' ELSE CAST({_K} AS STRING) END, {_pick(['.py', '.rb', '.js', '.java'], _K)})",
    "file_id": _K,
    "kind": _pick(_KINDS, _K),
    "content": f"CASE WHEN {_K} % 23 = 0 THEN NULL WHEN {_K} % 27 = 0 THEN '' ELSE concat({_unit(0)}, {_unit(1)}) END",
}
WEBAPPS_SQL = f"webapps AS (SELECT {', '.join(f'{e} AS {c}' for c, e in WEBAPP.items())} FROM customer)"


def webapps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, file_id, kind, content)``; files of different numbers may have the same path."""
    return spread(table(spark, sf_dir, "customer")).selectExpr(*(f"{e} AS {c}" for c, e in WEBAPP.items()))
