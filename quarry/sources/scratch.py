"""Tables that cut lineage, in a folder that the driver and all executors share.

The folder is the application's own and goes when the driver's Python ends;
``scratch()`` deletes what was written within it at once.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}
_tables: list[DataFrame] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration() if spark._jsc is None else spark._jsc.hadoopConfiguration()).delete(p, True)


def folder(spark: SparkSession) -> str:
    """This application's own folder where the driver and every executor see it.

    It lies in the one that the cluster names in ``spark.checkpoint.dir``. Only a
    local session without that setting gets a temporary folder. What is in it
    goes when the driver's Python ends, or by ``release()``.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _folders[app] = f"{(named or tempfile.mkdtemp(prefix='quarry-')).rstrip('/')}/quarry-{app}"
        atexit.register(release, spark, app)
    return _folders[app]


def release(spark: SparkSession, app: str | None = None) -> None:
    """Delete all tables of ``saved()`` that this application has left."""
    path = _folders.pop(app or spark.sparkContext.applicationId, None)
    _tables.clear()
    if path:
        with suppress(Exception):  # the JVM may have ended before
            _delete(spark, path)


def saved(df: DataFrame, *, sort: list[str] | None = None, large_rows: bool = False) -> DataFrame:
    """``df`` written once and read back: later steps don't compute it again, and a lost executor takes nothing along.

    ``large_rows``: rows of megabytes. Parquet holds a group of rows whole when it
    is written, and Spark when it is read; it first looks at their size after 100
    rows unless told otherwise. Here a group ends at about 16 MB."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    out = (df.sortWithinPartitions(*sort) if sort else df).write
    if large_rows:
        out = out.option("parquet.block.size", 16 << 20).option("parquet.page.size.row.check.min", 1).option("parquet.page.size.row.check.max", 8)
    out.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    _tables.append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``saved()`` that nothing reads any more. Other tables are left alone."""
    for df in tables:
        path = getattr(df, "_saved_at", None)
        if path:
            _delete(df.sparkSession, path)
            _tables[:] = [t for t in _tables if t._saved_at != path]


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """On leaving, the tables saved inside go, but for those in the list."""
    kept: list[DataFrame] = []
    before = {t._saved_at for t in _tables}
    yield kept
    before |= {t._saved_at for t in kept}
    dropped(*(t for t in list(_tables) if t._saved_at not in before))
