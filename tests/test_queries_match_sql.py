"""Every registered query of the core library against its SQL, at the smallest scale."""

import decimal
import math
import os
from collections import Counter

import duckdb
import pytest

from quarry.plans import catalog

SMALL = "/root/testdata/sf0.001"
#: Queries whose rows at this scale are none, for want of data.
MAY_BE_EMPTY = {"backward_reach", "findings_keyset_page", "nearest_sources", "duplicate_active_jobs", "token_jaccard", "token_jaccard_all", "resource_level_changes", "tool_gain", "cross_file_taint", "expired_leases", "truth_assignment", "repos_without_job"}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    df = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    got = Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name in catalog.ORACLE_SQL:
        answer = sql.execute(catalog.ORACLE_SQL[name])
        at = [[d[0] for d in answer.description].index(c) for c in columns]
        assert got == Counter(repr([plain(r[i]) for i in at]) for r in answer.fetchall())
    assert got or name in MAY_BE_EMPTY, "no rows: nothing is shown"
