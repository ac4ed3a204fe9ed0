"""One small case for each finding that was open after round 4."""

from pyspark.sql import functions as F

from quarry.operators import dependencies as D
from quarry.plans import dependency_queries, service_queries
from quarry.sources.services import SERVICE, services


def test_service_contents_are_made_for_the_chosen_files_only(spark, tmp_path):
    rows = [(k, 1 + k * 7 % 50) for k in range(1, 4000)]
    spark.createDataFrame(rows, "p_partkey int, p_size int").repartition(3).write.parquet(f"{tmp_path}/part.parquet")
    shaped = spark.read.parquet(f"{tmp_path}/part.parquet").selectExpr(*(f"{e} AS {c}" for c, e in SERVICE.items()))
    want = shaped.join(shaped.groupBy("path").agg(F.min("file_id").alias("file_id")), ["path", "file_id"])
    found = services(spark, str(tmp_path))
    assert found.columns == want.columns == ["path", "file_id", "content"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) and found.count() < len(rows)
    traced = service_queries.handler_sinks(spark, str(tmp_path))
    assert "part.parquet" not in traced._jdf.queryExecution().toString()  # files are made once, not for each step
    assert traced.count() > 100


def test_audit_candidates_read_the_manifests_once(spark, tmp_path, monkeypatch):
    spark.range(1, 300).selectExpr("CAST(id AS INT) AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    asked, declared = [], D.declared
    monkeypatch.setattr(D, "declared", lambda *a, **k: asked.append(1) or declared(*a, **k))
    assert dependency_queries.dependency_audit_candidates(spark, str(tmp_path)).count() > 0
    assert len(asked) == 1
