"""Work of the registered queries is dealt over the cores, and pipelines that a filter leaves out do not run."""

from pyspark.sql import functions as F

from maskweave.operators import scan_iac as si
from maskweave.plans import common


def test_tables_of_one_row_group_are_dealt(spark, tmp_path):
    rows = "id AS l_orderkey, id % 7 AS l_linenumber, id % 9 AS l_partkey, id % 5 AS l_suppkey"
    spark.range(400).selectExpr(*rows.split(", ")).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(400).selectExpr("id AS o_orderkey", "id % 9 AS o_custkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    for df in (common.loglines(spark, str(tmp_path)), common.iac_files(spark, str(tmp_path))):
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 4 and df.count() == 400


def test_filter_on_source_runs_one_pipeline(spark):
    files = spark.createDataFrame([(1, "a.tf", "ami-01234567"), (2, "b.txt", "ami-89abcdef"), (3, None, "ami-01234567")], "k long, name string, content string")
    rules = si.scan_iac(files, ["k"], "name", "content")
    assert sorted((r.k, r.source) for r in rules.collect()) == [(1, "terraform"), (2, "generic"), (3, "generic")]
    plan = rules.filter("source = 'generic'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "BUCKET_NAME" not in plan
