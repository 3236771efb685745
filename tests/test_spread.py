"""The join that most index frames start with has a task for each partition of the session, whatever its size on the wire."""

from pyspark.sql import functions as F

from fleetlens.catalog import load
from fleetlens.catalog.registry import Tables


def test_lines_meet_orders_in_all_partitions(spark):
    load()
    tables = Tables(spark, "/root/testdata/sf0.01")
    met = tables.sql("SELECT l_orderkey, l_linenumber, spark_partition_id() AS task FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
    found = met.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(found) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(r.n for r in found) == spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").count()
