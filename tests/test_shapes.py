"""What stands for a shape of indexes is short, and copies still come back one by one."""

from pyspark.sql import functions as F

from fleetlens.operators import index_catalog as ic


def test_shapes_travel_as_sixteen_bytes(spark):
    rows = [(1, i, None, 2, False, [1], [], [1]) for i in (2, 3)] + [(1, i, None, 2, False, [1, 2], [], [1, 2]) for i in (4, 5)]
    lists = spark.createDataFrame(rows, "object_id bigint, index_id bigint, filter_definition string, type int, is_unique boolean, key_columns array<bigint>, include_columns array<bigint>, all_columns array<bigint>")
    shapes, _ = ic._shapes(lists)
    assert [r[0] for r in shapes.select(F.octet_length("index_id")).collect()] == [16, 16]
    found = {(r.index_id, r.covered_index_id, r.covered_key_columns) for r in ic.covered_indexes(lists).collect()}
    assert found == {(p, c, "1") for p in (4, 5) for c in (2, 3)}
