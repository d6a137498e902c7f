"""Numbers of rows in an order against a window over all of them."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chatterlake.operators.ranking import numbered


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_numbers_follow_the_order(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        rows = spark.range(500).selectExpr("id", "nullif(id % 7, 3) AS a", "repeat('x', cast(id % 5 AS int)) AS number")
        order = [F.desc_nulls_last("a"), F.asc("number"), F.asc("id")]
        want = rows.withColumn("at", F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
        got = numbered(rows, *order, into="at")
        assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(map(tuple, want.collect()), key=lambda r: r[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_one_key_in_all_rows(spark):
    rows = numbered(spark.range(300).selectExpr("1 AS same"), "same").collect()
    assert sorted(r.number for r in rows) == list(range(300))
    assert numbered(spark.range(0), "id").count() == 0
