import pytest
from pyspark.sql import functions as F

from tagloom.operators.keys import key_join, key_slices, split_join
from tests.conftest import rows


def test_absent_parts_are_equal(spark):
    left = spark.createDataFrame([("D", "a", None, 1), ("D", "a", "", 2), ("D", "a", "p", 3)],
                                 "freq string, dbt string, part string, l int")
    right = spark.createDataFrame([("D", "a", None, 10), ("D", "a", "p", 30)],
                                  "freq string, dbt string, part string, r int")
    assert rows(key_join(left, right), "l", "r") == [(1, 10), (3, 30)]
    assert "CartesianProduct" not in key_join(left, right)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("known", [{}, {"left_rows": 50}, {"right_rows": 7}, {"expands": True}])
def test_split_join_equals_plain_join(spark, known):
    # one key holds a third of the rows of both sides, one is null
    left = spark.range(0, 600).selectExpr("case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else concat('k', id % 40) end as k", "id as l")
    right = spark.range(0, 90).selectExpr("case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else concat('k', id % 40) end as k", "id as r")
    plain = rows(key_join(left, right, "inner", ["k"]), "k", "l", "r")
    assert rows(split_join(left, right, ["k"], ["l"], ["r"], side=4, **known), "k", "l", "r") == plain


def test_every_big_key_is_cut(spark):
    """No number of keys is too big: all whose product is over the bound are listed, with enough slices."""
    left = spark.range(0, 30_000).selectExpr("id % 3000 as k", "id as l")
    right = spark.range(0, 12_000).selectExpr("id % 3000 as k", "id as r")
    cut = key_slices(left, right, ["k"], side=4)
    assert cut.count() == 3000
    sizes = cut.select(F.max(F.lit(10 * 4) / (F.col("_left") * F.col("_right"))).alias("most")).first()["most"]
    assert sizes <= 16
    assert split_join(left, right, ["k"], ["l"], ["r"], side=4).count() == 3000 * 10 * 4


@pytest.mark.parametrize("n,m", [(1, 10), (3, 9), (50, 2), (1000, 7), (64, 64), (5, 10_000)])
def test_slices_bound_the_product(spark, n, m):
    left = spark.range(n).selectExpr("'x' as k", "id as l")
    right = spark.range(m).selectExpr("'x' as k", "id as r")
    found = key_slices(left, right, ["k"], side=8).collect()
    grid = (found[0]["_left"], found[0]["_right"]) if found else (1, 1)
    assert -(-n // grid[0]) * -(-m // grid[1]) <= 64 + max(n // grid[0], m // grid[1])


def test_hot_key_is_spread(spark):
    left = spark.range(0, 4000).selectExpr("'hot' as k", "id as l")
    right = spark.range(0, 100).selectExpr("'hot' as k", "id as r")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = split_join(left, right, ["k"], ["l"], ["r"], side=50)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 400_000 and len(sizes) > 1 and max(sizes) < 400_000
