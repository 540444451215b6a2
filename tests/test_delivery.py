"""Redelivered messages."""

from pyspark.sql import functions as F

from fernweave.operators import delivery

SCHEMA = "row_id long, key string, t long, arrived long, _copy string"


def order():
    return [F.col("t").desc_nulls_last(), F.col("arrived").asc_nulls_last(), F.col("row_id").asc()]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_one_copy_stays_and_the_rest_is_dropped(spark):
    rows = frame(spark, [(1, "a", 5, 1, "x"), (2, "a", 7, 3, "x"), (3, "a", 7, 2, "x"), (4, "b", None, 1, "x"), (5, "b", 1, 9, "x"), (6, None, 1, 1, "x")])
    kept = delivery.first_copies(rows, ["key"], order())
    assert sorted(r.row_id for r in kept.collect()) == [3, 5, 6]
    assert kept.columns == rows.columns
    assert sorted(r.row_id for r in delivery.repeated_copies(rows, ["key"], order(), "row_id").collect()) == [1, 2, 4]


def test_ties_and_repeated_rows(spark):
    rows = frame(spark, [(1, "a", 1, 1, None), (1, "a", 1, 1, None), (2, "a", 1, 1, None)])
    assert [r.row_id for r in delivery.first_copies(rows, ["key"], order()).collect()] == [1]
    assert sorted(r.row_id for r in delivery.repeated_copies(rows, ["key"], order(), "row_id").collect()) == [1, 2]


def test_empty_table(spark):
    rows = frame(spark, [])
    assert delivery.first_copies(rows, ["key"], order()).count() == 0
    assert delivery.repeated_copies(rows, ["key"], order(), "row_id").count() == 0


def test_new_messages_skip_stored_keys(spark):
    stored = frame(spark, [(1, "a", 1, 1, None), (2, None, 1, 1, None)])
    batch = frame(spark, [(3, "a", 2, 2, None), (4, "b", 1, 1, None), (5, "b", 2, 2, None), (6, None, 1, 1, None)])
    found = delivery.new_messages(stored, batch, ["key"], order()).collect()
    assert [r.row_id for r in found] == [5]


def test_a_hot_key_is_cut_before_the_shuffle(spark):
    rows = frame(spark, [(i, "hot" if i % 3 else f"k{i}", i, i, None) for i in range(300)])
    plan = delivery.first_copies(rows, ["key"], order())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert delivery.repeated_copies(rows, ["key"], order(), "row_id").count() == 199
