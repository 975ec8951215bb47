import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from weftline.operators import verbs

NAN = float("nan")


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(1.0, 10), (1.0, 11), (2.0, 12), (None, 13), (NAN, 14)], "k double, a long")
    right = spark.createDataFrame([(1.0, 20), (3.0, 21), (None, 22), (NAN, 23)], "k double, b long")
    return left, right


@pytest.mark.parametrize("text,kind", [("inner", "inner"), ("JOIN", "inner"), ("Left Outer", "left_outer"), ("full_outer", "full_outer"), ("outer", "full_outer"), ("semi", "left_semi"), ("left anti", "left_anti"), ("cross", "cross"), ("right", "right_outer")])
def test_kinds(text, kind):
    assert verbs.parse_join_type(text) == kind


@pytest.mark.parametrize("text", ["right semi", "right_anti", "x", ""])
def test_unknown_kinds(text):
    with pytest.raises(NotImplementedError):
        verbs.parse_join_type(text)


@pytest.mark.parametrize("kind,expected", [
    ("inner", [(1.0, 10, 20), (1.0, 11, 20)]),
    ("semi", [(1.0, 10), (1.0, 11)]),
    ("anti", [(2.0, 12), (None, 13), (None, 14)]),
    ("left", [(1.0, 10, 20), (1.0, 11, 20), (2.0, 12, None), (None, 13, None), (None, 14, None)]),
    ("right", [(1.0, 10, 20), (1.0, 11, 20), (3.0, None, 21), (None, None, 22), (None, None, 23)]),
    ("full", [(1.0, 10, 20), (1.0, 11, 20), (2.0, 12, None), (None, 13, None), (None, 14, None), (3.0, None, 21), (None, None, 22), (None, None, 23)]),
])
def test_joins_never_match_null_or_nan(sides, rows, kind, expected):
    assert rows(verbs.join(*sides, kind, ["k"])) == sorted(expected, key=repr)


def test_two_keys_with_a_null_in_one(spark, rows):
    a = spark.createDataFrame([(1, None, "l"), (1, 2, "m")], "x int, y int, a string")
    b = spark.createDataFrame([(1, None, "r"), (1, 2, "s")], "x int, y int, b string")
    assert rows(verbs.join(a, b, "full", ["x", "y"])) == sorted([(1, 2, "m", "s"), (1, None, "l", None), (1, None, None, "r")], key=repr)


def test_cross_join_takes_no_keys(sides):
    a, b = sides
    assert verbs.join(a, b.toDF("k2", "b"), "cross", []).count() == 20
    for how, on in (("cross", ["k"]), ("inner", [])):
        with pytest.raises(ValueError):
            verbs.join(a, b, how, on)
    with pytest.raises(ValueError):
        verbs.join(a, b, "inner", ["b"])


def test_clashing_names_get_suffixes(spark, rows):
    a = spark.createDataFrame([(1, 2)], "k int, v int")
    assert verbs.join(a, a, "inner", ["k"]).columns == ["k", "v_x", "v_y"]
    c = spark.createDataFrame([(1, 2, 3)], "k int, v int, v_x int")
    with pytest.raises(ValueError):
        verbs.join(c, a, "inner", ["k"])
    odd = spark.createDataFrame([(1, 2)], ["a`b", "c.d"])
    assert rows(verbs.join(odd, odd, "inner", ["a`b"])) == [(1, 2, 2)]


@pytest.fixture(scope="module")
def sets(spark):
    a = spark.createDataFrame([("x", 1), ("x", 1), (None, None), (None, None), ("y", 2)], "a string, b int")
    b = spark.createDataFrame([("x", 1), (None, None), ("z", 3), ("z", 3)], "b string, a int")  # by position
    return a, b


def test_set_operations_go_by_position_and_nulls_are_equal(sets, rows):
    a, b = sets
    assert verbs.union(a, b, unique=False).columns == ["a", "b"] and verbs.union(a, b, unique=False).count() == 9
    assert rows(verbs.union(a, b, unique=True)) == sorted([("x", 1), (None, None), ("y", 2), ("z", 3)], key=repr)
    assert rows(verbs.intersect(a, b, unique=False)) == sorted([("x", 1), ("x", 1), (None, None), (None, None)], key=repr)
    assert rows(verbs.intersect(a, b, unique=True)) == sorted([("x", 1), (None, None)], key=repr)
    assert rows(verbs.except_rows(b, a, unique=False)) == [("z", 3), ("z", 3)]
    assert rows(verbs.except_rows(b, a, unique=True)) == [("z", 3)]
    assert rows(verbs.drop_duplicates(a)) == sorted([("x", 1), (None, None), ("y", 2)], key=repr)


def test_set_operations_keep_the_multiset_plans_as_hash_joins(sets):
    plan = verbs.intersect(*sets, unique=False)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_set_operations_refuse_other_arity_and_types(sets, spark):
    a, _ = sets
    for other in (spark.range(1), spark.createDataFrame([("x", "y")], "a string, b string")):
        with pytest.raises(ValueError):
            verbs.union(a, other, unique=False)


def test_nan_counts_as_null_in_sets(spark, rows):
    a = spark.createDataFrame([(NAN,), (None,), (1.0,)], "a double")
    assert rows(verbs.drop_duplicates(a)) == sorted([(None,), (1.0,)], key=repr)
    assert rows(verbs.intersect(a, spark.createDataFrame([(NAN,)], "z double"), unique=True)) == [(None,)]


def test_concat_by_name(spark, rows):
    a, b = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([("y", 2.0)], "b string, c double")
    assert rows(verbs.concat(a, b)) == sorted([(1, "x", None), (None, "y", 2.0)], key=repr)
    with pytest.raises(ValueError):
        verbs.concat()


def test_fill_default(spark, rows):
    df = spark.createDataFrame([(None, None, None, None), (NAN, "a", dt.datetime(2021, 1, 2), True)], "d double, s string, t timestamp_ntz, b boolean")
    assert rows(verbs.fill_default(df)) == sorted([(0.0, "", dt.datetime(2000, 1, 1), False), (0.0, "a", dt.datetime(2021, 1, 2), True)], key=repr)
    assert math.isnan(verbs.fill_default(df, ["s"]).where("s = 'a'").first()[0])
    with pytest.raises(ValueError):
        verbs.fill_default(df.select(F.current_date().alias("x")))


def test_rename_indicator_and_empty(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    swapped = verbs.rename(df, {"a": "b", "b": "a"})
    assert swapped.columns == ["b", "a"] and swapped.first()["b"] == 1
    assert verbs.with_indicator(df, "m", 7).first()["m"] == 7
    with pytest.raises(ValueError):
        verbs.with_indicator(df, "a")
    assert verbs.is_empty(df.where("a > 1")) and not verbs.is_empty(df)


def test_empty_sides(spark, rows):
    none, one = spark.createDataFrame([], "k int, a int"), spark.createDataFrame([(1, 2)], "k int, b int")
    assert rows(verbs.join(none, one, "full", ["k"])) == [(1, None, 2)]
    assert rows(verbs.join(none, one, "inner", ["k"])) == []
    assert rows(verbs.union(none, one, unique=True)) == [(1, 2)]
