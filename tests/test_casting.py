import datetime as dt

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftline.operators import casting
from weftline.schema import Schema


def cast_one(spark, value, old, new, **options):
    df = spark.createDataFrame([(value,), (None,)], Schema(f"c:{old}").spark)
    out = [r[0] for r in df.select(casting.cast_column(F.col("c"), old, new, **options)).collect()]
    assert out[1] is None
    return out[0]


@pytest.mark.parametrize("value,old,new,expected", [
    (1.9, "double", "int", 1), (-1.9, "double", "long", -1), ("12", "str", "int", 12), (3, "int", "str", "3"), (True, "bool", "str", "true"),
    (0, "int", "bool", False), (2, "int", "bool", True), ("TRUE", "str", "bool", True), (" 0 ", "str", "bool", False),
    (200, "int", "ubyte", 200), (dt.date(2020, 1, 2), "date", "datetime", dt.datetime(2020, 1, 2)), (dt.datetime(2020, 1, 2, 3), "datetime", "date", dt.date(2020, 1, 2)),
    ("2020-01-02", "str", "date", dt.date(2020, 1, 2)), (dt.datetime(2020, 1, 2, 3), "datetime", "str", "2020-01-02 03:00:00"),
])
def test_cast_matrix(spark, value, old, new, expected):
    assert cast_one(spark, value, old, new) == expected


@pytest.mark.parametrize("value,old,new", [("x", "str", "int"), ("yes", "str", "bool"), (1e20, "double", "int"), (300, "int", "ubyte"), (-1, "int", "ulong")])
def test_faulty_casts_raise(spark, value, old, new):
    with pytest.raises(PySparkException):
        cast_one(spark, value, old, new)


def test_numbers_become_times_only_with_a_unit(spark):
    with pytest.raises(ValueError):
        casting.cast_column(F.lit(1), "int", "datetime")
    assert cast_one(spark, 86400, "long", "datetime", number_unit="s") == dt.datetime(1970, 1, 2)
    assert cast_one(spark, 86_400_000, "long", "datetime", number_unit="ms") == dt.datetime(1970, 1, 2)


def test_zones_keep_the_wall_clock(spark):
    wall = dt.datetime(2020, 7, 1, 12)
    df = spark.createDataFrame([(wall,)], "t timestamp_ntz")
    zoned = casting.cast_frame(df, "t:timestamp(us,America/New_York)")
    assert repr(Schema(zoned)) == "t:timestamp(us,America/New_York)"
    assert zoned.select(F.unix_timestamp("t")).first()[0] == int(dt.datetime(2020, 7, 1, 16, tzinfo=dt.timezone.utc).timestamp())
    assert casting.cast_frame(zoned, "t:datetime").first()[0] == wall
    assert casting.cast_frame(zoned, "t:str").first()[0] == "2020-07-01 12:00:00"
    moved = casting.cast_frame(zoned, "t:timestamp(us,Asia/Tokyo)")
    assert casting.cast_frame(moved, "t:datetime").first()[0] == dt.datetime(2020, 7, 2, 1)


def test_frames_are_cast_by_position_and_altered_by_name(spark):
    df = spark.createDataFrame([(1, "2", 3.5)], "a int, b string, c double")
    out = casting.cast_frame(df, "x:str,y:int,z:long")
    assert out.columns == ["x", "y", "z"] and tuple(out.first()) == ("1", 2, 3)
    assert casting.cast_frame(df, Schema(df)) is df and casting.alter(df, "a:int,b:str,c:double") is df
    assert tuple(casting.alter(df, "c:int,a:long").first()) == (3, 1)
    with pytest.raises(ValueError):
        casting.cast_frame(df, "x:int")
    with pytest.raises(KeyError):
        casting.alter(df, "d:int")
    with pytest.raises(KeyError):
        casting.alter_function("a:int", "d:int")
    assert tuple(casting.alter_function(Schema(df), "b:int")(df).first()) == (2,)


def test_replacing_types_in_frames(spark):
    df = spark.createDataFrame([(1, [1, 2], {"x": 3})], Schema("a:int,b:[int],c:{x:int}").spark)
    out = casting.replace_types(df, [("int", "long")])
    assert repr(Schema(out)) == "a:long,b:[long],c:{x:long}" and out.first()["b"] == [1, 2]
    assert casting.replace_types(df, [("str", "long")]) is df


def test_json_columns(spark):
    df = spark.createDataFrame([(1, '{"x": 1, "z": 2}'), (2, None), (3, '{"y": "b"}')], "a int, b string")
    out = casting.parse_json_columns(df, "b:{x:long,y:str}").orderBy("a").collect()
    assert [r["b"] and tuple(r["b"]) for r in out] == [(1, None), None, (None, "b")]
    found = casting.parse_json_columns(df, ["b"])
    assert Schema(found)["b"].kind == "struct" and found.columns == ["a", "b"]
    assert casting.parse_json_columns(df, []) is df
    with pytest.raises(ValueError):
        casting.parse_json_columns(df, ["a"])
    with pytest.raises(Exception, match="MALFORMED"):
        casting.parse_json_columns(spark.createDataFrame([("{x",)], "b string"), "b:{x:long}").collect()


def test_json_lists(spark):
    df = spark.createDataFrame([("[1,2]",), ("[]",)], "b string")
    assert [r[0] for r in casting.parse_json_columns(df, "b:[int]").collect()] == [[1, 2], []]


def test_rows_are_picked_in_order_and_nan_is_none(spark):
    df = spark.createDataFrame([(1, float("nan"))], "a int, b double")
    assert list(casting.rows_of(df, ["b", "a"])) == [[None, 1]]


def test_rows_to_native_values():
    schema = "a:int,b:str,c:bool,d:double,e:datetime,f:date,g:[int],h:{x:int},i:<str,int>,j:bytes"
    row = [1.1, True, "Yes", "nan", "2020-01-02 03:04:05", dt.datetime(2020, 1, 2, 3), "[1,2]", {"x": "3", "z": 1}, {"k": "4"}, b"x"]
    (out,) = casting.apply_schema(schema, [row], deep=True)
    assert out == [1, "True", True, None, dt.datetime(2020, 1, 2, 3, 4, 5), dt.date(2020, 1, 2), [1, 2], {"x": 3}, [("k", 4)], b"x"]
    assert list(casting.apply_schema("a:int,b:long", [[None, float("nan")]])) == [[None, None]]
    for kind, value in (("int", "1.1"), ("int", float("inf")), ("bool", "x"), ("datetime", 3), ("bytes", "x"), ("[int]", 3)):
        with pytest.raises(ValueError):
            list(casting.apply_schema(f"a:{kind}", [[value]], deep=True))
    with pytest.raises(NotImplementedError):
        list(casting.apply_schema("a:decimal(5,2)", [[1]]))


@pytest.mark.parametrize("text", ['1,"w":2', "1}", "1} garbage", "1] [1", "1 2", "", "x", '1}, {"v": 2', "1]"])
def test_text_that_is_no_single_json_value_fails(spark, text):
    with pytest.raises(Exception, match="MALFORMED"):
        casting.parse_json_columns(spark.createDataFrame([(text,)], "b string"), "b:long").collect()


def test_plain_json_values(spark):
    df = spark.createDataFrame([("1",), (" 2 ",), (None,), ("null",)], "b string")
    assert [r[0] for r in casting.parse_json_columns(df, "b:long").collect()] == [1, 2, None, None]
    assert casting.parse_json_columns(spark.createDataFrame([('"a,b}]"',)], "b string"), "b:str").first()[0] == "a,b}]"


def test_unsafe_casts_cut_whole_numbers_to_their_bits(spark):
    values = [0, 1, 127, 128, 255, 256, 300, -1, -128, -129, 65535, 1 << 31, (1 << 63) - 1, -(1 << 63)]
    df = spark.createDataFrame([(v,) for v in values], "a long")
    for kind, dtype in (("byte", "int8"), ("short", "int16"), ("int", "int32"), ("ubyte", "uint8"), ("uint", "uint32"), ("ulong", "uint64")):
        found = [int(r[0]) for r in casting.alter(df, f"a:{kind}", safe=False).collect()]
        assert found == np.array(values, np.int64).astype(dtype).tolist(), kind
        with pytest.raises(Exception, match="OVERFLOW|out of"):
            casting.alter_function("a:long", f"a:{kind}")(df).collect()
    assert casting.alter_function("a:long", "a:byte", safe=False)(df).count() == len(values)


def test_rows_in_place_and_nested_values_as_they_are():
    rows = [["1", [1.5], {"x": "3"}, [("k", 2)]]]
    schema = "a:int,b:[int],c:{x:int},d:<str,int>"
    (kept,) = casting.apply_schema(schema, rows)
    assert kept == [1, [1.5], {"x": "3"}, [("k", 2)]] and rows[0][0] == "1" and kept[1] is rows[0][1]
    (same,) = casting.apply_schema(schema, rows, copy=False, deep=True)
    assert same is rows[0] and same == [1, [1], {"x": 3}, [("k", 2)]]
    assert list(casting.apply_schema("b:[int]", [["[1]"]], deep=True)) == [[[1]]]
    for kw in ({"deep": True, "str_as_json": False}, {"deep": False}):
        with pytest.raises(ValueError):
            list(casting.apply_schema("b:[int]", [["[1]"]], **kw))
