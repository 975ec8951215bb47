import datetime as dt
import uuid
from typing import List

import pytest
from pyspark.sql import functions as F

from weftline.errors import NoneArgumentError
from weftline.functions import scalars as S
from weftline.functions.hashing import to_uuid, uuid5_column


class Base:
    def __init__(self, x=0):
        self.x = x


class Derived(Base):
    pass


def some_function():
    return 1


def test_truth():
    assert [S.to_bool(x) for x in (True, "TRUE", "yes", 1, "no", 0, False)] == [True, True, True, True, False, False, False]
    for bad in (None, "x", 2, 1.5):
        with pytest.raises(TypeError):
            S.to_bool(bad)


def test_times():
    assert S.to_datetime("2020-01-02 03:04:05") == dt.datetime(2020, 1, 2, 3, 4, 5) and S.to_datetime(dt.date(2020, 1, 2)) == dt.datetime(2020, 1, 2)
    for bad in (None, 3):
        with pytest.raises(TypeError):
            S.to_datetime(bad)


@pytest.mark.parametrize("value,seconds", [(3, 3), ("3", 3), (-1.5, -1.5), ("2d1m", 2 * 86400 + 60), ("1h 5ms", 3600.005), ("01:02:03", 3723)])
def test_spans(value, seconds):
    assert S.to_timedelta(value) == dt.timedelta(seconds=seconds)


def test_ends_of_spans():
    assert S.to_timedelta("min") == S.to_timedelta(float("-inf")) == dt.timedelta.min and S.to_timedelta("inf") == dt.timedelta.max
    with pytest.raises(TypeError):
        S.to_timedelta(None)


@pytest.mark.parametrize("value,size", [(10, 10), ("10", 10), ("1k", 1024), (" 1.5 MB ", 1572864), ("2gb", 2 << 30), ("1t", 1 << 40), (1.5, 1)])
def test_sizes(value, size):
    assert S.to_size(value) == size


def test_faulty_sizes():
    for bad, error in ((None, NoneArgumentError), ("x", ValueError), ("1x", ValueError), ("", ValueError), (-1, AssertionError), ("-1k", AssertionError)):
        with pytest.raises(error):
            S.to_size(bad)


def test_as_type():
    assert S.as_type("1", int) == 1 and S.as_type("no", bool) is False and S.as_type("1h", dt.timedelta) == dt.timedelta(hours=1) and S.as_type(1, str) == "1"


def test_lookups():
    here = f"{__name__}.Derived"
    assert S.to_class("Derived", Base) is Derived and S.to_class("int") is int and S.to_class(Derived, Base) is Derived
    assert S.to_class("datetime.timedelta") is dt.timedelta
    for bad in ("Nothing", "datetime.nothing", "1+1", "os.system('x')"):
        with pytest.raises((ValueError, TypeError)):
            S.to_class(bad)
    with pytest.raises(TypeError):
        S.to_class(int, Base)
    assert S.to_instance("Derived", Base, (3,)).x == 3 and S.to_instance(Base).x == 0
    own = Base()
    assert S.to_instance(own, Base) is own
    with pytest.raises(TypeError):
        S.to_instance(own, Base, (1,))
    with pytest.raises(TypeError):
        S.to_instance(3, Base)
    assert S.to_object("v.x", {"v": Base(5)}) == 5 and S.full_path(Derived) == here and S.full_path(Base()) == f"{__name__}.Base"


def test_functions():
    assert S.to_function(some_function) is some_function and S.to_function("f", {"f": some_function}) is some_function and S.to_function("len") is len
    for bad in (Base, 3):
        with pytest.raises(AttributeError):
            S.to_function(bad)
    for bad in (None, lambda: 1):
        with pytest.raises(TypeError):
            S.full_path(bad)


def test_annotations():
    assert S.same_annotation(List[int], list[int]) and not S.same_annotation(List[int], list[int], by_origin=False)
    assert not S.same_annotation(list[int], list[str]) and S.same_annotation(int, int) and not S.same_annotation(list, list[int])


def test_caller_variables():
    inner = 5

    def ask():
        return S.caller_variables()

    found = ask()
    assert found[1]["inner"] == inner and "test_spans" in found[0]


def test_assertions():
    S.assert_or_throw(True, ValueError)
    for given, error in ((None, AssertionError), ("text", AssertionError), (ValueError, ValueError), (ValueError("x"), ValueError), (lambda: KeyError("k"), KeyError), (lambda: "text", AssertionError)):
        with pytest.raises(error):
            S.assert_or_throw(False, given)
    S.assert_not_none(0)
    with pytest.raises(NoneArgumentError):
        S.assert_not_none(None, "x")


def test_uuids():
    class Named:
        def __uuid__(self):
            return "n"

    found = [to_uuid(), to_uuid(None), to_uuid(1), to_uuid("1"), to_uuid(1, 2), to_uuid(2, 1), to_uuid([1, 2]), to_uuid([[1], 2]), to_uuid({"a": 1}), to_uuid({"a": 2}), to_uuid(Named())]
    assert len(set(found)) == len(found) and to_uuid(1, "a") == to_uuid(1, "a") and to_uuid(x for x in (1, 2)) == to_uuid([1, 2])


def test_uuid5_in_columns(spark):
    texts = ["", "a", "é中", "x" * 100]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in df.select(uuid5_column(uuid.NAMESPACE_URL, F.col("t"))).collect()]
    assert found == [str(uuid.uuid5(uuid.NAMESPACE_URL, t)) for t in texts]
