import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from weftline.operators import reslice as R

MAKERS = [lambda v: pa.table({"a": pa.array(v, pa.int64())}), lambda v: pa.RecordBatch.from_pydict({"a": pa.array(v, pa.int64())}), lambda v: pd.DataFrame({"a": np.array(v, "int64")}), lambda v: np.array(v, "int64")]


def values(batch):
    return batch.tolist() if isinstance(batch, np.ndarray) else batch["a"].tolist() if isinstance(batch, pd.DataFrame) else batch.column(0).to_pylist()


@pytest.mark.parametrize("make", MAKERS)
@given(lengths=st.lists(st.integers(0, 9), max_size=12), limit=st.integers(0, 7))
def test_row_limits_conserve_rows(make, lengths, limit):
    whole = list(range(sum(lengths)))
    batches, at = [], 0
    for n in lengths:
        batches.append(make(whole[at : at + n]))
        at += n
    out = [values(b) for b in R.reslice(batches, row_limit=limit)]
    assert sum(out, []) == whole and all(out)
    if limit:
        assert all(len(b) == limit for b in out[:-1]) and (not out or len(out[-1]) <= limit)
    else:
        assert [len(b) for b in out] == [n for n in lengths if n]


def test_size_limit_uses_the_mean_row():
    batches = [np.zeros(10, "int64"), np.zeros(3, "int64")]
    assert [len(b) for b in R.reslice(batches, size_limit=32)] == [4, 4, 4, 1]
    assert [len(b) for b in R.reslice(batches, size_limit="1k")] == [13]
    assert [len(b) for b in R.reslice(batches, size_limit=1)] == [1] * 13
    assert [len(b) for b in R.reslice(batches, row_limit=5, size_limit=1 << 20)] == [5, 5, 3]


def test_growing_rows_bring_the_limit_down():
    short, long = pd.DataFrame({"a": ["x"] * 50}), pd.DataFrame({"a": ["x" * 5000] * 50})
    out = list(R.reslice([short, long, long], size_limit=200_000))
    assert sum(map(len, out)) == 150 and len(out[-1]) <= 50


def test_batches_by_sorted_key():
    frames = [pd.DataFrame({"a": [0, 0, 1], "b": [None, None, 1.0]}), pd.DataFrame({"a": [], "b": []}), pd.DataFrame({"a": [1, 2], "b": [1.0, float("nan")]}), pd.DataFrame({"a": [2], "b": [None]})]
    for convert in (lambda f: f, lambda f: pa.Table.from_pandas(f.astype("float64"), preserve_index=False)):
        batches = [convert(f) for f in frames]
        assert [[len(b) if isinstance(b, pd.DataFrame) else b.num_rows for b in own] for own in R.reslice_sorted(batches, ["a", "b"])] == [[2], [1, 1], [1, 1]]
        assert [R._rows(b) for b in R.reslice_and_merge(batches, ["a", "b"])] == [2, 2, 2]
    assert list(R.reslice_sorted([], ["a"])) == []


def test_unread_keys_are_passed_over():
    batches = [pd.DataFrame({"a": [0, 0]}), pd.DataFrame({"a": [0, 1]})]
    assert [next(iter(own))["a"].iloc[0] for own in R.reslice_sorted(batches, ["a"])] == [0, 1]


def test_peekable():
    p = R.Peekable([None, 1])
    assert not p.empty and p.peek() is None and p.peek() is None and list(p) == [None, 1] and p.empty
    with pytest.raises(StopIteration):
        p.peek()


def test_slices_drain_what_is_left():
    items = [1, 1, 2, 2, 2, 3]
    assert [list(s) for s in R.slices(items, lambda n, x, last: x != last)] == [[1, 1], [2, 2, 2], [3]]
    assert [next(s) for s in R.slices(items, lambda n, x, last: x != last)] == [1, 2, 3]
    assert list(R.slices([], lambda *_: True)) == []


@pytest.mark.parametrize("kw,expected", [
    ({"row_limit": 2}, [[1, 2], [3, 9], [1]]),
    ({"sizer": int, "size_limit": 5}, [[1, 2], [3], [9], [1]]),
    ({"sizer": int, "size_limit": 100, "row_limit": 3}, [[1, 2, 3], [9, 1]]),
    ({"starts_new": lambda n, x, last: x < last}, [[1, 2, 3, 9], [1]]),
    ({"starts_new": lambda n, x, last: x == 3, "row_limit": 2}, [[1, 2], [3, 9], [1]]),
    ({}, [[1, 2, 3, 9, 1]]),
])
def test_size_and_row_slices(kw, expected):
    assert [list(s) for s in R.size_row_slices([1, 2, 3, 9, 1], **kw)] == expected


def test_a_size_limit_needs_a_sizer():
    with pytest.raises(AssertionError):
        list(R.size_row_slices([1], size_limit=3))


def test_pairs():
    assert list(R.pairs_of({"a": 1})) == [("a", 1)] and list(R.pairs_of([("a", 1)])) == [("a", 1)] and list(R.pairs_of(None)) == []
    for bad in ({"a"}, "ab", [1]):
        with pytest.raises(ValueError):
            R.pairs_of(bad)
    with pytest.raises(ValueError):
        R.pairs_of(None, none_as_empty=False)


def test_batches_in_spark(spark, rows):
    df = spark.range(0, 1000, 1, 3).selectExpr("id % 7 as k", "id as v")

    def lengths(batch):
        return pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    found = [r[0] for r in R.map_batches(df, lengths, "n:long", row_limit=100).collect()]
    assert sum(found) == 1000 and max(found) == 100

    def one(table):
        return table.slice(0, 1).append_column("n", pa.array([table.num_rows], pa.int64())).drop_columns(["v"])

    assert rows(R.merge_by_key(df, ["k"], one, "k:long,n:long")) == [(k, len(range(k, 1000, 7))) for k in range(7)]

    def total(batches):
        n = 0
        for b in batches:
            k, n = b.column(0)[0].as_py(), n + b.num_rows
        yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "n": pa.array([n], pa.int64())})

    assert rows(R.batches_by_key(df, ["k"], total, "k:long,n:long")) == [(k, len(range(k, 1000, 7))) for k in range(7)]


def test_null_and_nan_keys_are_one_group(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (None,)], "k double").repartition(3)
    one = lambda t: pa.table({"k": t["k"].slice(0, 1), "n": pa.array([t.num_rows], pa.int64())})

    def total(batches):
        own = list(batches)
        yield pa.RecordBatch.from_arrays([own[0].column(0).slice(0, 1), pa.array([sum(b.num_rows for b in own)], pa.int64())], names=["k", "n"])

    for found in (R.merge_by_key(df, ["k"], one, "k:double,n:long"), R.batches_by_key(df, ["k"], total, "k:double,n:long")):
        assert sorted((tuple(r) for r in found.collect()), key=repr) == [(1.0, 1), (None, 3)]
