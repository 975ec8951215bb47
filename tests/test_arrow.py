import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from weftline.functions.arrow import batch_to_dicts, batch_to_pandas, table_to_pandas

SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.string()), ("c", pa.list_(pa.int32())), ("d", pa.timestamp("us"))])
ROWS = [{"a": 1, "b": "x", "c": [1, 2], "d": None}, {"a": None, "b": None, "c": None, "d": None}]


def test_batches_to_rows():
    assert batch_to_dicts(pa.RecordBatch.from_pylist(ROWS, SCHEMA)) == ROWS
    assert batch_to_dicts(pa.RecordBatch.from_pylist([], SCHEMA)) == []


@pytest.mark.parametrize("rows", [ROWS, []])
def test_types_of_frames(rows):
    batch = pa.RecordBatch.from_pylist(rows, SCHEMA)
    for data, made in ((batch, batch_to_pandas), (pa.Table.from_batches([batch]), table_to_pandas)):
        plain = made(data)
        assert list(plain.columns) == SCHEMA.names and len(plain) == len(rows) and plain["d"].dtype.kind == "M"
        own = made(data, use_extension_types=True)
        assert own["a"].dtype == pd.Int64Dtype() and own["b"].dtype == pd.StringDtype() and own["c"].dtype == np.dtype(object)
        arrow = made(data, use_arrow_dtype=True)
        assert [str(t) for t in arrow.dtypes] == [str(pd.ArrowDtype(t)) for t in SCHEMA.types]
        both = made(data, use_extension_types=True, use_arrow_dtype=True)
        assert both["a"].dtype == pd.Int64Dtype() and both["c"].dtype == pd.ArrowDtype(SCHEMA.field("c").type)


def test_rows_of_several_batches_are_numbered_through():
    table = pa.Table.from_batches([pa.RecordBatch.from_pylist(ROWS, SCHEMA)] * 3)
    assert list(table_to_pandas(table).index) == list(range(6)) and len(table_to_pandas(table, ignore_metadata=True)) == 6
