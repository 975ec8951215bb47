"""Arrow tables and batches, as tasks get them, to pandas and to rows."""

from __future__ import annotations

from typing import Any

import pandas as pd
import pyarrow as pa

#: pandas' own nullable types of Arrow's plain ones.
NULLABLE = {
    pa.bool_(): pd.BooleanDtype(), pa.string(): pd.StringDtype(), pa.float32(): pd.Float32Dtype(), pa.float64(): pd.Float64Dtype(),
    pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype(),
    pa.uint8(): pd.UInt8Dtype(), pa.uint16(): pd.UInt16Dtype(), pa.uint32(): pd.UInt32Dtype(), pa.uint64(): pd.UInt64Dtype(),
}


def batch_to_pandas(data: pa.RecordBatch | pa.Table, use_extension_types: bool = False, use_arrow_dtype: bool = False, **kwargs: Any) -> pd.DataFrame:
    """A pandas frame with numpy's types or, where asked for, pandas' nullable ones, Arrow's own, or Arrow's where pandas has none."""

    def dtype(kind: pa.DataType) -> Any:
        nullable = NULLABLE.get(kind) if use_extension_types else None
        return pd.ArrowDtype(kind) if nullable is None and use_arrow_dtype else nullable

    return data.to_pandas(types_mapper=dtype, **kwargs)


def table_to_pandas(table: pa.Table, use_extension_types: bool = False, use_arrow_dtype: bool = False, **kwargs: Any) -> pd.DataFrame:
    """As batch_to_pandas; the rows are numbered through, and an empty table keeps its types."""
    return batch_to_pandas(table, use_extension_types, use_arrow_dtype, **kwargs)


def batch_to_dicts(batch: pa.RecordBatch | pa.Table) -> list[dict[str, Any]]:
    return batch.to_pylist()
