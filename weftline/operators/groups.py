"""Functions over whole groups, with a declared result."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.verbs import nan_as_null
from weftline.schema import Schema


def group_apply(df: DataFrame, keys: list[str], func: Callable[[pd.DataFrame], pd.DataFrame], schema: Any) -> DataFrame:
    """func on each group as a pandas frame with a fresh index. Null keys form groups, and NaN keys are null ones.

    Without keys the whole frame is one group, and so one task: only for frames that fit one. The result's index is
    ignored; its columns are taken by name.
    """
    spark_schema = Schema(schema).spark

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return func(group.reset_index(drop=True))

    return nan_as_null(df, keys).groupBy(*[F.col(f"`{k}`") for k in keys]).applyInPandas(run, spark_schema) if keys else df.groupBy().applyInPandas(run, spark_schema)
