"""Runs NumPy kernels over groups of rows with Arrow."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

Columns = dict[str, np.ndarray]


#: Rows that a task gets where tasks follow the input.
TASK_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt out by its keys to as many tasks as its ``rows`` need, so that none holds more on larger inputs;
    partitions with a number of their own are not merged."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return df.repartition(parts, *keys)


def grouped(df: DataFrame, keys: list[str], kernel: Callable[[Columns], dict], schema: str) -> DataFrame:
    """``kernel`` gets a group's columns as arrays (nulls of numbers as NaN) and returns columns; key columns that it
    leaves out are repeated.  What a group holds must be bounded: a component, a block, a pencil, a face, a skeleton."""
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(table: pa.Table) -> pa.Table:
        columns = {n: table.column(n).to_numpy() for n in table.column_names}
        got = kernel(columns)
        rows = next((len(v) for k, v in got.items() if k not in keys), 0)
        for k in keys:
            if k in out.names and k not in got:
                got[k] = [table.column(k)[0].as_py()] * rows
        return pa.table([pa.array(got[f.name], f.type) for f in out], schema=out)

    # groups cost time rather than bytes, so their partitions must not be merged for being small
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys).groupBy(*keys).applyInArrow(run, schema)


def box_of(c: Columns) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, least corner) of a group's voxels."""
    at = np.stack([c["x"], c["y"], c["z"]], axis=1).astype(np.int64)
    return at, at.min(axis=0)
