"""Helpers shared by the training-data operators: table access, Arrow batches, storage for cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from voxloom.plans.fixpoint import shared_base

#: Bytes of text that a kernel handles at once; a single longer text is handled alone.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share, under spark.checkpoint.dir."""
    return f"{shared_base(spark)}/voxloom-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str, folder: str | None = None, packed: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors.  Values that are
    ``packed`` already are stored as they are: a codec would hold pages of many MB in buffers outside the heap."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{kind}"
    writer = df.write.mode("overwrite")
    (writer.option("compression", "none") if packed else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch where the texts of ``column`` reach ``limit`` bytes, so that memory follows bytes and not rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text, without decoding; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list]], schema: str | StructType, size_by: str, limit: int = SLICE_BYTES) -> DataFrame:
    """``df.mapInArrow`` for a row-wise kernel: ``fn`` gets slices of bounded bytes, and returns columns."""
    ddl = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    out = to_arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size_by, limit):
                got = fn(part)
                yield pa.RecordBatch.from_arrays([x if isinstance(x := got[f.name], pa.Array) else pa.array(x, f.type) for f in out], schema=out)

    return df.mapInArrow(run, ddl)
