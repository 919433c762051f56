"""What a kernel of op 10 holds for each token, and how its packed tables are stored."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from voxloom.llm import katz
from voxloom.llm.common import written


def test_bytes_a_token():
    """A block's pairs take less than 48 bytes a token at the peak (before: 77)."""
    rng, n, types = np.random.default_rng(0), 200_000, 20_000
    lengths, tokens = np.full(n // 100, 100, "<i4"), (rng.zipf(1.3, n) % types).astype("<i4")
    row = {"held": [False] * len(lengths), "lengths": katz.squeeze(lengths), "words": katz.squeeze(rng.integers(0, 1 << 63, types).astype("<u8")), "tokens": katz.squeeze(tokens)}
    tracemalloc.start()
    try:
        b = katz.Block(row)
        b.find_pairs()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 48 * n
    before = np.append(types, tokens[:-1])
    before[::100] = types
    assert (b.first[b.pair] == before).all() and (b.second[b.pair] == tokens).all() and len(b.keys) == len(set(zip(before.tolist(), tokens.tolist())))


def test_packed_tables_have_no_codec(spark):
    found = written(spark.range(3).coalesce(1).select(F.col("id").cast("string").cast("binary").alias("b")), "packed", packed=True)
    files = found.inputFiles()
    assert files and all(pq.ParquetFile(f.removeprefix("file://")).metadata.row_group(0).column(0).compression == "UNCOMPRESSED" for f in files)
