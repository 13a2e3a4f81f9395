"""Tables of blocks that ask and are answered: Arrow batches of packed rows, tables bucketed for joins."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from urlrisk.session import new_path


def batches_of(rows: Iterator[dict], schema: pa.Schema, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose binary values together take about ``limit`` bytes, or of one row."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row.values() if isinstance(v, bytes))
        if size > limit:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def save_bucketed(table: DataFrame, name: str, buckets: int, key: str) -> str:
    """Write a table bucketed by ``key`` to the shared folder; its name in the session's catalogue."""
    name = f"{name}_{uuid.uuid4().hex}"
    writer = table.write.option("path", new_path(table.sparkSession, name)).option("compression", "zstd")
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return name
