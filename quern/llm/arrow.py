"""Small helpers shared by the Arrow functions of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Text bytes that an Arrow function holds as Python strings at once.
SLICE_BYTES = 2_000_000


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows whose texts come to about ``limit`` bytes.

    A single longer text forms a slice of its own.
    """
    for batch in batches:
        n, start = batch.num_rows, 0
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        while start < n:
            end, held = start + 1, sizes[start]
            while end < n and held + sizes[end] <= limit:
                held += sizes[end]
                end += 1
            yield batch.slice(start, end - start)
            start = end


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch as strings; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def emit(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def spark_ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean", pa.float64(): "double"}
    one = lambda t: f"array<{one(t.value_type)}>" if pa.types.is_list(t) else kinds[t]
    return ", ".join(f"`{f.name}` {one(f.type)}" for f in schema)
