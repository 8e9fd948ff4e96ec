"""Row-wise work on Arrow batches in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column`` (string or binary) has about ``limit`` bytes in each part."""
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n) + 64
    yield batch.slice(start)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str | StructType, column: str,
               setup: Callable | None = None, limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over slices: ``fn(slice)`` (or ``fn(slice, state)`` with ``setup``)
    returns the output columns by name, in the order of ``schema``."""
    target = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(target)
        state = setup() if setup else None
        for batch in batches:
            for part in slices(batch, column, limit):
                cols = fn(part, state) if setup else fn(part)
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type)
                     for x, f in ((cols[f.name], f) for f in out)], schema=out)

    return df.mapInArrow(run, target)
