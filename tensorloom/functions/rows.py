"""Arrow columns made row by row, with few of them as Python values at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows that are packed together, and bytes of them at most.
CHUNK_ROWS, CHUNK_BYTES = 256, 4 << 20


def give_back() -> None:
    """Hand freed memory back to the system: a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def packed_rows(column: pa.Array, f: Callable, to: pa.DataType) -> pa.Array:
    """f of each value that is not null, in chunks that are packed as soon as they are full."""
    chunks, now, held = [], [], 0
    for x in column:
        y = f(x) if x.is_valid else None
        now.append(y)
        held += 0 if y is None else getattr(y, "nbytes", None) or len(y)
        if len(now) >= CHUNK_ROWS or held >= CHUNK_BYTES:
            chunks.append(pa.array(now, to))
            now, held = [], 0
    chunks.append(pa.array(now, to))
    out = pa.concat_arrays(chunks)
    del chunks, now
    give_back()
    return out


def runs(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """Each run of rows that are the same in the first ``width`` columns: those, and the other columns whole."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        new = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:width]]))
        starts = np.flatnonzero(new).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(c[a].item() if isinstance(c[a], np.generic) else c[a] for c in columns[:width])
            if key != now:
                if now is not None:
                    yield now, [np.concatenate(x) for x in zip(*held, strict=True)]
                now, held = key, []
            held.append([c[a:b] for c in columns[width:]])
    if now is not None:
        yield now, [np.concatenate(x) for x in zip(*held, strict=True)]


#: Rows of a batch where each may be a long text, instead of Spark's default.
TEXT_ROWS = "1000"


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound the rows of a batch for long texts; a bound that the session sets itself stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, TEXT_ROWS)
    return spark
