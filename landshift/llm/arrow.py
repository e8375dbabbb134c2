"""Arrow batches as numpy byte buffers, in slices of bounded size."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 18
#: Bytes of an Arrow batch on its way to Python; Spark's own default is sixteen times as much.
BATCH_BYTES = 4 << 20
#: Slices after which freed memory goes back to the system.
RELEASE_AFTER = 16


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in batches of a few megabytes, so that long texts don't pile up on both sides.

    The size is a setting of the session and stays set, as it is read when the job starts.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    if int(re.sub(r"\D", "", conf.get(name)) or 0) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(lean, schema)


def release() -> None:
    """Gives memory that numpy and Arrow have freed back to the system; a worker outlives many tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of at most ``limit`` bytes of text each; a longer text is a slice of its own."""
    done = 0
    for batch in batches:
        ends = offsets(batch.column(column))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop
            done += 1
            if done % RELEASE_AFTER == 0:
                release()


def offsets(col: pa.Array) -> np.ndarray:
    """Byte offsets (rows + 1) of a string or binary array into its data buffer."""
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    size = np.dtype(kind).itemsize
    if len(col) == 0:
        return np.zeros(1, np.int64)
    return np.frombuffer(col.buffers()[1], kind, len(col) + 1, col.offset * size).astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts on end and the rows + 1 offsets into them; a null is empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    at = offsets(col)
    data = col.buffers()[2]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])), at - at[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, on end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def segment_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments that end at ``ends`` (empty segments give 0)."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return np.diff(total[np.concatenate([[0], ends])], axis=0)


def fresh(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it (names are compared without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
