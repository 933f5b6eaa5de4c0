"""Arrow batches of long texts, cut so that a worker's memory depends neither on the rows of a batch nor on the table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text that are Python strings at a time, and rows of a batch on its way to a worker.
SLICE_BYTES, BATCH_ROWS = 1 << 20, 500


def lean(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch to ``BATCH_ROWS`` for this session, so that neither side of a worker's pipe holds many texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``SLICE_BYTES`` in the column at ``text``, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(ends):
        upto = (ends[start - 1] if start else 0) + SLICE_BYTES
        stop = max(start + 1, int(np.searchsorted(ends, upto, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()
