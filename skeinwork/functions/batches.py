"""Arrow batches of texts: their size, and lists of lists as columns."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch; Spark's own numbers (10,000 and 64 MB) of whole texts take many times the memory.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches at BATCH_ROWS and BATCH_BYTES, unless the session has numbers of its own."""
    for name, usual, ours in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        # Without a default of ours: with one, None is returned where the session has set nothing.
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(ours))


def offsets(lengths: Iterable[int] | np.ndarray) -> pa.Array:
    """Offsets of lists of these lengths that lie one behind the other."""
    n = np.asarray(lengths if isinstance(lengths, np.ndarray) else list(lengths), dtype=np.int64)
    return pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.int32())


def flat(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """All elements of a column of lists, one behind the other."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays([c.flatten() for c in whole.chunks]) if isinstance(whole, pa.ChunkedArray) else whole.flatten()
