"""Python inside tasks, by Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes of a batch between a task and its Python worker at most.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 4096, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}

#: Rows whose texts and vectors are Python objects at a time.
SLICE = 256


def slices(batch: pa.RecordBatch, rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in parts of a few rows, so that what Python makes of them stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def streamed(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches that BATCH bounds; a session's own lower bounds stay."""
    conf = df.sparkSession.conf
    for key, most in BATCH.items():
        now = conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df.mapInArrow(run, schema)
