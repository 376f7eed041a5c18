"""Shared plumbing of the subpackage: Arrow batches through numpy, joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.runtime import salted_join  # noqa: F401 - used by the subpackage


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with state: make() runs once per partition and gives the function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows and (out := f(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def record(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols.values()], names=list(cols))


#: Bytes of a shuffle partition that its task reads with ease.
PARTITION = 64 << 20


def partitions(df: DataFrame, rows: int, row_bytes: int) -> int:
    """How many partitions so many rows need: those of the session, or more if they would be larger than PARTITION."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows * row_bytes // PARTITION))
