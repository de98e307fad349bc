"""What the corpus operators share: reading tables and walking Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute available
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python helper takes at once; longer batches are cut between documents.
SLICE_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece holds about `limit` bytes of text, or one document if that is longer."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null gives no bytes."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
