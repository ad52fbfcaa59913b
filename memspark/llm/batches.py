"""Small helpers for operators that work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut, run_dir, shared_dir, spread  # noqa: F401  (general helpers, re-exported to the operators)

#: Bytes of text that a task works on at a time; a single longer text is worked on alone.
PIECE_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(rows, their texts as UTF-8) in runs of about ``limit`` bytes; a null text is empty."""
    for batch in batches:
        data = [x or b"" for x in batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()]
        start = size = 0
        for i, x in enumerate(data):
            size += len(x)
            if size >= limit:
                yield batch.slice(start, i + 1 - start), data[start:i + 1]
                start, size = i + 1, 0
        if start < len(data):
            yield batch.slice(start), data[start:]


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names, so that no other column can clash."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
