"""Small helpers the operators share: tables, row blocks of bounded size, digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
#: Bytes at which a batch for a Python worker ends. The default bounds its rows (10,000) and 64 MB only, and a task holds a batch several times.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Let the batches that go to Python workers end by their bytes, too."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def doc_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone; a null text is the empty text."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def row_blocks(batches: Iterator[pa.RecordBatch], column: str = "text",
               max_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``max_bytes`` of ``column`` each; one row may be larger."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, n in enumerate(lengths):
            if row > start and held + n > max_bytes:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema)
