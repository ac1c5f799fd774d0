"""Arriving documents: the batch plans applied to each micro-batch.

Matching needs the distinct names of a batch, so records are normalized per micro-batch with the same
functions as a table. A document is complete when it arrives, so no state but the name mapping is worth
keeping: with a ``MappingStore`` a name is matched in the first batch that brings it and looked up in all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from attrloom.plans.mappings import MappingStore
from attrloom.plans.normalize import normalize_records
from attrloom.sources.dictionary import Dictionary


def normalize_stream(records: DataFrame, dictionary: Dictionary, path: str, checkpoint: str, store: MappingStore | None = None,
                     **options) -> StreamingQuery:
    """Append the normalized records of a stream to ``path``, one ``batch`` folder per micro-batch.

    The folder of a batch is overwritten when the batch is retried, so a retry leaves each record once. With a
    ``store`` the thresholds are those of the store.
    """
    if store is not None and (options or store.dictionary is not dictionary):
        raise ValueError("dictionary and thresholds belong to the store")

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        mapping = store.extend(kept) if store is not None else None
        normalize_records(kept, dictionary, mapping=mapping, **options).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        kept.unpersist()

    return (records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
