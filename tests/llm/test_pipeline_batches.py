"""Stages of the pipeline get batches bounded by bytes."""

import corpus_pipeline
from attrloom.llm.common import BATCH_BYTES


def test_a_stage_bounds_the_bytes_of_its_batches(spark, tmp_path):
    spark.createDataFrame([(1, "ten words that no document of this small test ever holds")], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('word and ', 1200) AS text").coalesce(1)

    def sizes(batches):
        import pyarrow as pa
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "bytes": [batch.nbytes]})

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    kept = corpus_pipeline.STAGES[2][1](spark, docs, str(tmp_path))
    found = kept.mapInArrow(sizes, "n long, bytes long").collect() + docs.mapInArrow(sizes, "n long, bytes long").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert sum(r["n"] for r in found) == 6000 and max(r["bytes"] for r in found) < 1.5 * BATCH_BYTES
