from attrloom.plans.normalize import normalize_records
from attrloom.streaming.incremental import normalize_stream

SCHEMA = "doc_id int, pos long, attribute string, value string"


def test_stream_equals_batch(spark, dictionary, tmp_path):
    rows = [(1, 0, "Order Code", "ORD-1"), (1, 1, "departmnt", "x"), (2, 0, "zzz", "q")]
    records = spark.createDataFrame(rows, SCHEMA)
    records.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = normalize_stream(stream, dictionary, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert query.awaitTermination(240)
    columns = ["doc_id", "pos", "attribute", "match_type"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()))
    assert got == sorted(map(tuple, normalize_records(records, dictionary).select(*columns).collect()))
