"""Tables of few row groups are spread over the cores however many splits their files have."""

from pyspark.sql import functions as F

from attrloom.sources import tables


def test_empty_splits_do_not_count(spark, tmp_path):
    path = str(tmp_path / "one.parquet")
    spark.range(20000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32768")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        scan = spark.read.parquet(path)
        cores = spark.sparkContext.defaultParallelism
        assert scan.rdd.getNumPartitions() >= cores and tables.filled_tasks(scan, cores) == 1
        rows = tables.read_table(spark, path).groupBy(F.spark_partition_id()).count().collect()
        assert len(rows) == cores and max(r["count"] for r in rows) < 10000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
