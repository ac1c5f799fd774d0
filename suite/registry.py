"""Registry of the runnable queries: each is a Spark function and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrloom.operators.records import unpivot_table
from attrloom.session import configure
from attrloom.sources.tables import read_table

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the parquet tables of one folder, and SQL over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return read_table(self.spark, f"{self.folder}/{name}.parquet")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Spark SQL with ``{table}`` placeholders."""
        used = {t: getattr(self, t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used, **frames)


def order_records(t: Tables) -> DataFrame:
    """Orders unpivoted to records ``(doc_id, pos, attribute, value)`` in one scan."""
    return unpivot_table(t.orders, "o_orderkey", {
        "o_orderkey": F.col("o_orderkey"), "o_custkey": F.col("o_custkey"), "o_orderstatus": F.col("o_orderstatus"),
        "o_totalprice": F.col("o_totalprice").cast("decimal(18,2)"), "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "o_orderpriority": F.col("o_orderpriority")})


def case(name: str, oracle: str | None = None):
    """Register a query; the function gets a ``Tables``."""
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register
