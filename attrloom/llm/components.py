"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrloom.session import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder, so that the plan starts anew and survives lost executors."""
    df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def _down(links: DataFrame) -> DataFrame:
    """Links from the larger to the smaller id, once each."""
    return (links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())


def components(links: DataFrame) -> DataFrame:
    """``(u, v)`` links to ``(id, component)``: for every linked id but the smallest of its component, that smallest id.

    Every step sends each id's smallest neighbour along its links. Minima are combined before the
    shuffle; a hot id is split by the skew join. The number of rounds grows with the logarithm of the longest
    chain.
    """
    links = cut(_down(links))
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = _down(both.join(least, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        joined = large.join(least, F.col("u") == F.col("k"))
        small = cut(_down(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))))
        state = [d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for d in (links, small)]
        links = small
        if state[0] == state[1]:
            return links.select(F.col("u").alias("id"), F.col("v").alias("component"))
