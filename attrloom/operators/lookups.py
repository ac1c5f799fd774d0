"""Joins of a large table with a one-row-per-key side, and first-row-per-key without a hot task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrloom.session import materialize

# At most this many heavy keys are broadcast; any other key then holds less than 1/HEAVY_KEYS of the rows.
HEAVY_KEYS = 1024
SPREAD = 4096

# A stored table is broadcast up to this many rows and stored bytes.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20


def _hashable(df: DataFrame) -> list[Column]:
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return [F.col(f"`{name}`") for name in plain]


def stored_bytes(df: DataFrame) -> int:
    """Size of a stored table by its files, as the optimizer knows it; no job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def fits_broadcast(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> bool:
    """Whether a stored table is small enough to send to every executor, by its row count (from the file
    footers) and its stored size."""
    if stored_bytes(df) > (BROADCAST_BYTES if max_bytes is None else max_bytes):
        return False
    return df.count() <= (BROADCAST_ROWS if max_rows is None else max_rows)


def if_few(stored: DataFrame) -> DataFrame:
    """A stored table for a join, to be sent to every executor where it is small enough."""
    return F.broadcast(stored) if fits_broadcast(stored) else stored


def join_per_key(big: DataFrame, side: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Left join ``big`` with ``side`` (unique on ``keys``) when a few keys may hold most rows.

    ``weight`` is a column of ``side`` with the number of ``big`` rows of each key; it is not part of
    the result. The side is written to the shared folder first, since its true size decides: small
    enough, it is broadcast; otherwise the heavy keys are split off.
    """
    side = materialize(side, "join-side")
    if fits_broadcast(side):
        payload = [c for c in side.columns if c not in keys and c != weight]
        joined = big.join(F.broadcast(side.drop(weight)), keys, "left")
        return joined.select(*[F.col(f"`{c}`") for c in [*big.columns, *payload]])
    return join_heavy_split(big, side, keys, weight)


def join_heavy_split(big: DataFrame, side: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """The large-side way of ``join_per_key``.

    The HEAVY_KEYS heaviest keys are joined by a broadcast of exactly that bounded size. Their rows
    then go through the second join under spread-out keys that match nothing, so no shuffle task of
    that join receives a heavy key.
    """
    payload = [c for c in side.columns if c not in keys and c != weight]
    heavy = (side.orderBy(F.desc(weight), *keys).limit(HEAVY_KEYS)
             .select(*keys, F.struct(*payload).alias("_heavy")))
    spread = F.when(F.col("_heavy").isNull(), F.lit(0)).otherwise(
        F.lit(1) + F.pmod(F.xxhash64(*_hashable(big)), F.lit(SPREAD)).cast("int"))
    probed = big.join(F.broadcast(heavy), keys, "left").withColumn("_spread", spread)
    rest = side.select(*keys, F.struct(*payload).alias("_rest"), F.lit(0).alias("_spread"))
    joined = probed.join(rest, [*keys, "_spread"], "left")
    found = F.coalesce("_heavy", "_rest")
    return joined.select(*[F.col(f"`{c}`") for c in big.columns], *[found[p].alias(p) for p in payload])


def first_per_key(df: DataFrame, keys: list[Column], order: Column | str) -> DataFrame:
    """The row with the smallest ``order`` for every key.

    An aggregate rather than a ranking window: duplicates collapse on the map side, so a key that
    holds a third of all rows reaches the reducer as one row per map task.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    best = df.groupBy(*named).agg(F.min_by(row, order).alias("_row"))
    return best.select("_row.*")
