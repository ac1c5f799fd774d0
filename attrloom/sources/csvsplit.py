"""CSV records with quoted line breaks, read in splits by many tasks.

Whether a line starts inside a quoted field depends on all lines before it in its file. Each line is a
function from that state to the state behind it, and a split is the composition of its lines. A first pass
finds the composition of every split of a divided file (one row each), prefix composition gives the state
every split starts in, and the second pass cuts records from there. Only records that reach over the edge of
a split are shuffled, to be put together.

A quote opens a field only at its start; behind its closing quote a field runs to the next comma. Lines end
with a line feed, alone or after a carriage return. A field that never closes takes the rest of its file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attrloom.operators.lookups import fits_broadcast
from attrloom.session import materialize

# Splits whose states are broadcast (about 40 bytes each); beyond that, splits are sent to their states.
BROADCAST_SPLITS = 500_000

_CLOSED = r'"[^"]*+(?:""[^"]*+)*+"'
_FIELD = f'(?:{_CLOSED}[^,]*+|(?!")[^,]*+)'
_OPEN = r'"[^"]*+(?:""[^"]*+)*+'
OPENS = rf"\A(?:{_FIELD},)*+{_OPEN}\z"
# From inside a field the line leaves it and may open another, or never leaves it.
STAYS_OPEN = rf'\A[^"]*+(?:""[^"]*+)*+(?:"[^,]*+(?:,{_FIELD})*+,{_OPEN})?+\z'

SPLITS = "doc_id string, start long, n_lines long, from_out boolean, from_in boolean, ends_out boolean, ends_in boolean"
PIECES = "doc_id string, start long, line_no long, whole boolean, follows boolean, text string"


def _lines(spark: SparkSession, path: str | list[str], divided_only: bool = False) -> DataFrame:
    """Lines in scan order with their split, and the state behind each line from outside and from inside."""
    raw = spark.read.text(path, lineSep="\n")
    if divided_only:
        # The size alone keeps small files from being opened.
        size = F.col("_metadata.file_size")
        raw = raw.filter((size > _smallest_split(spark)) & (F.col("_metadata.file_block_length") < size))
    return raw.withColumn("value", F.make_valid_utf8("value")).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("start"),
        (F.col("_metadata.file_block_length") < F.col("_metadata.file_size")).alias("divided"),
        F.monotonically_increasing_id().alias("seq"), "value",
        (F.contains("value", F.lit('"')) & F.col("value").rlike(OPENS)).alias("from_out"),
        (~F.contains("value", F.lit('"')) | F.col("value").rlike(STAYS_OPEN)).alias("from_in"))


def states(from_out: np.ndarray, from_in: np.ndarray, entry: bool) -> np.ndarray:
    """The state behind every line of a run that starts in ``entry``."""
    swaps = np.bitwise_xor.accumulate(from_out & ~from_in)
    fixed = np.maximum.accumulate(np.where(from_out == from_in, np.arange(len(from_out)), -1))
    return np.where(fixed >= 0, from_out[fixed] ^ swaps[fixed], entry) ^ swaps


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Stretches of a batch that belong to one split."""
    start = batch.column("start").to_numpy(zero_copy_only=False)
    doc = batch.column("doc_id").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero((np.diff(start) != 0) | (np.diff(doc) != 0)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        if high > low:
            yield batch.column("doc_id")[low].as_py(), int(start[low]), batch.slice(low, high - low)


def _flags(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(bool)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each split: the state behind it and whether a record ends in it, from either state."""
    key, held = None, None
    for batch in batches:
        for doc, start, run in _runs(batch):
            if key != (doc, start):
                if key is not None:
                    yield _summary(key, held)
                key, held = (doc, start), [0, False, True, False, False]
            for k, entry in ((1, held[1]), (2, held[2])):
                after = states(_flags(run, "from_out"), _flags(run, "from_in"), entry)
                held[k], held[k + 2] = bool(after[-1]), held[k + 2] or not after.all()
            held[0] += run.num_rows
    if key is not None:
        yield _summary(key, held)


def _summary(key: tuple, held: list) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_lines", "from_out", "from_in", "ends_out", "ends_in"]
    return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, *held)], names=names)


def _split_states(lines: DataFrame) -> DataFrame:
    """For every split of a divided file: the state it starts in, and the split in which the record open there began."""
    splits = lines.select("doc_id", "start", "from_out", "from_in").mapInArrow(_summaries, SPLITS)
    order = Window.partitionBy("doc_id").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("from_out") == F.col("from_in")
    swapped = F.sum(F.when(F.col("from_out") & ~F.col("from_in"), 1).otherwise(0))
    split = (splits.withColumn("swaps", swapped.over(order))
             .withColumn("fix", F.when(fixed, F.struct(F.col("from_out").cast("int").alias("to"), "swaps")))
             .withColumn("last_fix", F.last("fix", ignorenulls=True).over(before))
             .withColumn("swaps_before", F.coalesce(F.lag("swaps").over(order), F.lit(0))))
    moved = F.coalesce(F.col("last_fix.to") + F.col("swaps_before") - F.col("last_fix.swaps"), F.col("swaps_before"))
    entered = split.withColumn("inside", moved % 2 == 1)
    left_open = F.when(F.col("inside"), F.col("from_in")).otherwise(F.col("from_out"))
    begins = left_open & (~F.col("inside") | F.col("ends_in"))
    owner = F.last(F.when(begins, F.col("start")), ignorenulls=True).over(before)
    return entered.select("doc_id", "start", "inside", owner.alias("owner"), (F.col("inside") | left_open).alias("edge"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records, and the pieces at the edges of splits; a piece that follows another carries its first split."""
    names = ["doc_id", "start", "line_no", "whole", "follows", "text"]
    key, inside, held, line, first, home, follows, divided = None, False, [], 0, 0, 0, False, False

    def row(whole: bool) -> tuple:
        return (key[0], home if follows else key[1], key[1] if follows else first, whole, follows, "\n".join(held))

    for batch in batches:
        out = []
        for doc, start, run in _runs(batch):
            if key != (doc, start):
                if held:
                    out.append(row(not divided))
                key, inside, line, held = (doc, start), run.column("inside")[0].as_py(), 0, []
                divided, follows, home, first = run.column("divided")[0].as_py(), inside, run.column("owner")[0].as_py(), 0
            after = states(_flags(run, "from_out"), _flags(run, "from_in"), inside)
            for value, opened in zip(run.column("value").to_pylist(), after.tolist(), strict=True):
                held.append(value)
                line += 1
                if not opened:
                    out.append(row(not follows))
                    held, first, follows = [], line, False
            inside = bool(after[-1])
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, _TYPES, strict=True)], names=names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(row(not divided), _TYPES, strict=True)], names=names)


_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]


def _smallest_split(spark: SparkSession) -> int:
    """Files up to this size are never divided, whatever the number of cores."""
    conf = spark._jsparkSession.sessionState().conf()
    return min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes())


def _pieces(lines: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """Records and pieces of the splits; ``inner`` reads those in ``known`` alone."""
    if fits_broadcast(known, max_rows=BROADCAST_SPLITS):
        told = lines.join(F.broadcast(known), ["doc_id", "start"], how)
    else:
        told = lines.join(known, ["doc_id", "start"], how).repartition("doc_id", "start").sortWithinPartitions("doc_id", "start", "seq")
    lost = F.raise_error(F.lit("the files were divided differently in the second scan; set spark.sql.files.minPartitionNum")).cast("boolean")
    inside = F.coalesce("inside", F.when(F.col("divided"), lost).otherwise(F.lit(False)))
    return told.select("doc_id", "start", "divided", inside.alias("inside"), "owner", "value", "from_out", "from_in").mapInArrow(_cut, PIECES)


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw records ``(doc_id, row_no, record)`` of CSV files; ``row_no`` orders the records of a file.

    Files larger than a split are scanned twice, and once more where records reach over the edge of a split, for
    the splits concerned. All scans must divide a file alike; if the settings or the cores of the cluster changed
    in between so that they do not, the job ends with an error. ``spark.sql.files.minPartitionNum`` fixes the division.
    """
    lines = _lines(spark, path)
    known = materialize(_split_states(_lines(spark, path, divided_only=True)), "csv-splits")
    # A split has no more lines than bytes, so split and line number make one increasing number.
    row_no = (F.col("start") * (1 << 16) + F.col("line_no")).alias("row_no")
    whole = _pieces(lines, known, "left").filter("whole").select("doc_id", row_no, F.col("text").alias("record"))
    edges = known.filter("edge")
    if edges.isEmpty():
        return whole
    parts = (_pieces(lines, edges, "inner").filter("NOT whole").groupBy("doc_id", "start")
             .agg(F.max(F.when(~F.col("follows"), F.col("line_no"))).alias("line_no"),
                  F.sort_array(F.collect_list(F.struct("follows", "line_no", "text"))).alias("parts")))
    joined = parts.select("doc_id", row_no, F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("record"))
    return whole.unionByName(joined)
