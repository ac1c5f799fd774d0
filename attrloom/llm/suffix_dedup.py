"""Exact substring de-duplication with a logarithmic family of sparse suffix arrays.

A batch of documents gets a suffix array over sampled suffixes. The sample follows the text alone: of every
``LENGTH`` byte window, the position of its least ``GRAM`` byte hash (the leftmost of equals) is an anchor, so equal windows
have their anchors at equal places. The suffixes that start at anchors are kept sorted by the hash of their
first ``GRAM`` bytes, which brings suffixes with a common beginning together. A batch is merge-scanned against
itself and every level of the family; a long match shows as an anchor hash that occurs twice. Levels of equal
size merge, so n batches are held in at most log n levels. Levels are bucketed, sorted tables: scans and
merges of equal buckets need no exchange.

Anchors that repeat are resolved exactly. An anchor stands for the run of windows that have it as their
anchor; if the whole run's bytes (compared by a 64-bit hash) occur at two anchors, all its windows are
duplicates. Where an anchor hash comes with several different runs, one copy of each run is compared window by
window. Removed bytes are the union of all duplicate windows, judged on the input.

Defined results: null and empty texts have no bytes; texts shorter than ``LENGTH`` lose nothing; equal rows
duplicate each other; null or repeated ids are told apart by a row number; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrloom.llm.common import doc_texts, record_batch, row_blocks, table
from attrloom.llm.components import cut

LENGTH, GRAM = 200, 32
#: Text bytes a task hashes at once, and a longer text is cut into overlapping stretches of.
STRETCH = 2 << 20
POSITION_BITS = 24
BATCHES = 4
#: Different runs of one anchor hash that are compared in one task; more of them are compared by a shuffle of their windows.
GROUP_RUNS = 1 << 16

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MULTIPLIER
    return x ^ (x >> np.uint64(29))


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            tables = [np.full(size, base, dtype=np.uint64) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
            for powers in tables:
                powers[0] = 1
            self.up, self.down = (np.cumprod(powers, dtype=np.uint64) for powers in tables)
        return self.up[:n], self.down[:n]


_POWERS = Powers()
_BYTE = _scrambled(_scrambled(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER))


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` bytes."""
    up, down = _POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    return _scrambled(_scrambled((sums[width:] - sums[:-width]) * down[:len(data) - width + 1]))


def least_of_next(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    span = 1
    out = values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor runs of documents laid end to end: hash, anchor, first window, last window.

    ``starts`` are the documents' offsets and the total length. Windows lie inside one document.
    """
    if len(data) < length:
        return (np.zeros(0, dtype=np.uint64), *(np.zeros(0, dtype=np.int64),) * 3)
    hashes = rolling(data, gram)
    mask = np.uint64((1 << POSITION_BITS) - 1)
    least = least_of_next((hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
    at = (least & mask).astype(np.int64)
    crossing = np.zeros(len(at) + 1, dtype=np.int32)
    for stop in starts[1:-1]:  # windows that start in the length - 1 bytes before a document's end cross it
        crossing[min(max(0, stop - length + 1), len(at))] += 1
        crossing[min(stop, len(at))] -= 1
    valid = np.cumsum(crossing[:-1]) == 0
    change = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])]))
    last = np.append(change[1:], len(at)) - 1
    keep = valid[change]
    first, last = change[keep], last[keep]
    return hashes[at[first]], at[first], first, last


RUN_SCHEMA = pa.schema([("key", pa.int64()), ("run", pa.int64()), ("doc", pa.int64()), ("first", pa.int64()), ("n_windows", pa.int32()), ("shift", pa.int32())])
RUN_DDL = "key long, run long, doc long, first long, n_windows int, shift int"


def suffixes(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The sampled suffixes of ``(doc, text)``: anchor hash, hash of its run, document, first window of the run,
    number of windows, and the anchor's distance from the first window."""
    def stretches(batch):
        held, size = [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            data = text.as_buffer()
            for at in range(0, max(1, len(data) - length + 1), STRETCH):
                part = data[at:at + STRETCH + length - 1]
                if len(part) < length:
                    continue
                if size and size + len(part) > STRETCH:
                    yield held
                    held, size = [], 0
                held.append((doc, at, part))
                size += len(part)
        if held:
            yield held

    def run(batches):
        for batch in row_blocks(batches):
            for held in stretches(batch):
                joined = b"".join(p for _, _, p in held)
                starts = np.cumsum([0, *(len(p) for _, _, p in held)])
                key, at, first, last = anchors(np.frombuffer(joined, dtype=np.uint8), starts, length, gram)
                owner = np.searchsorted(starts, first, "right") - 1
                docs_, offsets = np.array([d for d, _, _ in held], dtype=np.int64), np.array([o for _, o, _ in held], dtype=np.int64)
                view = memoryview(joined)
                runs = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)), np.uint64, len(first))
                yield record_batch(RUN_SCHEMA, [key.view(np.int64), (runs + (at - first).astype(np.uint64)).view(np.int64), docs_[owner],
                                                first - starts[owner] + offsets[owner], (last - first + 1).astype(np.int32), (at - first).astype(np.int32)])

    return docs.select("doc", "text").mapInArrow(run, RUN_DDL)


class SuffixIndex:
    """The levels. ``add`` takes a batch and tells which anchor hashes have turned out to repeat with it."""

    def __init__(self, spark: SparkSession, length: int = LENGTH, gram: int = GRAM, buckets: int | None = None):
        self.spark, self.length, self.gram = spark, length, gram
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, str]] = []  # (merge rank, table), oldest and largest first

    def _store(self, rows: DataFrame) -> str:
        name = f"suffixes_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, "key").sortWithinPartitions("key")
         .write.bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name))
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def add(self, docs: DataFrame, merge: bool = True) -> DataFrame:
        """Index a batch ``(doc, text)``. Returns the hashes (``key``) it repeats, in itself or in a level."""
        batch = self._store(suffixes(docs, self.length, self.gram))
        own = self.spark.table(batch)
        found = own.groupBy("key").count().filter("count > 1").select("key")
        for _, level in self.levels:
            found = found.unionByName(own.select("key").join(self.spark.table(level).select("key"), "key", "left_semi"))
        found = cut(found.distinct())
        self.levels.append((0, batch))
        while merge and len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((rank + 1, self._store(self.spark.table(a).unionByName(self.spark.table(b)))))
            self._drop(a), self._drop(b)
        return found

    def matching(self, keys: DataFrame) -> DataFrame:
        """All indexed suffixes whose hash is in ``keys``."""
        out = None
        for _, level in self.levels:
            rows = self.spark.table(level).join(keys, "key", "left_semi")
            out = rows if out is None else out.unionByName(rows)
        return out

    def close(self) -> None:
        for _, level in self.levels:
            self._drop(level)
        self.levels = []


def with_text(docs: DataFrame, per_doc: DataFrame, how: str) -> DataFrame:
    """``(doc_id, doc, packed text)`` joined with one row per document (``doc``, ``parts``) by a shuffle on the document;
    the texts are packed for it."""
    schema = pa.schema([("doc_id", pa.int64()), ("doc", pa.int64()), ("text", pa.binary())])

    def pack(batches):
        packer = zstandard.ZstdCompressor(level=3, write_checksum=False)
        for batch in row_blocks(batches):
            yield record_batch(schema, [batch.column(0), batch.column(1), [packer.compress(x.as_buffer()) for x in batch.column(2).cast(pa.binary())]])

    packed = docs.select("doc_id", "doc", "text").mapInArrow(pack, "doc_id long, doc long, text binary")
    side = per_doc.withColumnRenamed("doc", "_doc")
    return packed.join(side.hint("merge"), F.col("doc") == F.col("_doc"), how).drop("_doc")


CONTEXT_SCHEMA = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("first", pa.int64()), ("n_windows", pa.int32()), ("shift", pa.int32()), ("bytes", pa.binary())])
SPAN_SCHEMA = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
SPAN_DDL = "doc long, start long, end long"


def window_hashes(runs: list[bytes], counts: np.ndarray, shifts: np.ndarray, length: int) -> np.ndarray:
    """A hash of every window of the runs, one after the other; windows of different distance to the anchor differ."""
    data = np.frombuffer(b"".join(runs), dtype=np.uint8)
    begin = np.cumsum([0, *map(len, runs)])[:-1]
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    distance = np.repeat(shifts, counts) - inside
    return _scrambled(rolling(data, length)[np.repeat(begin, counts) + inside] + distance.astype(np.uint64) * _MULTIPLIER)


def compare_runs(length: int):
    """Spans of the windows that occur in several runs of one hash; rows come sorted by hash."""
    def solve(rows: pa.Table) -> pa.RecordBatch:
        key, doc, first, counts, shifts = (rows.column(k).to_numpy() for k in range(5))
        counts, shifts = counts.astype(np.int64), shifts.astype(np.int64)
        hashes = window_hashes(rows.column(5).to_pylist(), counts, shifts, length) ^ np.repeat(key.view(np.uint64) * _MULTIPLIER, counts)
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        same = ranked[1:] == ranked[:-1]
        double = np.zeros(len(hashes), dtype=bool)
        double[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        owner = np.repeat(np.arange(len(key)), counts)
        edge = np.flatnonzero(np.concatenate([[True], (double[1:] != double[:-1]) | (owner[1:] != owner[:-1])])) if len(double) else np.zeros(0, dtype=np.int64)
        stop = np.append(edge[1:], len(double))
        edge, stop = edge[double[edge]], stop[double[edge]]
        base = first[owner[edge]] - (np.cumsum(counts) - counts)[owner[edge]]
        return record_batch(SPAN_SCHEMA, [doc[owner[edge]], edge + base, stop - 1 + base + length])

    def run(batches):
        rest = None
        for batch in row_blocks(batches, "bytes", 4 << 20):
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            keys = rows.column(0).to_numpy()
            whole = np.flatnonzero(keys != keys[-1])
            if len(whole):
                yield solve(rows.slice(0, int(whole[-1]) + 1))
                rows = rows.slice(int(whole[-1]) + 1)
            rest = rows
        if rest is not None and rest.num_rows:
            yield solve(rest)

    return run


def explode_windows(length: int):
    schema = pa.schema([("window", pa.int64()), ("key", pa.int64()), ("doc", pa.int64()), ("start", pa.int64())])

    def run(batches):
        for batch in row_blocks(batches, "bytes", 1 << 20):
            key, doc, first, counts, shifts = (batch.column(k).to_numpy() for k in range(5))
            counts = counts.astype(np.int64)
            hashes = window_hashes(batch.column(5).to_pylist(), counts, shifts.astype(np.int64), length)
            inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            yield record_batch(schema, [hashes.view(np.int64), np.repeat(key, counts), np.repeat(doc, counts), np.repeat(first, counts) + inside])

    return run


def duplicate_spans(index: SuffixIndex, docs: DataFrame, keys: DataFrame, group_runs: int = GROUP_RUNS) -> DataFrame:
    """``(doc, start, end)`` stretches whose every window occurs elsewhere; they may overlap."""
    length = index.length
    rows = cut(index.matching(keys))
    runs = cut(rows.groupBy("key", "run").agg(F.count("*").alias("n"), F.min(F.struct("doc", "first", "n_windows", "shift")).alias("at")))
    several = runs.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    whole = (rows.join(runs.filter("n > 1").select("key", "run"), ["key", "run"], "left_semi")
             .select("doc", F.col("first").alias("start"), (F.col("first") + F.col("n_windows") - 1 + length).alias("end")))
    parts = cut(runs.join(several, "key").groupBy("at.doc").agg(
        F.collect_list(F.struct("key", "at.first", "at.n_windows", "at.shift", "m")).alias("parts")))
    schema = CONTEXT_SCHEMA.append(pa.field("m", pa.int64()))

    def contexts(batches):
        for batch in row_blocks(batches):
            out = []
            for doc, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = zstandard.decompress(text)
                out += [(p["key"], doc, p["first"], p["n_windows"], p["shift"], data[p["first"]:p["first"] + p["n_windows"] - 1 + length], p["m"]) for p in wanted]
            if out:
                yield record_batch(schema, list(zip(*out, strict=True)))

    columns = "key long, doc long, first long, n_windows int, shift int, bytes binary"
    found = with_text(docs, parts, "inner").select("doc", "text", "parts").mapInArrow(contexts, f"{columns}, m long")
    hot = several.filter(F.col("m") > group_runs)
    if hot.isEmpty():
        return whole.unionByName(found.drop("m").repartition("key").sortWithinPartitions("key").mapInArrow(compare_runs(length), SPAN_DDL))
    found = cut(found)
    plain = found.filter(F.col("m") <= group_runs).drop("m").repartition("key").sortWithinPartitions("key").mapInArrow(compare_runs(length), SPAN_DDL)
    windows = found.filter(F.col("m") > group_runs).drop("m").mapInArrow(explode_windows(length), "window long, key long, doc long, start long")
    double = windows.groupBy("window", "key").count().filter("count > 1").select("window", "key")
    spread = windows.join(double, ["window", "key"], "left_semi").select("doc", "start", (F.col("start") + length).alias("end"))
    return whole.unionByName(plain).unionByName(spread)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


RESULT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                           ("kept", pa.binary())])
RESULT_DDL = "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, group_runs: int = GROUP_RUNS) -> DataFrame:
    """Per document: its bytes' number, the removed stretches, and what is left."""
    spark = docs.sparkSession
    plain = doc_texts(docs).select(F.col("doc_id").cast("long"), "text")
    ids = plain.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if ids[0] == ids[1]:
        plain = plain.withColumn("doc", F.col("doc_id"))
    else:  # numbers are stable once they are written
        plain = cut(plain.withColumn("doc", F.monotonically_increasing_id()))
    index, keys = SuffixIndex(spark, length, gram), None
    for number in range(batches):
        found = index.add(plain.filter(F.pmod(F.xxhash64("doc"), F.lit(batches)) == number), merge=number < batches - 1)
        keys = found if keys is None else keys.unionByName(found)
    spans = duplicate_spans(index, plain, keys.distinct(), group_runs)
    per_doc = cut(spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("parts")))
    index.close()

    def finish(batches):
        for batch in row_blocks(batches):
            out = []
            for doc, text, parts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = zstandard.decompress(text)
                cuts = merged([(p["start"], p["end"]) for p in parts or []])
                ends = [0, *(b for _, b in cuts)]
                kept = b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in cuts), len(data)], strict=True))
                out.append((doc, len(data), [{"start": a, "end": b} for a, b in cuts], kept))
            yield record_batch(RESULT_SCHEMA, list(zip(*out, strict=True)))

    return with_text(plain, per_doc, "left").select("doc_id", "text", "parts").mapInArrow(finish, RESULT_DDL)


def op1_suffix_dedup(spark, folder: str) -> DataFrame:
    found = remove_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                        F.sha2(F.col("kept"), 256).alias("kept_sha256"))
