"""Hard negatives by exact inner products with Four-Russians look-up tables.

Components become integers, and a row's integers are stored as packed bit planes: for every plane one bit of
each component, eight components to a byte. For an anchor, every group of eight dimensions has a table of
the 256 sums its subsets of components can have. A candidate's byte of a plane picks one entry, so a score is a few
look-ups per plane, shifted and added; the top plane counts negatively (two's complement). Scores are exact.

Anchors and rows meet in tiles: anchors are dealt into blocks of bounded size, rows into groups, and every tile is one
task that holds its anchor block and lets its rows stream past. A first pass keeps the best rows of the anchor's
label, a second the best rows of other labels inside each positive's window. Both hand on a few rows per anchor and
group of rows; the number of groups follows the cores, not the rows, until groups reach ``GROUP_ROWS``.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part, nor do rows without
``vec_id``, which could not be named or ordered. A row is never its own positive; a repeated row is a row of its own, as an
anchor too. Vectors of different lengths count as padded with zeros. No anchors, or one label only, give no rows.
Components so large that a score might not fit 63 bits end with an error rather than a wrong score. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrloom.llm.common import record_batch, table
from attrloom.session import materialize

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies between these percentages of the positive's.
WINDOW = (50, 95)

#: Anchors in a tile (held in memory, about 0.5 KB each) and rows in a group (streamed).
BLOCK_ANCHORS = 1 << 16
GROUP_ROWS = 1 << 24
#: Anchors whose look-up tables exist at a time (8 KB each for 64 dimensions), and rows scored at a time.
TABLE_ANCHORS = 256
CHUNK_ROWS = 1024

LEAST = np.iinfo(np.int64).min


def quantized(vectors: DataFrame, anchor_every: int, relabel_every: int, labels: int) -> DataFrame:
    """``uid, id, label, values`` of the rows that take part."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col("label").cast("long")
    return (vectors.select("vec_id", "label", "embedding").filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(~odd)
            .select(F.col("vec_id").cast("long").alias("id"),
                    F.when(F.col("vec_id") % relabel_every == 0, (label + 1) % labels).otherwise(label).alias("label"),
                    (F.col("vec_id") % anchor_every == 0).alias("is_anchor"),
                    F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("values"))
            .withColumn("uid", F.monotonically_increasing_id()))


def pack_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """Integers (rows, dimensions) to bytes (rows, planes, groups of eight dimensions)."""
    rows, width = values.shape
    groups = -(-width // 8)
    out = np.empty((rows, planes, groups), dtype=np.uint8)
    for plane in range(planes):
        out[:, plane] = np.packbits((values >> plane & 1).astype(np.uint8), axis=1, bitorder="little")
    return out


def unpack_planes(packed: np.ndarray) -> np.ndarray:
    """The integers back, dimensions padded to whole groups."""
    rows, planes, groups = packed.shape
    values = np.zeros((rows, groups * 8), dtype=np.int64)
    for plane in range(planes):
        bits = np.unpackbits(np.ascontiguousarray(packed[:, plane]), axis=1, bitorder="little").astype(np.int64)
        values += bits * (1 << plane) * (-1 if plane == planes - 1 else 1)
    return values


def subset_sums(anchors: np.ndarray, dtype) -> np.ndarray:
    """Tables (groups, 256, anchors): the sum of every subset of a group's eight components."""
    rows, width = anchors.shape
    tables = np.zeros((width // 8, 256, rows), dtype=dtype)
    for group in range(width // 8):
        for bit in range(8):
            tables[group, 1 << bit:2 << bit] = tables[group, :1 << bit] + anchors[:, group * 8 + bit].astype(dtype)
    return tables


def scores(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Inner products (rows, anchors): look-ups by plane byte, shifted and added from the top plane down."""
    rows, planes, groups = packed.shape
    total = np.zeros((rows, tables.shape[2]), dtype=tables.dtype)
    picked = np.empty_like(total)
    for plane in reversed(range(planes)):
        if plane < planes - 1:
            np.left_shift(total, 1, out=total)
        for group in range(groups):
            np.take(tables[group], packed[:, plane, group], axis=0, out=picked, mode="clip")
            if plane == planes - 1:
                np.subtract(total, picked, out=total)
            else:
                np.add(total, picked, out=total)
    return total


class Best:
    """The first ``k`` entries of every slot: higher scores first, ties by smaller id."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score = np.full((slots, k), LEAST, dtype=np.int64)
        self.id = np.full((slots, k), np.iinfo(np.int64).max, dtype=np.int64)
        self.filled = np.zeros(slots, dtype=np.int64)

    def floor(self, slots: slice) -> np.ndarray:
        """What an entry must reach: the score of the last kept one, or nothing where room is left."""
        return self.score[slots, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        last, ends = self.score[slot, -1], self.id[slot, -1]
        better = (score > last) | (score == last) & (ident < ends)
        slot, score, ident = slot[better], score[better], ident[better]
        if not len(slot):
            return
        touched, at = np.unique(slot, return_inverse=True)
        old, place = np.nonzero(np.arange(self.k) < self.filled[touched][:, None])
        at = np.concatenate([at, old])
        score = np.concatenate([score, self.score[touched[old], place]])
        ident = np.concatenate([ident, self.id[touched[old], place]])
        order = np.lexsort((ident, -score, at))
        at, score, ident = at[order], score[order], ident[order]
        first = np.searchsorted(at, np.arange(len(touched)))
        rank = np.arange(len(at)) - first[at]
        keep = rank < self.k
        self.score[touched[at[keep]], rank[keep]] = score[keep]
        self.id[touched[at[keep]], rank[keep]] = ident[keep]
        self.filled[touched] = np.bincount(at[keep], minlength=len(touched))


class Anchors:
    """The anchors of a tile."""

    def __init__(self, planes: int, dtype):
        self.planes, self.dtype, self.parts = planes, dtype, []

    def add(self, batch: pa.RecordBatch, packed: np.ndarray) -> None:
        self.parts.append((np.asarray(batch.column("uid")), np.asarray(batch.column("id")), np.asarray(batch.column("label")), packed,
                           batch.column("positives").to_pylist()))

    def close(self) -> None:
        uid, ident, label, packed, positives = zip(*self.parts, strict=True)
        self.uid, self.id, self.label, self.packed = (np.concatenate(x) for x in (uid, ident, label, packed))
        self.positives = [x for part in positives for x in part or []]
        self.parts = []

    def blocks(self):
        """Slices of anchors with their look-up tables."""
        for start in range(0, len(self.uid), TABLE_ANCHORS):
            part = slice(start, min(start + TABLE_ANCHORS, len(self.uid)))
            yield part, subset_sums(unpack_planes(self.packed[part]), self.dtype)


class Positives:
    """First pass: the best rows of the anchor's own label."""

    SCHEMA = pa.schema([("uid", pa.int64()), ("anchor_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
    DDL = "uid long, anchor_id long, id long, score long"

    def __init__(self, anchors: Anchors, k: int):
        self.anchors, self.best = anchors, Best(len(anchors.uid), k)

    def take(self, part: slice, found: np.ndarray, uid: np.ndarray, ident: np.ndarray, label: np.ndarray) -> None:
        a = self.anchors
        reach = np.iinfo(found.dtype)
        fits = (label[:, None] == a.label[part]) & (found >= np.clip(self.best.floor(part), reach.min, reach.max).astype(found.dtype))
        row, col = np.nonzero(fits)
        other = uid[row] != a.uid[part][col]
        row, col = row[other], col[other]
        self.best.add(col + part.start, found[row, col].astype(np.int64), ident[row])

    def result(self) -> pa.RecordBatch:
        slot, place = np.nonzero(np.arange(self.best.k) < self.best.filled[:, None])
        return record_batch(self.SCHEMA, [self.anchors.uid[slot], self.anchors.id[slot], self.best.id[slot, place], self.best.score[slot, place]])


class Negatives:
    """Second pass: for every positive the best rows of other labels whose score lies in its window."""

    SCHEMA = pa.schema([("uid", pa.int64()), ("anchor_id", pa.int64()), ("positive", pa.int32()), ("positive_id", pa.int64()),
                        ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])
    DDL = "uid long, anchor_id long, positive int, positive_id long, positive_score long, negative_id long, negative_score long"

    def __init__(self, anchors: Anchors, k: int, positives: int, window: tuple[int, int]):
        self.anchors, self.width = anchors, positives
        shape = (len(anchors.uid), positives)
        self.known = np.zeros(shape, dtype=bool)
        self.id, self.score = np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=np.int64)
        for row, held in enumerate(anchors.positives):
            for place, entry in enumerate(held):
                self.known[row, place], self.id[row, place], self.score[row, place] = True, entry["id"], entry["score"]
        # 50 p <= 100 s <= 95 p in whole numbers: from the ceiling of p * 50 / 100 to the floor of p * 95 / 100.
        self.low = np.where(self.known, self._share(window[0], up=True), np.iinfo(np.int64).max)
        self.high = np.where(self.known, self._share(window[1], up=False), LEAST)
        self.best = Best(len(anchors.uid) * positives, k)

    def _share(self, percent: int, up: bool) -> np.ndarray:
        whole, rest = self.score // 100, self.score % 100
        return whole * percent + (-(-(rest * percent) // 100) if up else rest * percent // 100)

    def take(self, part: slice, found: np.ndarray, uid: np.ndarray, ident: np.ndarray, label: np.ndarray) -> None:
        a, k = self.anchors, self.width
        worst = self.best.floor(slice(part.start * k, part.stop * k)).reshape(-1, k)
        low, high, reach = np.maximum(self.low[part], worst), self.high[part], np.iinfo(found.dtype)
        least, most = (np.clip(x, reach.min, reach.max).astype(found.dtype) for x in (low.min(axis=1), high.max(axis=1)))
        fits = (found >= least) & (found <= most) & (label[:, None] != a.label[part])
        row, col = np.nonzero(fits)
        score, ident = found[row, col].astype(np.int64), ident[row]
        for place in range(k):
            inside = (score >= low[col, place]) & (score <= high[col, place])
            self.best.add((col[inside] + part.start) * k + place, score[inside], ident[inside])

    def result(self) -> pa.RecordBatch:
        slot, place = np.nonzero(np.arange(self.best.k) < self.best.filled[:, None])
        row, positive = slot // self.width, slot % self.width
        return record_batch(self.SCHEMA, [self.anchors.uid[row], self.anchors.id[row], positive.astype(np.int32), self.id[row, positive],
                                          self.score[row, positive], self.best.id[slot, place], self.best.score[slot, place]])


class Vectors:
    """The stored, packed rows of a search and what their tiles look like."""

    def __init__(self, vectors: DataFrame, anchor_every: int, relabel_every: int, labels: int):
        known = materialize(quantized(vectors, anchor_every, relabel_every, labels), "vectors")
        least, most, width, rows, anchors = known.agg(
            F.min(F.array_min("values")), F.max(F.array_max("values")), F.max(F.size("values")), F.count("*"), F.count_if("is_anchor")).first()
        least, most, self.width = min(least or 0, 0), max(most or 0, 0), max(width or 0, 1)
        self.planes = max((-least - 1).bit_length() if least < 0 else 0, most.bit_length()) + 1
        # No intermediate sum can pass the sum of an anchor's magnitudes times the largest plane.
        bits = (self.width * max(-least, most, 1)).bit_length() + self.planes + 1
        if bits > 62:
            raise ValueError("components are too large for exact scores of 64 bits")
        self.dtype = np.int32 if bits <= 30 else np.int64
        self.groups = -(-self.width // 8)
        cores = known.sparkSession.sparkContext.defaultParallelism
        self.blocks = max(1, math.ceil(anchors / BLOCK_ANCHORS))
        self.parts = max(math.ceil(2 * cores / self.blocks), math.ceil(rows / GROUP_ROWS))
        planes, columns = self.planes, self.groups * 8

        def run(batches):
            schema = pa.schema([("uid", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("is_anchor", pa.bool_()), ("planes", pa.binary())])
            for batch in batches:
                lists = batch.column("values")
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                values = np.zeros((batch.num_rows, columns), dtype=np.int64)
                values[np.arange(columns) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
                packed = pack_planes(values, planes).reshape(batch.num_rows, -1)
                yield record_batch(schema, [batch.column(c) for c in ("uid", "id", "label", "is_anchor")] + [[x.tobytes() for x in packed]])

        self.rows = materialize(known.select("uid", "id", "label", "is_anchor", "values")
                                .mapInArrow(run, "uid long, id long, label long, is_anchor boolean, planes binary"), "planes")

    def anchors(self) -> DataFrame:
        return self.rows.filter("is_anchor")

    def search(self, anchors: DataFrame, make, kind) -> DataFrame:
        """``make(anchors)`` takes the scores of every row in every tile; its results come out.

        ``anchors`` has the columns of ``rows`` and ``positives``. Blocks of anchors go to every group of rows and rows to every
        block of anchors; a tile is one partition, anchors first.
        """
        blocks, parts = self.blocks, self.parts
        spread = lambda n: F.pmod(F.xxhash64("uid", "id"), F.lit(n)).cast("int")
        copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        held = (anchors.select("uid", "id", "label", "planes", "positives", spread(blocks).alias("block")).withColumn("part", copies(parts))
                .withColumn("streamed", F.lit(False)))
        passing = (self.rows.select("uid", "id", "label", "planes", F.lit(None).cast("array<struct<id: long, score: long>>").alias("positives"),
                                    spread(parts).alias("part")).withColumn("block", copies(blocks)).withColumn("streamed", F.lit(True)))
        tiles = (held.unionByName(passing).withColumn("tile", F.col("block") * parts + F.col("part"))
                 .repartitionById(blocks * parts, F.col("tile").cast("int")).sortWithinPartitions("streamed"))
        planes, groups, dtype = self.planes, self.groups, self.dtype

        def run(batches):
            anchors, finder = Anchors(planes, dtype), None
            for batch in batches:
                cut = int((~np.asarray(batch.column("streamed").to_numpy(zero_copy_only=False), dtype=bool)).sum())
                packed = np.frombuffer(b"".join(batch.column("planes").to_pylist()), dtype=np.uint8).reshape(-1, planes, groups)
                if cut:
                    anchors.add(batch.slice(0, cut), packed[:cut])
                if cut == batch.num_rows or (finder is None and not anchors.parts):
                    continue
                if finder is None:
                    anchors.close()
                    finder = make(anchors)
                rest = batch.slice(cut)
                uid, ident, label = (np.asarray(rest.column(c)) for c in ("uid", "id", "label"))
                for part, tables in anchors.blocks():
                    for start in range(0, rest.num_rows, CHUNK_ROWS):
                        rows = slice(start, start + CHUNK_ROWS)
                        finder.take(part, scores(tables, packed[cut:][rows]), uid[rows], ident[rows], label[rows])
            if finder is not None:
                yield finder.result()

        return tiles.select("uid", "id", "label", "planes", "positives", "streamed").mapInArrow(run, kind.DDL)


def mine(vectors: DataFrame, anchor_every: int = 50, relabel_every: int = 7, labels: int = 10, positives: int = POSITIVES,
         negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW) -> DataFrame:
    """For every anchor and each of its positives the first rows of other labels inside the window, ranked from 1."""
    known = Vectors(vectors, anchor_every, relabel_every, labels)
    first = known.search(known.anchors().withColumn("positives", F.lit(None).cast("array<struct<id: long, score: long>>")),
                         lambda anchors: Positives(anchors, positives), Positives)
    ranked = (first.withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= positives)
              .groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("held"))
              .select("uid", F.transform("held", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("positives")))
    anchors = known.anchors().join(materialize(ranked, "positives"), "uid")
    found = known.search(anchors, lambda held: Negatives(held, negatives, positives, window), Negatives)
    order = Window.partitionBy("uid", "positive").orderBy(F.desc("negative_score"), "negative_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def op11_hard_negatives(spark, folder: str) -> DataFrame:
    return mine(table(spark, folder, "embeddings"))


OP11_SQL = """
WITH known AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM known a JOIN known b ON a.id % 50 = 0 AND a.id <> b.id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""
