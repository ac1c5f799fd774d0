"""Document fingerprints: threshold-scaled sketches of word shingles.

Every hash of a five-word shingle below a fixed fraction of the hash range is kept, so a sketch grows with
its document, sketches merge by union, and containment between very unequal documents can be estimated.
The fraction is the whole range by default: texts of a few words lose nothing, and the estimates are the exact shares.
With a smaller fraction a document none of whose hashes is low enough keeps its smallest one, so it never has an
empty sketch. Such a stand-in says which hashes are not there up to itself and nothing beyond the fraction, so two
sketches are compared in the range both cover; without a hash there the containment is unknown.

Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters; fewer than five words are one
shingle; a text without words has the hash of its bytes. Equal texts have equal fingerprints.

Defined results: null texts are empty; repeated documents each get their row; documents follow each other by
descending ``doc_id`` (null last), equal ids by text; the last is followed by the first, a single document by
itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrloom.llm.common import doc_texts, record_batch, row_blocks, sha256_hex, table
from attrloom.llm.decontaminate import words

SHINGLE = 5
#: One hash in this many is kept.
SCALE = 1
#: Hashes are written with this many hexadecimal digits, from the 48 high bits.
DIGITS = 12
REMEMBERED = 1 << 18


class WordHashes(dict):
    def __missing__(self, word):
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 0)
        return value


_WORDS = WordHashes()


def sketch(text: bytes, scale: int = SCALE) -> np.ndarray:
    """The kept hashes (48 bits), ascending, without repeats."""
    parts = words(text)
    if not parts:
        return np.array([xxhash.xxh64_intdigest(text, 1) >> 16], dtype=np.uint64)
    each = np.fromiter(map(_WORDS.__getitem__, parts), np.uint64, len(parts))
    width = min(SHINGLE, len(each))
    count = len(each) - width + 1
    mixed = np.full(count, width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            mixed = (mixed ^ each[k:k + count]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed >>= np.uint64(16)
    low = mixed[mixed < np.uint64((1 << 48) // scale)]
    return np.unique(low) if len(low) else mixed.min(keepdims=True)


def written(hashes: np.ndarray) -> str:
    """Ascending hashes in fixed-width hexadecimal."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), dtype=np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).view(">u8").ravel().astype(np.uint64)


def covered(a: np.ndarray, b: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Both sketches in the range of hashes that both cover."""
    limit = np.uint64((1 << 48) // scale)
    if a[-1] >= limit and b[-1] >= limit:
        limit = min(a[-1], b[-1]) + np.uint64(1)
    return a[a < limit], b[b < limit]


def likeness(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> float:
    """Estimated share of common shingles."""
    a, b = covered(a, b, scale)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has; not a number if ``a`` has no hash where both are known."""
    a, b = covered(a, b, scale)
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else float("nan")


def fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """``doc_id`` and its sketch. Narrow."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        for batch in row_blocks(batches):
            yield record_batch(schema, [batch.column(0), [written(sketch(x.as_buffer().to_pybytes(), scale)) for x in batch.column(1).cast(pa.binary())]])

    return doc_texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most ``value``: a binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    sides = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    array = F.array(*[F.lit(b) for b in bounds])

    def halve(s, _):
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        up = F.get(array, mid) <= value
        return F.when(s["lo"] >= s["hi"], s).otherwise(
            F.struct(F.when(up, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), sides, halve)["lo"]


EDIT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                         ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
EDIT_DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double")


def edited_rows(batches):
    """Rows of one partition by descending id; the first row of the next partition stands last, as ``guest``."""
    before = None
    for batch in row_blocks(batches, "text"):
        rows = []
        for doc, text, guest in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            own = sketch(text.encode())
            if before is not None:
                name, old, kept = before
                half = len(old) // 2
                edited = (old[:len(old) - half] + text[:half]).encode()
                changed = sketch(edited) if half else kept
                rows.append((name, len(old), sha256_hex(edited), written(kept), written(changed), likeness(kept, changed), likeness(kept, own)))
            before = None if guest else (doc, text, own)
        if rows:
            yield record_batch(EDIT_SCHEMA, list(zip(*rows, strict=True)))


def edit_check(docs: DataFrame) -> DataFrame:
    """Every document against itself with its end replaced by the start of the next document, and against that one.

    Documents are dealt by ranges of their id, so that one shuffle of the texts brings neighbours together.
    Each range also gets the first document of the next range (one row each, joined by id).
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = F.lit(-(1 << 63))
    plain = doc_texts(docs).select(F.col("doc_id").cast("long"), "text")
    key = F.coalesce("doc_id", low)
    bounds = plain.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    bounds = sorted(set(bounds or []), reverse=True)
    # Number 0 holds the largest ids.
    range_of = F.lit(len(bounds)) - bucket(key, bounds[::-1])
    heads = {r[0]: r[1] for r in plain.groupBy(range_of.alias("part")).agg(F.max(key)).collect()}
    order = sorted(heads)
    guests = spark.createDataFrame([(order[k], heads[order[(k + 1) % len(order)]]) for k in range(len(order))], "part int, _head long")
    guest_rows = (plain.join(F.broadcast(guests), key == F.col("_head")).groupBy("part", "doc_id").agg(F.min("text").alias("text"))
                  .select("doc_id", "text", F.lit(True).alias("guest"), "part"))
    dealt = plain.select("doc_id", "text", F.lit(False).alias("guest"), range_of.cast("int").alias("part")).unionByName(guest_rows)
    ordered = (dealt.repartitionById(max(parts, len(bounds) + 1), F.col("part"))
               .sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), "text"))
    return ordered.select("doc_id", "text", "guest").mapInArrow(edited_rows, EDIT_DDL)


def op6_fingerprint(spark, folder: str) -> DataFrame:
    return edit_check(table(spark, folder, "documents"))
