"""Byte-level BPE by folds of ranked merges, and decoding by joining binary pieces.

A word (one match of the split pattern) is an array of bytes, written as one Latin-1 character each. A fold of
Spark's higher-order functions merges, as long as there is one, the leftmost adjacent pair whose joined bytes
have the lowest rank. Ranks are a literal in the plan: an array of small maps, addressed by the hash of the
bytes. The fold runs once per distinct word, not per occurrence: over the most frequent blank-separated pieces
of all texts, as far as a table of fixed size holds them. The table is broadcast and documents stay where they
are read. Pieces outside the table (rare ones, one occurrence in thirteen on the check tables, and pieces of
any length) get the same ids from the tokenizer library's merge: folded in their rows they took four fifths of
the time, see the README.

Defined results: null and empty texts have no tokens; repeated documents each get their row; an empty table
gives no rows; extra columns are ignored. White space is the Unicode property, as in the tokenizer library;
letters and numbers are those of the running JVM's Unicode version.
"""

from __future__ import annotations

import json
from collections import Counter
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import pyarrow.ipc  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attrloom.llm.common import doc_texts, record_batch, row_blocks, table
from attrloom.llm.components import cut
from attrloom.llm.encoder import RANKS, encoder, pieces, ranks

#: Pieces folded once for all documents, at most, and the characters of the longest of them.
KNOWN_PIECES, KNOWN_CHARS = 400_000, 48
BUCKETS = 1 << 14
NO_RANK = (1 << 31) - 1

#: Fixed value: the Unicode white space characters.
BLANKS = r"\t-\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def java_pattern(pattern: str) -> str:
    """The split pattern with Unicode white space spelled out, which Java's ``\\s`` is not."""
    return (pattern.replace(r"[^\s", f"[^{BLANKS}").replace(r"\S", f"[^{BLANKS}]").replace(r"\s", f"[{BLANKS}]"))


class Fold:
    """The expressions of one vocabulary."""

    def __init__(self, path: str | None = None, pattern: str = public_tokenizers.PATTERN):
        self.path, self.pattern = path, pattern
        known = ranks(path or public_tokenizers.path(RANKS))
        maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
        tokens = [""] * (max(known.values()) + 1)
        for token, rank in known.items():
            text = token.decode("latin-1")
            maps[xxhash.xxh64_intdigest(text.encode(), 42) % BUCKETS][text] = rank
            tokens[rank] = text
        self.ranks = F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")
        self.tokens = F.from_json(F.lit(json.dumps(tokens)), "array<string>")

    @staticmethod
    def rank(ranks: Column, token: Column) -> Column:
        return F.element_at(F.get(ranks, F.xxhash64(token).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), token)

    def merge(self, ranks: Column, parts: Column) -> Column:
        """One step: the leftmost pair of the lowest rank becomes one part."""
        pairs = F.transform(parts, lambda p, i: F.struct(F.coalesce(self.rank(ranks, F.concat(p, F.get(parts, i + 1))), F.lit(NO_RANK)).alias("rank"), i.alias("at")))

        def joined(best):
            at = best["at"]
            return F.when(best["rank"] == NO_RANK, parts).otherwise(F.concat(
                F.slice(parts, F.lit(1), at), F.array(F.concat(F.get(parts, at), F.get(parts, at + 1))), F.slice(parts, at + 3, F.size(parts))))

        return F.get(F.transform(F.array(F.array_min(pairs)), joined), F.lit(0))

    def word(self, ranks: Column, word: Column) -> Column:
        """Ids of one word in Latin-1 form."""
        whole = self.rank(ranks, word)
        steps = F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1)))
        parts = F.aggregate(steps, F.split(word, ""), lambda parts, _: self.merge(ranks, parts))
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(parts, lambda p: self.rank(ranks, p)))

    def piece(self, text: Column) -> Column:
        """Ids of a stretch of text."""
        words = F.regexp_extract_all(text, F.lit(java_pattern(self.pattern)), F.lit(0))
        # The literal stands in the plan once and is a variable in the fold; a copy for each use makes plans of many megabytes.
        return F.get(F.transform(F.array(self.ranks), lambda ranks: F.flatten(F.transform(
            words, lambda w: self.word(ranks, F.decode(w.cast("binary"), "ISO-8859-1"))))), 0)

    def decode(self, ids: Column) -> Column:
        """The bytes of a row of ids."""
        return F.encode(F.concat_ws("", F.transform(ids, lambda i: F.get(self.tokens, i))), "ISO-8859-1")

    @staticmethod
    def brief(spark: SparkSession) -> None:
        """Keep the driver from spelling the literals out in every description of a plan."""
        spark.conf.set("spark.sql.maxPlanStringLength", "100000")


def known_pieces(docs: DataFrame, fold: Fold, most: int = KNOWN_PIECES) -> bytes:
    """Ids (32 bit) of the most frequent pieces behind a blank: those above the lowest count that keeps their number within ``most``."""
    schema = pa.schema([("piece", pa.string()), ("n", pa.int64())])

    def count(batches):
        for batch in row_blocks(batches, "text"):
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                seen.update(pieces(text)[1:])
            short = [x for x in seen.items() if len(x[0]) <= KNOWN_CHARS]
            yield record_batch(schema, list(zip(*short, strict=True)) if short else [[], []])

    counted = doc_texts(docs).select("text").mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    counted = counted.withColumn("level", F.floor(F.log2("n") * 8).cast("int"))
    counted = cut(counted)
    held, level = 0, None
    for row in sorted(counted.groupBy("level").count().collect(), reverse=True):
        held += row["count"]
        if held > most:
            break
        level = row["level"]
    if level is None:
        return b""
    chosen = counted.filter(F.col("level") >= level).select("piece")
    rows = chosen.select("piece", fold.piece(F.concat(F.lit(" "), "piece")).alias("ids")).toArrow()
    packed = pa.BufferOutputStream()
    with pa.ipc.new_stream(packed, rows.schema) as stream:
        stream.write_table(rows)
    return packed.getvalue().to_pybytes()


@lru_cache(maxsize=1)
def piece_table(packed: bytes) -> dict[str, bytes]:
    """The look-up table of a worker from its packed form, in which the driver holds and sends it."""
    found: dict[str, bytes] = {}
    for batch in pa.ipc.open_stream(packed) if packed else ():
        offsets = batch.column(1).offsets.to_numpy()
        ids = batch.column(1).values.to_numpy(zero_copy_only=False).astype("<i4")
        for piece, start, stop in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            found[piece] = ids[start:stop].tobytes()
    return found


def encode(docs: DataFrame, fold: Fold | None = None) -> DataFrame:
    """``doc_id`` and ``ids``, the token ids of the whole text. The documents stay where they are read."""
    fold = fold or Fold()
    fold.brief(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(known_pieces(docs, fold))
    path = fold.path
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def look_up(batches):
        known, coder = piece_table(shared.value), encoder(path)
        for batch in row_blocks(batches):
            values, ends = [], [0]
            for text in batch.column(1).to_pylist():
                first, *rest = pieces(text)
                found = [coder.piece(first)]
                for piece in rest:
                    found.append(known.get(piece) or coder.behind_blank(piece))
                values.append(b"".join(found))
                ends.append(ends[-1] + len(values[-1]) // 4)
            flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(values))])
            yield record_batch(schema, [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)])

    return doc_texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(look_up, "doc_id long, ids array<int>")


def op2_bpe(spark, folder: str) -> DataFrame:
    fold = Fold()
    ids = encode(table(spark, folder, "documents"), fold)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(fold.decode(F.col("ids")), 256).alias("decoded_sha256"))
