"""Packed training sequences by best-fit-decreasing.

Each task encodes its documents, cuts overlong ones into full rows and a rest (nothing is lost), and packs
a block of pieces at a time: longest first, each into the fullest row it still fits, found by a descent in
a segment tree over the free space. Rows come out as padded rows of an id matrix with cumulative segment
lengths and positions that start again at each segment. Blocks have a fixed number of tokens, so memory does not grow with the table.

Defined results: null and empty texts have no tokens and take no room (they are listed in no row);
repeated documents are packed each; ties in length keep input order; an empty table gives no rows; extra
columns are ignored. The split into blocks follows the scan, so row numbers are not stable across layouts,
but every token of every document is in exactly one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrloom.llm.common import doc_texts, record_batch, row_blocks, table
from attrloom.llm.encoder import encoder

ROW_TOKENS = 2048
#: Tokens packed together; at 16-bit ids 8 MB.
BLOCK_TOKENS = 1 << 22

SCHEMA = pa.schema([("pack_id", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int64())),
                    ("cu_seqlens", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("id_bytes", pa.int32()), ("position_bytes", pa.int32()),
                    ("input_ids", pa.binary()), ("position_ids", pa.binary())])
DDL = ("pack_id string, doc_ids array<long>, doc_offsets array<long>, cu_seqlens array<int>, n_tokens long, id_bytes int, position_bytes int, "
       "input_ids binary, position_ids binary")


class FreeSpace:
    """Rows by free space: a segment tree counts the rows of each free size; the smallest that fits is one descent."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1 - 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, free: int, by: int) -> None:
        node = free + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        self._add(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least free space of at least ``need``, and that space."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        free = node - self.leaves
        self._add(free, -1)
        return self.rows[free].pop(), free


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Pieces (each at most ``capacity``) to rows."""
    space, packs = FreeSpace(capacity), []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[piece])
        found = space.take(need)
        if found is None:
            packs.append([piece])
            row, free = len(packs) - 1, capacity
        else:
            row, free = found
            packs[row].append(piece)
        if free > need:
            space.put(free - need, row)
    return packs


def split(doc: int | None, ids: np.ndarray, capacity: int) -> list[tuple[int | None, int, np.ndarray]]:
    return [(doc, at, ids[at:at + capacity]) for at in range(0, len(ids), capacity)]


def width(values: int) -> np.dtype:
    """Unsigned little-endian integers that hold ``values`` different numbers, of 16 bit where they suffice."""
    return np.dtype("<u2" if values <= 1 << 16 else "<u4")


def pack_block(pieces: list, capacity: int, label: str, pad: int, ids: np.dtype) -> pa.RecordBatch:
    places = width(capacity)
    rows = []
    for number, pack in enumerate(best_fit_decreasing(np.array([len(x[2]) for x in pieces], dtype=np.int64), capacity)):
        chosen = [pieces[k] for k in pack]
        lengths = np.array([len(x[2]) for x in chosen])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        row, positions = np.full(capacity, pad, dtype=ids), np.zeros(capacity, dtype=places)
        row[:ends[-1]] = np.concatenate([x[2] for x in chosen])
        positions[:ends[-1]] = np.arange(ends[-1]) - np.repeat(ends[:-1], lengths)
        rows.append((f"{label}-{number}", [x[0] for x in chosen], [x[1] for x in chosen], ends.astype(np.int32), int(ends[-1]),
                     ids.itemsize, places.itemsize, row.tobytes(), positions.tobytes()))
    return record_batch(SCHEMA, list(zip(*rows, strict=True)))


def matrix(rows: list[bytes], item_bytes: int) -> np.ndarray:
    """Rows of ``input_ids`` or ``position_ids`` as one matrix."""
    return np.stack([np.frombuffer(r, dtype=f"<u{item_bytes}") for r in rows])


def pack(docs: DataFrame, vocabulary: str | None = None, row_tokens: int = ROW_TOKENS, block_tokens: int = BLOCK_TOKENS, pad: int = 0) -> DataFrame:
    """Packed rows of ``row_tokens``: which documents from which token on, cumulative lengths, padded ids and positions.

    ``input_ids`` and ``position_ids`` are little-endian rows of ``id_bytes`` and ``position_bytes`` an item; from
    ``n_tokens`` on they hold ``pad`` and 0. Narrow: no shuffle. A lost task is packed again from its own input alone.
    """
    if row_tokens < 1:
        raise ValueError("row_tokens must be positive")

    def run(batches):
        from pyspark import TaskContext
        coder, part, block = encoder(vocabulary), TaskContext.get().partitionId(), 0
        kind = width(max(len(coder.sizes), pad + 1))
        pieces, held = [], 0
        for batch in row_blocks(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = coder.encode(text).astype(kind)
                pieces += split(doc, ids, row_tokens)
                held += len(ids)
                if held >= block_tokens:
                    yield pack_block(pieces, row_tokens, f"{part}-{block}", pad, kind)
                    pieces, held, block = [], 0, block + 1
        if pieces:
            yield pack_block(pieces, row_tokens, f"{part}-{block}", pad, kind)

    return doc_texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DDL)


def write_packs(packs: DataFrame, path: str) -> None:
    """The matrix rows of ``packs`` to Parquet: padded ids and positions with their widths, cumulative lengths."""
    packs.select("pack_id", "id_bytes", "position_bytes", "input_ids", "position_ids", "cu_seqlens").write.parquet(path)


def op7_packing(spark, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))
