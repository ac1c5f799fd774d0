"""Benchmark decontamination with suffix arrays over shards of the training words.

Every shard (a block of documents inside a task) gets a suffix array over its words. Each suffix of
each benchmark item is binary-searched in it; runs of hits on one diagonal are the longest verbatim
matches. Only suffixes whose words all occur in the benchmark can match, so only those are sorted.

Words are the runs of digits, ASCII letters (lower-cased) and non-ASCII characters. A window is
``window`` consecutive item words; an item with fewer words, but not none, is one window.

Defined results: a null or empty text has no words and no matches; an item without words never
matches; a null item id is reported as -1; repeated documents each get their row, repeated items
count once per id; an empty benchmark contaminates nothing. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrloom.llm.common import doc_texts, record_batch, row_blocks, table

WINDOW = 10
#: Bytes of benchmark text in one broadcast block; a larger benchmark becomes several blocks.
BENCHMARK_BLOCK = 8 << 20
#: Occurrences held at a time; where words repeat in a document and an item, their number is the product.
HITS = 1 << 21

#: Lower-cases A-Z and turns every byte outside the word alphabet into a blank.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

MATCH = pa.struct([("item_id", pa.int64()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("n_words", pa.int64())])
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("matches", pa.list_(MATCH))])
DDL = ("doc_id long, n_words long, n_hit long, "
       "matches array<struct<item_id: long, doc_start: long, item_start: long, n_words: long>>")


def words(data: bytes) -> list[bytes]:
    return data.translate(WORD_BYTES).split()


class Vocabulary(dict):
    """Word to number; a word outside the benchmark is 0."""

    def __missing__(self, key):
        return 0


class TestSuffixes:
    """The windows of one benchmark block as sortable keys, grouped by their length."""

    def __init__(self, items: list[tuple[int, bytes]], window: int):
        self.window = window
        self.vocabulary = Vocabulary()
        spelled = [(item, words(text)) for item, text in items]
        for _, parts in spelled:
            for word in parts:
                self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
        self.item_ids = np.array([item for item, _ in spelled], dtype=np.int64)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        found: dict[int, list] = {}
        for number, (_, parts) in enumerate(spelled):
            ids = np.array([self.vocabulary[w] for w in parts], dtype=">u4")
            size = min(len(ids), window)
            if size:
                keys = np.lib.stride_tricks.sliding_window_view(ids, size)
                found.setdefault(size, []).append((keys, np.full(len(keys), number), np.arange(len(keys))))
        for size, parts in found.items():
            self.by_length[size] = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        self.shortest = min(self.by_length, default=0)

    def search(self, sequence: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Occurrences ``(position, item number, item position, window length)`` in a shard's words, about ``HITS`` at a time."""
        if not self.shortest or not len(sequence):
            return
        known = sequence > 0
        stops = np.flatnonzero(~known)
        ahead = np.searchsorted(stops, np.arange(len(sequence)))
        run = np.append(stops, len(sequence))[ahead] - np.arange(len(sequence))
        starts = np.flatnonzero(run >= self.shortest)
        if not len(starts):
            return
        padded = np.concatenate([sequence, np.zeros(self.window, dtype=sequence.dtype)]).astype(">u4")
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.window)[starts])
        # Words behind the first unknown one take no part in a match; blank them so that keys stay comparable.
        suffixes[np.arange(self.window)[None, :] >= run[starts][:, None]] = 0
        keys = suffixes.view(f"S{4 * self.window}").ravel()
        order = np.argsort(keys, kind="stable")
        keys, starts = keys[order], starts[order]
        for size, (tests, numbers, offsets) in self.by_length.items():
            low = np.zeros((len(tests), self.window), dtype=">u4")
            high = np.full((len(tests), self.window), 0xFFFFFFFF, dtype=">u4")
            low[:, :size] = high[:, :size] = tests
            first = np.searchsorted(keys, low.view(keys.dtype).ravel(), "left")
            count = np.searchsorted(keys, high.view(keys.dtype).ravel(), "right") - first
            found = np.flatnonzero(count)
            slices = np.cumsum(count[found]) // HITS
            for part in np.split(found, np.flatnonzero(np.diff(slices)) + 1) if len(found) else ():
                n = count[part]
                hit = np.repeat(part, n)
                inside = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)
                yield starts[first[hit] + inside], numbers[hit], offsets[hit], np.full(len(hit), size)


def longest(position, number, offset, size, last=None) -> list[np.ndarray]:
    """Join hits (or runs of hits up to the position ``last``) that continue each other on one diagonal: first and last position,
    item, first item position, window length."""
    last = position if last is None else last
    order = np.lexsort((position, position - offset, number))
    position, number, offset, size, last = (x[order] for x in (position, number, offset, size, last))
    new = np.ones(len(position), dtype=bool)
    new[1:] = (number[1:] != number[:-1]) | (position[1:] - offset[1:] != position[:-1] - offset[:-1]) | (position[1:] != last[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(position)) - 1
    return [position[head], number[head], offset[head], size[head], last[tail]] if len(head) else [position] * 5


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> list:
    """The benchmark as broadcasts of at most about ``block_bytes`` each; the driver holds one at a time."""
    context, blocks, held, size = benchmark.sparkSession.sparkContext, [], [], 0
    for row in benchmark.select(F.coalesce("item_id", F.lit(-1)).cast("long"), F.coalesce("text", F.lit(""))).toLocalIterator():
        data = row[1].encode()
        if held and size + len(data) > block_bytes:
            blocks.append(context.broadcast(held))
            held, size = [], 0
        held.append((row[0], data))
        size += len(data)
    return [*blocks, context.broadcast(held)] if held else blocks


class Scanner:
    """Searches blocks of documents for the windows of every benchmark block."""

    def __init__(self, blocks: list, window: int):
        self.blocks, self.window = blocks, window
        self.loaded: list[TestSuffixes] = []

    def tests(self):
        if len(self.blocks) > 1:  # one block in memory at a time
            for block in self.blocks:
                yield TestSuffixes(block.value, self.window)
        elif self.blocks:
            self.loaded = self.loaded or [TestSuffixes(self.blocks[0].value, self.window)]
            yield self.loaded[0]

    def scan(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
        """Per document: words, words inside a window occurrence, longest matches."""
        texts = [words(x.as_buffer().to_pybytes()) if x.is_valid else [] for x in column.cast(pa.binary())]
        counts = np.array([len(x) for x in texts], dtype=np.int64)
        begin = np.cumsum(counts + 1) - counts - 1  # one unknown word between documents
        total = int((counts + 1).sum())
        hit, rows = np.zeros(total + 1, dtype=np.int64), []
        for tests in self.tests():
            sequence = np.zeros(total, dtype=np.uint32)
            for at, parts in zip(begin, texts, strict=True):
                sequence[at:at + len(parts)] = np.fromiter(map(tests.vocabulary.__getitem__, parts), np.uint32, len(parts))
            runs = [longest(*found) for found in tests.search(sequence)]
            if not runs:
                continue
            start, number, offset, size, last = longest(*(np.concatenate(x) for x in zip(*runs, strict=True)))
            length = last - start + size
            np.add.at(hit, start, 1)
            np.add.at(hit, start + length, -1)
            doc = np.searchsorted(begin, start, "right") - 1
            rows += zip(doc.tolist(), tests.item_ids[number].tolist(), (start - begin[doc]).tolist(), offset.tolist(), length.tolist(), strict=True)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)])
        matches: list[list] = [[] for _ in texts]
        for doc, item, at, offset, length in sorted(rows):
            matches[doc].append({"item_id": item, "doc_start": at, "item_start": offset, "n_words": length})
        return counts, covered[begin + counts] - covered[begin], matches


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BENCHMARK_BLOCK) -> DataFrame:
    """Per document: word count, words inside any window occurrence, and the longest verbatim matches.

    Narrow: no shuffle. The benchmark is broadcast in blocks of a fixed size, however large it is, and
    every shard is searched for every block.
    """
    blocks = benchmark_blocks(benchmark, block_bytes)

    def run(batches):
        scanner = Scanner(blocks, window)
        for batch in row_blocks(batches):
            yield record_batch(SCHEMA, [batch.column(0), *scanner.scan(batch.column(1))])

    return doc_texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DDL)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BENCHMARK_BLOCK,
                  column: str = "text") -> DataFrame:
    """The documents that hold no benchmark window, with all their columns. Narrow."""
    blocks, place = benchmark_blocks(benchmark, block_bytes), docs.columns.index(column)

    def run(batches):
        scanner = Scanner(blocks, window)
        for batch in row_blocks(batches, column):
            yield batch.filter(pa.array(scanner.scan(batch.column(place))[1] == 0))

    return docs.mapInArrow(run, docs.schema)


def op10_decontaminate(spark, folder: str) -> DataFrame:
    found = find_matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"].cast("string"))))
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
                        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i
              FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
occ AS (SELECT doc_id, i, n, item_id FROM grams JOIN win USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit
         FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM occ)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS listed
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""
