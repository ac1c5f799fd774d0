"""SimHash near-duplicates with vantage-point trees over Hamming space.

Distinct fingerprints are searched once per block of their bits: two fingerprints within ``radius`` agree to
within ``radius // blocks`` bits on at least one block, so a search of that small radius in every block finds
all pairs. A vantage-point tree over a bounded sample deals the fingerprints of a block into shards by their
distance to the vantage points. A fingerprint lives in one shard and queries every shard its ball overlaps
(the triangle bound). Inside a shard the same bounds prune further down to exact comparisons of whole
fingerprints. A shard hands on a spanning forest of its links, never all pairs; connected components follow.

Defined results: null texts are empty; a text without words has fingerprint zero and links like any other;
fewer words than a shingle count as one shingle; repeated rows share a fingerprint and each get their row; a
null ``doc_id`` counts as -1 as a component name; an empty table gives no rows; extra columns are ignored by
``near_duplicates`` and kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrloom.llm.common import doc_texts, record_batch, row_blocks, table
from attrloom.llm.components import components, cut

#: Fingerprints the vantage-point trees are fitted on, at most.
TREE_SAMPLE = 20_000
#: Fingerprints a shard should hold; a fuller one is dealt out over several tasks by a salt.
SHARD_ROWS = 32768
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(hashes: np.ndarray, number: int) -> np.ndarray:
    """Further hash words from a first one (the finalizer of splitmix64 over a stepped state)."""
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(0x9E3779B97F4A7C15) * np.uint64(number)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 with seed 42 of every shingle of a text, repeats included."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = [b" ".join(p) for p in zip(*(words[k:] for k in range(shingle)), strict=False)]
    return np.array([xxhash.xxh64_intdigest(p, 42) for p in parts], dtype=np.uint64)


def majority(first: np.ndarray, n_words: int) -> bytes:
    """``n_words`` times 64 bits; a bit is one if it is one in over half of the hashes (repeats count). Further words use a mix."""
    if not len(first):
        return bytes(8 * n_words)
    out = b""
    for number in range(n_words):
        hashes = (mix(first, number) if number else first).astype(">u8")
        ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out += np.packbits(2 * ones > len(first)).tobytes()
    return out


def fingerprint(text: bytes, shingle: int, n_words: int) -> bytes:
    return majority(shingle_hashes(text, shingle), n_words)


def fingerprints(docs: DataFrame, shingle: int = 3, n_words: int = 1) -> DataFrame:
    """``doc_id``, a hash of the row's id and text, and the fingerprint bytes of the whole text. Narrow."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("fp", pa.binary())])

    def run(batches):
        for batch in row_blocks(batches):
            yield record_batch(schema, [batch.column(0), batch.column(1),
                                        [fingerprint(x.as_buffer().to_pybytes(), shingle, n_words) for x in batch.column(2).cast(pa.binary())]])

    plain = doc_texts(docs).select(F.col("doc_id").cast("long"), row_hash().alias("row"), "text")
    return plain.mapInArrow(run, "doc_id long, row long, fp binary")


def row_hash():
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def distance(a, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b)).astype(np.int16)


class Tree:
    """Vantage-point tree over integers of one block: inner nodes (point, inner bound), leaves numbered."""

    def __init__(self, sample: np.ndarray, leaf_rows: float):
        self.nodes: list[tuple[int, int, int, int]] = []
        self.leaves = 0
        self.root = self._grow(np.sort(sample), leaf_rows)

    def _grow(self, points: np.ndarray, leaf_rows: float) -> int:
        """Non-negative: an inner node. Negative: leaf ``-1 - number``."""
        if len(points) > max(1.0, leaf_rows):
            vantage = points[len(points) // 2]
            away = distance(points, vantage)
            bound = int(np.sort(away)[(len(away) - 1) // 2])
            if away.max() > bound:
                at = len(self.nodes)
                self.nodes.append((0, 0, 0, 0))
                near, far = self._grow(points[away <= bound], leaf_rows), self._grow(points[away > bound], leaf_rows)
                self.nodes[at] = (int(vantage), bound, near, far)
                return at
        self.leaves += 1
        return -self.leaves

    def assign(self, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs ``(row, leaf)`` of all leaves within reach of each value; radius 0 gives its own leaf."""
        rows, leaves = [], []
        stack = [(self.root, np.arange(len(values)))]
        while stack:
            node, inside = stack.pop()
            if not len(inside):
                continue
            if node < 0:
                rows.append(inside)
                leaves.append(np.full(len(inside), -1 - node))
                continue
            vantage, bound, near, far = self.nodes[node]
            away = distance(values[inside], values.dtype.type(vantage))
            stack += [(near, inside[away <= bound + radius]), (far, inside[away > bound - radius])]
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, dtype=np.int64),) * 2


def block_values(fps: np.ndarray, block: int, bits: int) -> np.ndarray:
    """The bits of one block as integers; ``fps`` is a matrix of bytes."""
    size = bits // 8
    return np.ascontiguousarray(fps[:, block * size:(block + 1) * size]).view(f">u{size}").ravel().astype(f"u{size}")


class Forest:
    """Growing spanning forest over the rows of one shard."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


def search(forest: Forest, words: np.ndarray, values: np.ndarray, index: np.ndarray, asking: np.ndarray, near: int, radius: int) -> None:
    """Link all rows of ``index`` and ``asking`` within ``radius`` whose block values are within ``near``."""
    stack = [(index, asking)]
    while stack:
        index, asking = stack.pop()
        if not len(index) or not len(asking):
            continue
        if len(index) > 64 and len(index) * len(asking) > 1 << 14:
            vantage = values[index[len(index) // 2]]
            to_index, to_asking = distance(values[index], vantage), distance(values[asking], vantage)
            bound = int(np.partition(to_index, (len(index) - 1) // 2)[(len(index) - 1) // 2])
            if to_index.max() > bound:
                stack += [(index[to_index <= bound], asking[to_asking <= bound + near]), (index[to_index > bound], asking[to_asking > bound - near])]
                continue
        step = max(1, (1 << 20) // len(asking))
        for at in range(0, len(index), step):
            part = index[at:at + step]
            i, q = np.nonzero(np.bitwise_count(values[part][:, None] ^ values[asking][None, :]) <= near)
            i, q = part[i], asking[q]
            open_ = forest.label[i] != forest.label[q]
            i, q = i[open_], q[open_]
            if len(i):
                good = sum(np.bitwise_count(w[i] ^ w[q]).astype(np.int16) for w in words) <= radius
                forest.link(i[good], q[good])


def shard_links(ids: np.ndarray, fps: np.ndarray, home: np.ndarray, values: np.ndarray, near: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one shard: every linked row with the row its tree hangs on."""
    forest = Forest(len(ids))
    words = np.ascontiguousarray(fps).view(">u8").astype(np.uint64).T
    search(forest, words, values, np.flatnonzero(home), np.arange(len(ids)), near, radius)
    linked = np.flatnonzero(forest.label != np.arange(len(ids)))
    return ids[linked], ids[forest.label[linked]]


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, size)


def links(classes: DataFrame, n_bits: int, blocks: int, radius: int, near: int | None = None,
          sample: int = TREE_SAMPLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Spanning links ``(u, v)`` between the ids of distinct fingerprints ``(id, fp)`` within ``radius`` bits.

    ``near`` is the reach inside a block: ``radius // blocks`` (the default) finds every pair, less finds the pairs
    that come that close on some block. One shuffle, of fingerprints, by shard. The driver holds a bounded sample and one
    number per shard.
    """
    bits, size, near = n_bits // blocks, n_bits // 8, radius // blocks if near is None else near
    if bits not in (8, 16, 32, 64):
        raise ValueError("a block needs 8, 16, 32 or 64 bits")
    classes = classes.select("id", "fp")
    context = classes.sparkSession.sparkContext
    total = classes.count()
    drawn = classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).toArrow()["fp"].combine_chunks()
    rows = matrix(drawn, size)
    trees = [Tree(block_values(rows, b, bits), shard_rows * len(rows) / max(total, 1)) for b in range(blocks)]
    shared = context.broadcast(trees)
    count_schema = pa.schema([("block", pa.int32()), ("leaf", pa.int32()), ("n", pa.int64())])

    def count(batches):
        for batch in batches:
            fps = matrix(batch.column(1), size)
            for b, tree in enumerate(shared.value):
                leaf, n = np.unique(tree.assign(block_values(fps, b, bits), 0)[1], return_counts=True)
                yield record_batch(count_schema, [np.full(len(leaf), b, dtype=np.int32), leaf.astype(np.int32), n])

    held = classes.mapInArrow(count, "block int, leaf int, n long").groupBy("block", "leaf").agg(F.sum("n").alias("n"))
    salts = context.broadcast({(r["block"], r["leaf"]): -(-r["n"] // (2 * shard_rows)) for r in held.filter(F.col("n") > 2 * shard_rows).collect()})
    dealt_schema = pa.schema([("block", pa.int32()), ("leaf", pa.int32()), ("salt", pa.int32()), ("home", pa.bool_()), ("id", pa.int64()), ("fp", pa.binary())])

    def deal(batches):
        for batch in batches:
            fps, ids = matrix(batch.column(1), size), batch.column(0).to_numpy()
            for b, tree in enumerate(shared.value):
                values = block_values(fps, b, bits)
                own = np.empty(len(ids), dtype=np.int64)
                row, leaf = tree.assign(values, 0)
                own[row] = leaf
                row, leaf = tree.assign(values, near)
                copies = np.array([salts.value.get((b, int(x)), 1) for x in leaf], dtype=np.int64) if salts.value else np.ones(len(leaf), dtype=np.int64)
                salt = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                row, leaf, copies = np.repeat(row, copies), np.repeat(leaf, copies), np.repeat(copies, copies)
                home = (own[row] == leaf) & (ids[row] % copies == salt)
                yield record_batch(dealt_schema, [np.full(len(row), b, dtype=np.int32), leaf.astype(np.int32), salt.astype(np.int32), home,
                                                  ids[row], batch.column(1).take(pa.array(row))])

    def shards(batches: Iterator[pa.RecordBatch]):
        """The rows of one shard at a time, from rows sorted by shard."""
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            keys = np.stack([rows.column(k).to_numpy() for k in range(3)])
            starts = np.append(0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                yield rows.slice(a, b - a)
            rest = rows.slice(starts[-1])
        if rest is not None and rest.num_rows:
            yield rest

    link_schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def solve(batches):
        for shard in shards(batches):
            fps = matrix(shard.column(5).combine_chunks(), size)
            ids, home = shard.column(4).to_numpy(), shard.column(3).to_numpy()
            found = shard_links(ids, fps, home, block_values(fps, shard.column(0)[0].as_py(), bits), near, radius)
            yield record_batch(link_schema, list(found))

    dealt = classes.mapInArrow(deal, "block int, leaf int, salt int, home boolean, id long, fp binary")
    return (dealt.repartition("block", "leaf", "salt").sortWithinPartitions("block", "leaf", "salt")
            .mapInArrow(solve, "u long, v long").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, n_words: int = 1, blocks: int = 2, radius: int = 3, near: int | None = None) -> DataFrame:
    """``doc_id``, ``row``, ``fp``, ``component_id`` (the smallest doc_id reachable over links of at most ``radius`` bits)
    and ``component``, the number of the group. Groups that share a ``component_id`` stay different groups."""
    marked = cut(fingerprints(docs, shingle, n_words))
    classes = numbered(marked.groupBy("fp").agg(F.min("doc_id").alias("name")))
    found = components(links(classes.select("id", "fp"), 64 * n_words, blocks, radius, near))
    grouped = classes.join(found, "id", "left").select(F.col("fp").alias("_fp"), "name", F.coalesce("component", "id").alias("component"))
    names = grouped.groupBy("component").agg(F.coalesce(F.min("name"), F.lit(-1)).alias("component_id"))
    named = grouped.join(names, "component").select("_fp", "component", "component_id")
    return marked.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "row", "fp", "component_id", "component")


def numbered(classes: DataFrame) -> DataFrame:
    """``classes`` with a unique ``id``, written, since the numbers differ from run to run."""
    return cut(classes.withColumn("id", F.monotonically_increasing_id()))


def keep_first(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: the one of the smallest ``doc_id`` (a null id
    only if the group has no other), of equal ids the one with the smaller row hash, of equal rows one."""
    found = cut(near_duplicates(docs, shingle, radius=radius).select("doc_id", "row", "component"))
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("best"))
    return keep_rows(docs, found, best.select("best.doc_id", "best.row"))


def unused(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def keep_rows(docs: DataFrame, found: DataFrame, best: DataFrame) -> DataFrame:
    """The documents of the rows ``best`` of all rows ``found``, equal rows once."""
    # Rows meet by id and hash and not by their group, so no group meets in a task.
    row, doc = unused("_row", docs.columns), unused("_doc", docs.columns)
    named = [F.col("row").alias(row), F.col("doc_id").alias(doc)]
    same = (F.col("row") == F.col(row)) & F.col("doc_id").eqNullSafe(F.col(doc))
    later = found.select("doc_id", "row").distinct().join(best.select(*named), same, "left_anti").select(*named)
    kept = docs.join(later, (row_hash() == F.col(row)) & F.col("doc_id").eqNullSafe(F.col(doc)), "left_anti")
    if found.groupBy("doc_id", "row").count().filter("count > 1").isEmpty():
        return kept
    return kept.withColumn(row, row_hash()).dropDuplicates(["doc_id", row]).drop(row)


def op5_simhash(spark, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
