"""Frequent phrases and their cohesion, found with Misra-Gries summaries.

First pass: every block of text counts its phrases of one to five words by a 64-bit hash. Hash partitions take the high part;
what a block has of a partition is one summary. Summaries of a partition are merged into one of bounded size: where
it outgrows its capacity, the count of the first key beyond it is taken off all. The capacity is twice the
partition's mass divided by the threshold, so less than half the threshold is ever taken off, and no phrase
at or above the threshold is lost. A block counts a phrase ``threshold`` times at most, which no decision needs more of, so
one very frequent phrase gives its partition no larger mass. Blocks keep all their counts, as losses of blocks would add up.

Second pass: the surviving hashes, in slices of bounded size, are held against all texts again; phrases with such a hash
are counted as strings, which gives exact numbers whatever the hashes did.

Score: cutting a phrase in two gives ``floor(1000 a n / (l r))``; the lowest cut counts. Parts of a frequent phrase are
frequent themselves, so all numbers come from the same table.

Defined results: a null text is empty, a null language is ``und``; texts without words count for nothing; repeated documents count each;
phrases do not cross pieces or documents; an empty table gives no rows; extra columns are ignored. A document longer than a block is cut
between pieces; a single piece is never cut.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrloom.llm.common import BLOCK_BYTES, record_batch, row_blocks, table
from attrloom.operators.lookups import join_per_key
from attrloom.session import materialize

THRESHOLD = 100
LONGEST = 5
TOP = 2000

#: Text bytes per hash partition (about 15 million phrase occurrences), and at most so many partitions.
PARTITION_BYTES = 32 << 20
MOST_PARTITIONS = 1 << 16
#: Surviving hashes held by a task at a time (8 bytes each).
SLICE_KEYS = 1 << 22
#: Rows of a ranking are first cut to the top within so many parts of a language.
RANK_PARTS = 64
#: Bits of the first test of a hash against a slice.
FILTER_BITS = 25

#: Lower-cases A-Z; piece ends become line feeds, the other blanks spaces.
PIECE_END, BLANK = 10, 32
LETTERS = bytes(b + 32 if 65 <= b <= 90 else PIECE_END if b in b".,;:!?" or 10 <= b <= 13 else BLANK if b == 9 else b for b in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


class Words:
    """The words of a block of texts: numbers into a dictionary, the piece and the language of each."""

    def __init__(self, texts: list[bytes], languages: list[str]):
        data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        ends = data == PIECE_END
        inside = ~(ends | (data == BLANK))
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]])) if len(data) else np.zeros(0, dtype=np.int64)
        stops = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1 if len(data) else starts
        offsets = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(stops - starts, out=offsets[1:])
        spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
        coded = spelled.dictionary_encode()
        self.number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.spelling = coded.dictionary.to_pylist()
        self.piece = np.cumsum(ends)[starts] if len(starts) else starts
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        names, of_text = np.unique(np.array(languages, dtype=object), return_inverse=True)
        self.languages = names.tolist()
        self.language = of_text[np.searchsorted(begins, starts, side="right") - 1]
        seeds = np.array([xxhash.xxh64_intdigest(x.encode(), seed=1) for x in self.languages], dtype=np.uint64)
        hashes = np.array([xxhash.xxh64_intdigest(x) for x in self.spelling], dtype=np.uint64)
        self._word = hashes[self.number] if len(starts) else np.zeros(0, dtype=np.uint64)
        self._seed = seeds[self.language]

    def phrases(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For every length the first words of the phrases of that length, and the phrases' hashes."""
        hashes, at = mixed(self._word ^ self._seed), np.arange(len(self.number))
        for n in range(1, longest + 1):
            if n > 1:
                fits = at + n - 1 < len(self.number)
                at, hashes = at[fits], hashes[fits]
                fits = self.piece[at] == self.piece[at + n - 1]
                at, hashes = at[fits], hashes[fits]
                hashes = mixed(hashes * np.uint64(0xD6E8FEB86659FD93) + self._word[at + n - 1])
            yield n, at, hashes


def stretches(text: bytes, most: int = BLOCK_BYTES) -> Iterator[bytes]:
    """A text cut between pieces into parts of about ``most`` bytes."""
    start = 0
    while len(text) - start > most:
        cut = text.rfind(b"\n", start, start + most)
        cut = text.find(b"\n", start + most) if cut <= start else cut
        if cut < 0:
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:] if start else text


def blocks_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in row_blocks(batches):
        texts, languages = [], []
        for text, language in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            for part in stretches(text.encode().translate(LETTERS)):
                texts.append(part)
                languages.append(language)
                if len(part) > BLOCK_BYTES // 2:
                    yield Words(texts, languages)
                    texts, languages = [], []
        if texts:
            yield Words(texts, languages)


def keys(hashes: np.ndarray, partitions: int) -> np.ndarray:
    """Hash partition in the high bits, 32 bits of the hash below."""
    return (hashes >> np.uint64(32)) % np.uint64(partitions) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)


def counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 32-bit values and the sums of their weights (all 1 by default)."""
    if weights is None:
        packed = np.sort(values.astype(np.uint64))
        first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.zeros(0, dtype=np.int64)
        return packed[first], np.diff(np.append(first, len(packed)))
    packed = np.sort(values.astype(np.uint64) << np.uint64(32) | weights.astype(np.uint64))
    value = packed >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, dtype=np.int64)
    return value[first], np.add.reduceat((packed & np.uint64(0xFFFFFFFF)).astype(np.int64), first) if len(first) else np.zeros(0, dtype=np.int64)


class Summary:
    """A mergeable Misra-Gries summary: at most ``capacity`` counters, none too low by more than ``error``."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.key, self.count = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, key: np.ndarray, count: np.ndarray) -> None:
        self.waiting.append((key, count))
        self.held += len(key)
        if self.held > 4 * self.capacity + (1 << 16):
            self.settle()

    def settle(self) -> None:
        key = np.concatenate([self.key, *(k for k, _ in self.waiting)])
        count = np.concatenate([self.count, *(c for _, c in self.waiting)])
        self.waiting, self.held = [], 0
        self.key, self.count = counted(key, count)
        beyond = len(self.key) - self.capacity
        if beyond > 0:
            off = int(np.partition(self.count, beyond - 1)[beyond - 1])
            kept = self.count > off
            self.key, self.count, self.error = self.key[kept], self.count[kept] - off, self.error + off

    def at_least(self, threshold: int) -> np.ndarray:
        """Every key whose total may reach the threshold."""
        self.settle()
        return self.key[self.count + self.error >= threshold]


BLOCK_SCHEMA = pa.schema([("part", pa.int32()), ("mass", pa.int64()), ("often", pa.binary()), ("counts", pa.binary()), ("once", pa.binary())])
BLOCK_DDL = "part int, mass long, often binary, counts binary, once binary"


def block_summaries(words: Words, longest: int, threshold: int, partitions: int) -> pa.RecordBatch:
    """Per hash partition one row with the mass and one with the keys: those counted more than once with their counts, the others."""
    key, count = counted(keys(np.concatenate([h for _, _, h in words.phrases(longest)]), partitions))
    count = np.minimum(count, threshold)
    part = (key >> np.uint64(32)).astype(np.int64)
    rest = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
    present = np.unique(part)
    cuts = np.append(np.searchsorted(part, present), len(part))
    rows = []
    for number, start, stop in zip(present.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        k, c = rest[start:stop], count[start:stop]
        often = c > 1
        rows.append((number, int(c.sum()), None, None, None))
        rows.append((number, 0, k[often].tobytes(), c[often].astype("<u4").tobytes(), k[~often].tobytes()))
    return record_batch(BLOCK_SCHEMA, list(zip(*rows, strict=True)) if rows else [[]] * 5)


def survivors(texts: DataFrame, longest: int, threshold: int) -> tuple[DataFrame, int]:
    """The keys of all phrases that may reach the threshold, and the number of hash partitions."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = min(MOST_PARTITIONS, max(1, -(-int(size) // PARTITION_BYTES)))

    def split(batches):
        for words in blocks_of_words(batches):
            if len(words.number):
                yield block_summaries(words, longest, threshold, partitions)

    def merge(batches):
        schema = pa.schema([("key", pa.int64())])
        current, mass, summary = None, 0, None

        def result():
            found = summary.at_least(threshold) if summary else np.zeros(0, dtype=np.uint64)
            return record_batch(schema, [(found | np.uint64(current) << np.uint64(32)).astype(np.int64)])

        for batch in batches:
            for row in range(batch.num_rows):
                part, more = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                if part != current:
                    if current is not None:
                        yield result()
                    current, mass, summary = part, 0, None
                if more:
                    mass += more
                    continue
                summary = summary or Summary(2 * mass // threshold + 1)
                often, counts, once = (np.frombuffer(batch.column(k)[row].as_buffer(), dtype="<u4") for k in (2, 3, 4))
                summary.add(often.astype(np.uint64), counts.astype(np.int64))
                summary.add(once.astype(np.uint64), np.ones(len(once), dtype=np.int64))
        if current is not None:
            yield result()

    # The rows with the masses come first, so the capacity is known before the first summary.
    found = (texts.mapInArrow(split, BLOCK_DDL).repartitionById(partitions, "part")
             .sortWithinPartitions("part", F.desc("mass")).mapInArrow(merge, "key long"))
    return materialize(found, "phrase-keys"), partitions


class Slice:
    """A sorted slice of keys behind a bit filter."""

    def __init__(self, key: np.ndarray):
        self.key = key
        self.bits = np.zeros(1 << FILTER_BITS - 3, dtype=np.uint8)
        at = self._place(key)
        np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    @staticmethod
    def _place(key: np.ndarray) -> np.ndarray:
        return ((key ^ key >> np.uint64(FILTER_BITS)) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)

    def holds(self, key: np.ndarray) -> np.ndarray:
        """Places in ``key`` whose value is in the slice."""
        at = self._place(key)
        likely = np.flatnonzero(self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
        near = np.minimum(np.searchsorted(self.key, key[likely]), max(len(self.key) - 1, 0))
        return likely[self.key[near] == key[likely]] if len(self.key) else likely[:0]


_SLICES: dict[str, Slice] = {}


def held_slice(name: str, shared) -> Slice:
    """The slice of a broadcast, built once in a worker; only the latest stays."""
    if name not in _SLICES:
        _SLICES.clear()
        _SLICES[name] = Slice(shared.value)
    return _SLICES[name]


COUNT_SCHEMA = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("size", pa.int32()), ("phrases", pa.binary()), ("counts", pa.binary())])
COUNT_DDL = "part int, lang string, size int, phrases binary, counts binary"
SUM_SCHEMA = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])
SUM_DDL = "lang string, size int, phrase string, f long"


def exact_counts(words: Words, n: int, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, counts and keys of the distinct phrases that begin at ``at``; equal keys are compared word by word."""
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key)))
    like = np.repeat(at[first], count)
    same = words.language[at] == words.language[like]
    for k in range(n):
        same &= words.number[at + k] == words.number[like + k]
    if same.all():
        return at[first], count, key[first]
    table_of = np.column_stack([words.language[at], *(words.number[at + k] for k in range(n))])
    _, first, count = np.unique(table_of, axis=0, return_index=True, return_counts=True)
    return at[first], count, key[first]


def block_counts(words: Words, longest: int, partitions: int, known: Slice, totals: bool) -> pa.RecordBatch:
    """Phrases and counts of a block, one row for each hash partition, language and length. Size 0 counts all words."""
    rows = []
    if totals:
        for language, n in enumerate(np.bincount(words.language, minlength=len(words.languages)).tolist()):
            rows.append((0, words.languages[language], 0, b"", np.int64(n).tobytes()))
    for n, at, hashes in words.phrases(longest):
        key = keys(hashes, partitions)
        found = known.holds(key)
        if not len(found):
            continue
        first, count, key = exact_counts(words, n, at[found], key[found])
        group = (key >> np.uint64(32)).astype(np.int64) * len(words.languages) + words.language[first]
        order = np.argsort(group, kind="stable")
        first, count, group = first[order], count[order].astype("<i8"), group[order]
        spelled = [b" ".join(row) for row in zip(*([words.spelling[w] for w in words.number[first + k].tolist()] for k in range(n)), strict=True)]
        present = np.unique(group)
        cuts = np.append(np.searchsorted(group, present), len(group))
        for number, start, stop in zip(present.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part, language = divmod(number, len(words.languages))
            rows.append((part, words.languages[language], n, b"\n".join(spelled[start:stop]), count[start:stop].tobytes()))
    return record_batch(COUNT_SCHEMA, list(zip(*rows, strict=True)) if rows else [[]] * 5)


def summed(counts: DataFrame, partitions: int, threshold: int) -> DataFrame:
    """The blocks' counts added up by phrase; a task holds the surviving phrases of one hash partition at a time."""

    def merge(batches):
        current, held = None, {}

        def result():
            for (language, size), found in held.items():
                often = [(x.decode(), f) for x, f in found.items() if f >= threshold or not size]
                if often:
                    yield record_batch(SUM_SCHEMA, [[language] * len(often), [size] * len(often), *map(list, zip(*often, strict=True))])

        for batch in batches:
            for part, language, size, phrases, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != current:
                    yield from result()
                    current, held = part, {}
                known = held.setdefault((language, size), {})
                for phrase, f in zip(phrases.split(b"\n"), np.frombuffer(numbers, dtype="<i8").tolist(), strict=True):
                    known[phrase] = known.get(phrase, 0) + f
        yield from result()

    return counts.repartitionById(partitions, "part").sortWithinPartitions("part").mapInArrow(merge, SUM_DDL)


def frequent(docs: DataFrame, longest: int = LONGEST, threshold: int = THRESHOLD) -> DataFrame:
    """``lang, size, phrase, f`` of every phrase of up to ``longest`` words with ``f >= threshold``; size 0 holds all words of the language."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    found, partitions = survivors(texts, longest, threshold)
    slices = max(1, -(-found.count() // SLICE_KEYS))
    counts = None
    for number in range(slices):
        # Hashes are even, so a slice has SLICE_KEYS keys at most but for chance (about 8,000 more).
        part = found.filter(F.pmod(F.xxhash64("key"), F.lit(slices)) == number).toArrow()
        shared = spark.sparkContext.broadcast(np.sort(part.column(0).to_numpy().astype(np.uint64)))

        def count(batches, shared=shared, name=uuid.uuid4().hex, totals=number == 0):
            for words in blocks_of_words(batches):
                if len(words.number):
                    yield block_counts(words, longest, partitions, held_slice(name, shared), totals)

        more = texts.mapInArrow(count, COUNT_DDL)
        counts = more if counts is None else counts.unionByName(more)
    return materialize(summed(counts, partitions, threshold), "phrases")


def parts(words: Column, sizes: Column) -> Column:
    """All runs of the given sizes in an array of words, as strings."""
    return F.flatten(F.transform(sizes, lambda s: F.transform(F.sequence(F.lit(1), F.size(words) - s + 1),
                                                              lambda i: F.array_join(F.slice(words, i, s), " "))))


def collocations(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases by score."""
    known = frequent(docs, longest, threshold)
    totals = known.filter("size = 0").select("lang", F.col("f").alias("n"))
    words = F.split("phrase", " ")
    candidates = known.filter("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"))
    inner = (candidates.filter("size > 2").select("lang", "a", F.explode(parts(words, F.sequence(F.lit(2), F.col("size") - 1))).alias("phrase"))
             .groupBy("lang", "phrase").agg(F.max("a").alias("within")))
    kept = (candidates.join(inner, ["lang", "phrase"], "left")
            .filter(F.col("within").isNull() | (F.col("within") * 100 < F.col("a") * 100)).drop("within"))
    cuts = (kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
            .select("lang", "phrase", "a", "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("first"),
                    F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " ").alias("rest")))
    side = lambda key, f: known.filter("size > 0").select("lang", F.col("phrase").alias(key), F.col("f").alias(f), F.col("f").alias("weight"))
    cuts = join_per_key(cuts, side("first", "l"), ["lang", "first"], "weight")
    cuts = join_per_key(cuts, side("rest", "r"), ["lang", "rest"], "weight")
    cuts = join_per_key(cuts, totals.withColumn("weight", F.col("n")), ["lang"], "weight")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    scored = (cuts.withColumn("above", F.lit(1000).cast("decimal(4,0)") * (big("a") * big("n"))).withColumn("below", big("l") * big("r"))
              .withColumn("score", F.expr("above div below")))
    lowest = (scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
              .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = lowest.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    ranked = first.filter(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, s.size, array_to_string(w[i:i + s.size - 1], ' ') AS phrase
  FROM words, (SELECT unnest(range(1, 6)) AS size) s, unnest(range(1, len(w) - s.size + 2)) AS u(i)),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY lang),
f AS (SELECT lang, size, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + s.size - 1], ' ') AS phrase, max(a) AS within
  FROM candidates c, (SELECT unnest(range(2, 5)) AS size) s, unnest(range(1, c.size - s.size + 2)) AS u(i)
  WHERE s.size < c.size GROUP BY ALL),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN inside i ON c.lang = i.lang AND c.phrase = i.phrase
  WHERE i.within IS NULL OR 100 * i.within < 100 * c.a),
cuts AS (
  SELECT k.lang, k.phrase, k.a, u.cut, l.f AS l, r.f AS r, t.n, 1000 * k.a * t.n // (l.f * r.f) AS score
  FROM kept k, unnest(range(1, k.size)) AS u(cut), f l, f r, totals t
  WHERE l.lang = k.lang AND l.phrase = array_to_string(k.w[1:u.cut], ' ')
    AND r.lang = k.lang AND r.phrase = array_to_string(k.w[u.cut + 1:], ' ') AND t.lang = k.lang),
lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""
