"""Token counts per section by offset-mapped attribution.

A document is encoded once as a whole. Token byte lengths give character spans, and an interval join of
those sorted spans with the section spans (two binary searches) tells which sections a token touches. A
token that crosses a boundary goes to the section that holds most of its characters, the earlier one on
a tie (``rule="most"``), or to the section of its first character (``rule="first"``).

Sections are the lines of a text, each with its line feed, or begin at the offsets a column gives (code
points; order and repeats do not matter, offsets outside the text are ignored, the first section begins at 0, one
that begins at the end of the text is empty), or are the fields of a record, each with the separator behind it. A
token that holds part of a character counts for the character it starts in.

Defined results: a null or empty text has no tokens and one empty section (as many as fields, for fields); a null
array of offsets stands for the lines; repeated documents each get their row; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrloom.llm.common import record_batch, row_blocks, table
from attrloom.llm.encoder import encoder

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_sections", pa.int64()),
                    ("section_starts", pa.list_(pa.int64())), ("section_tokens", pa.list_(pa.int64())), ("n_crossing", pa.int64())])
DDL = ("doc_id long, n_tokens long, n_sections long, section_starts array<long>, section_tokens array<long>, n_crossing long")


def token_spans(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of the tokens; the characters that start inside a token's bytes, or the one it continues."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    ends = np.cumsum(sizes[ids])
    starts = ends - sizes[ids]
    first = chars[np.minimum(starts + 1, len(data))] - 1
    return first, np.maximum(chars[ends], first + 1)


def attribute(first: np.ndarray, stop: np.ndarray, sections: np.ndarray, length: int, rule: str) -> tuple[np.ndarray, int]:
    """Tokens per section, and how many tokens touch more than one."""
    low = np.searchsorted(sections, first, "right") - 1
    high = np.searchsorted(sections, stop - 1, "right") - 1
    owner = low.copy()
    crossing = np.flatnonzero(high > low)
    if rule == "most":
        bounds = np.append(sections, length)
        for token in crossing:
            touched = np.arange(low[token], high[token] + 1)
            held = np.minimum(bounds[touched + 1], stop[token]) - np.maximum(bounds[touched], first[token])
            owner[token] = touched[np.argmax(held)]
    return np.bincount(owner, minlength=len(sections)), len(crossing)


def line_starts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    starts = np.append(0, np.flatnonzero(points == 10) + 1)
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(points) else starts


def given_starts(starts: list[int | None], length: int) -> np.ndarray:
    return np.array(sorted({0, *(s for s in starts if s is not None and 0 < s <= length)}), dtype=np.int64)


def count_tokens(docs: DataFrame, vocabulary: str | None = None, rule: str = "most", sections: str | None = None) -> DataFrame:
    """Tokens of each document and of each of its sections, which are lines or begin at the offsets in column ``sections``.

    Narrow: no shuffle, one document at a time.
    """
    if rule not in ("most", "first"):
        raise ValueError(f"unknown rule {rule}")

    def run(batches):
        coder = encoder(vocabulary)
        for batch in row_blocks(batches):
            rows = []
            given = batch.column(2).to_pylist() if sections else [None] * batch.num_rows
            for text, offsets in zip(batch.column(1).to_pylist(), given, strict=True):
                ids, starts = coder.encode(text), line_starts(text) if offsets is None else given_starts(offsets, len(text))
                first, stop = token_spans(text, ids, coder.sizes)
                counts, crossing = attribute(first, stop, starts, len(text), rule)
                rows.append((len(ids), len(starts), starts, counts, crossing))
            yield record_batch(SCHEMA, [batch.column(0), *(list(x) for x in zip(*rows, strict=True))])

    offsets = [F.col(f"`{sections}`").cast("array<long>").alias("starts")] if sections else []
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), *offsets).mapInArrow(run, DDL)


def count_field_tokens(records: DataFrame, fields: list[str], separator: str = "\n", vocabulary: str | None = None, rule: str = "most") -> DataFrame:
    """Tokens of each record's joined ``fields``, and of each field with the separator behind it; a null field is empty."""
    if not fields or not separator:
        raise ValueError("fields and a separator are needed")
    texts = [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields]
    starts, at = [], F.lit(0).cast("long")
    for text in texts:
        starts.append(at)
        at = at + F.length(text) + F.lit(len(separator))
    joined = records.select("doc_id", F.concat_ws(separator, *texts).alias("text"), F.array(*starts).alias("starts"))
    return count_tokens(joined, vocabulary, rule, sections="starts")


def op9_token_counts(spark, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"))
