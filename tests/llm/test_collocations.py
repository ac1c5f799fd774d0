"""Phrases against brute force; the summaries' guarantee."""

import re
from collections import Counter

import numpy as np
import pytest

from attrloom.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, phrase string, size int, f long, part int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, 2, 3) for i, (t, lang) in enumerate(rows)], SCHEMA)


def brute(rows, threshold=100, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            f.update((lang, *words[i:i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    often = {k: v for k, v in f.items() if v >= threshold}
    inside = Counter()
    for (lang, *w), v in often.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                inside[(lang, *w[i:i + size])] = max(inside[(lang, *w[i:i + size])], v)
    found = {}
    for (lang, *w), a in often.items():
        if len(w) < 2 or 100 * inside[(lang, *w)] >= 100 * a:
            continue
        score, k = min((1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s)
                  for lang, rows in found.items() for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


def mined(spark, rows, **options):
    return sorted(tuple(r) for r in collocations.collocations(docs_of(spark, rows), **options).collect())


def made(n, seed, words=40):
    random = np.random.default_rng(seed)
    known = np.array([f"W{k}é" if k % 5 else f"w{k}" for k in range(words)])
    weight = 1 / np.arange(1, words + 1)
    rows = []
    for i in range(n):
        picked = known[random.choice(words, int(random.integers(0, 80)), p=weight / weight.sum())].tolist()
        for at in range(0, len(picked), 7):
            picked[at] += str(random.choice([".", ",", "\n", "\x0b", " \t ", "!?"]))
        text = " ".join(picked) + (" The quick brown fox jumps over. New York City" if i % 3 == 0 else "")
        rows.append((text, [None, "und", "en", "de"][i % 4]))
    return rows


@pytest.mark.parametrize("threshold", [100, 20, 1])
def test_equals_brute_force(spark, monkeypatch, threshold):
    monkeypatch.setattr(collocations, "PARTITION_BYTES", 20_000)
    rows = made(600 if threshold > 1 else 40, threshold)
    want = brute(rows, threshold)
    assert want and mined(spark, rows, threshold=threshold) == want


def test_slices_and_top(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_KEYS", 500)
    monkeypatch.setattr(collocations, "RANK_PARTS", 3)
    rows = made(600, 7)
    assert mined(spark, rows, threshold=30, top=20) == brute(rows, 30, 20)


def test_one_phrase_in_most_rows_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 4000)
    rows = [("of the, of the same kind of the " * 400, "en")] * 6 + [("a " * 30_000, "en"), ("one piece without end " * 2000, "de")] + made(50, 3)
    assert mined(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, None)], [("", "en"), ("  \t\n .,", None)], [("a b", "en")] * 99])
def test_no_results(spark, rows):
    assert mined(spark, rows) == [] == brute(rows)


def test_summary_keeps_every_frequent_key():
    random = np.random.default_rng(5)
    stream = np.concatenate([np.repeat(np.arange(50), 120), random.integers(1000, 400_000, 300_000)]).astype(np.uint64)
    random.shuffle(stream)
    summary = collocations.Summary(2 * len(stream) // 100 + 1)
    for start in range(0, len(stream), 5000):
        summary.add(*collocations.counted(stream[start:start + 5000]))
        summary.settle()
    kept = summary.at_least(100)
    assert 0 < summary.error < 50 and len(summary.key) <= summary.capacity
    assert set(range(50)) <= set(kept.tolist()) and len(kept) < 5000


def test_equal_hashes_are_told_apart():
    words = collocations.Words([b"a b c d a b"], ["en"])
    at = np.arange(5)
    first, count, _ = collocations.exact_counts(words, 2, at, np.zeros(5, dtype=np.uint64))
    assert sorted((words.spelling[words.number[i]], words.spelling[words.number[i + 1]], c) for i, c in zip(first.tolist(), count.tolist())) == [
        (b"a", b"b", 2), (b"b", b"c", 1), (b"c", b"d", 1), (b"d", b"a", 1)]


def test_numbers_past_64_bits(spark):
    from pyspark.sql import functions as F
    row = spark.range(1).select(F.lit(4 * 10**12).cast("decimal(19,0)").alias("a"), F.lit(10**13).cast("decimal(19,0)").alias("n"))
    row = row.select((F.lit(1000).cast("decimal(4,0)") * (F.col("a") * F.col("n"))).alias("above"), (F.col("a") * F.col("a")).alias("below"))
    assert row.select(F.expr("above div below")).first()[0] == 1000 * 10**13 // (4 * 10**12)
