"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Grades 0 (not toxic) to 3 come from the labels: a toxic document has grade 1, 2 or 3 by how many marker
occurrences it holds, markers being words whose document frequency differs between toxic and other
labelled documents by a z score of ``MARKER_Z``. Features are ``log(1 + count)`` of the words that pass
``FEATURE_Z``. One weight vector is shared by all thresholds: P(grade > k) = sigmoid(w x - theta_k), with
theta increasing; the expected severity is the sum of these. A document is rejected if P(grade > 0) >= 0.5.

Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters.

Defined results: null and empty texts have no features, so they get the intercept's severity; null labels
are ignored; of several labels of a document the larger counts; repeated documents each get their row;
without labels, or without a toxic one, every severity is 0; extra columns are ignored by ``grade`` and kept
by ``drop_toxic``.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrloom.llm.common import doc_texts, record_batch, row_blocks, table
from attrloom.llm.decontaminate import words

#: Labelled documents the model is fitted on, at most (the first by the hash of their id).
SAMPLE_DOCUMENTS = 8000
#: Features, at most (those with the largest z score).
MAX_FEATURES = 2000
FEATURE_Z, MARKER_Z = 5.0, 6.0
#: Marker occurrences from which on a toxic document has grade 2, and grade 3.
GRADE_STEPS = (3, 6)
GRADES = 4


@dataclass
class OrdinalModel:
    weights: dict[bytes, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (30.0, 40.0, 50.0)

    def exceed(self, text: bytes) -> np.ndarray:
        """P(grade > k) for every threshold."""
        weights = self.weights
        counts = Counter(w for w in words(text) if w in weights)
        total = sum(weights[w] * np.log1p(n) for w, n in counts.items())
        return 1.0 / (1.0 + np.exp(np.clip(np.array(self.thresholds) - total, -40, 40)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int,
                steps: int = 400, rate: float = 0.05, ridge: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds by Adam on the mean negative log likelihood of sparse rows."""
    n, cuts = len(grades), GRADES - 1
    w, first, gaps = np.zeros(width), np.array([1.0]), np.zeros(cuts - 1)
    state = [np.zeros(width + cuts), np.zeros(width + cuts)]
    for step in range(1, steps + 1):
        theta = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        score = np.bincount(rows, values * w[columns], n)
        bounds = np.concatenate([[-np.inf], theta, [np.inf]])
        with np.errstate(over="ignore"):
            upper = 1 / (1 + np.exp(-(bounds[grades + 1] - score)))
            lower = 1 / (1 + np.exp(-(bounds[grades] - score)))
        chance = np.maximum(upper - lower, 1e-9)
        g_score = upper + lower - 1  # derivative of the log likelihood
        g_theta = np.zeros(cuts + 2)
        np.add.at(g_theta, grades + 1, upper * (1 - upper) / chance)
        np.add.at(g_theta, grades, -lower * (1 - lower) / chance)
        g_theta = g_theta[1:-1] / n
        g_w = np.bincount(columns, values * g_score[rows], width) / n - ridge * w
        tails = np.cumsum(g_theta[::-1])[::-1]
        gradient = np.concatenate([g_w, tails[:1], tails[1:] * np.exp(gaps)])
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.999 * state[1] + 0.001 * gradient ** 2
        move = rate * (state[0] / (1 - 0.9 ** step)) / (np.sqrt(state[1] / (1 - 0.999 ** step)) + 1e-8)
        w, first, gaps = w + move[:width], first + move[width:width + 1], np.clip(gaps + move[width + 1:], -5, 5)
    return w, np.concatenate([first, first + np.cumsum(np.exp(gaps))])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> OrdinalModel:
    """Select features by Spark counts over the sampled labelled documents, then fit on their few sparse values."""
    spark = docs.sparkSession
    chosen = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id"))
              .agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("label_id"), "label_id").limit(sample))
    picked = doc_texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "toxic", "text")

    def count(batches):
        for batch in row_blocks(batches):
            docs_out, toxic_out, word_out, n_out = [], [], [], []
            for doc, toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for word, n in Counter(words(text.encode())).items():
                    docs_out.append(doc), toxic_out.append(toxic), word_out.append(word), n_out.append(n)
            yield record_batch(schema, [docs_out, toxic_out, word_out, n_out])

    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("word", pa.binary()), ("n", pa.int64())])
    counts = picked.mapInArrow(count, "doc_id long, toxic int, word binary, n long")
    sizes = {r[0]: r[1] for r in picked.groupBy("toxic").count().collect()}
    clean, toxic = sizes.get(0, 0), sum(n for t, n in sizes.items() if t)
    if not toxic or not clean:
        return OrdinalModel()
    pooled = (F.col("a") + F.col("b")) / F.lit(clean + toxic)
    z = (F.col("a") / toxic - F.col("b") / clean) / F.sqrt(pooled * (1 - pooled) * (1 / toxic + 1 / clean) + F.lit(1e-9))
    features = (counts.groupBy("word").agg(F.count_if(F.col("toxic") > 0).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
                .select("word", z.alias("z")).filter(F.abs("z") >= FEATURE_Z)
                .orderBy(F.abs("z").desc(), "word").limit(MAX_FEATURES))
    known = {bytes(r["word"]): r["z"] for r in features.collect()}
    if not known:
        return OrdinalModel()
    index = {word: k for k, word in enumerate(sorted(known))}
    shared = spark.sparkContext.broadcast(index)

    def sparse(batches):
        for batch in row_blocks(batches):
            rows = [(doc, toxic, list(c), list(c.values())) for doc, toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                    for c in [Counter(shared.value[w] for w in words(text.encode()) if w in shared.value)]]
            yield record_batch(sparse_schema, list(zip(*rows, strict=True)) if rows else [[]] * 4)

    sparse_schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("k", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])
    data = sorted(tuple(x) for x in picked.mapInArrow(sparse, "doc_id long, toxic int, k array<int>, n array<int>").collect())
    markers = {index[w] for w, score in known.items() if score >= MARKER_Z}
    held = np.array([sum(n for k, n in zip(r[2], r[3], strict=True) if k in markers) for r in data])
    grades = np.where(np.array([r[1] for r in data]) > 0, 1 + sum((held >= s).astype(int) for s in GRADE_STEPS), 0)
    rows = np.repeat(np.arange(len(data)), [len(r[2]) for r in data])
    columns = np.array([k for r in data for k in r[2]], dtype=np.int64)
    values = np.log1p(np.array([n for r in data for n in r[3]], dtype=float))
    weights, thresholds = fit_ordinal(rows, columns, values, grades, len(index))
    return OrdinalModel({w: float(weights[k]) for w, k in index.items()}, tuple(thresholds.tolist()))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("p_above", pa.list_(pa.float64())), ("rejected", pa.bool_())])


def grade(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """Expected severity (0 to 3), the exceedance probabilities, and the rejection of every document. Narrow."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in row_blocks(batches):
            chances = [known.value.exceed(x.as_buffer().to_pybytes()) for x in batch.column(1).cast(pa.binary())]
            yield record_batch(SCHEMA, [batch.column(0), [float(c.sum()) for c in chances], chances, [bool(c[0] >= 0.5) for c in chances]])

    return doc_texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, severity double, p_above array<double>, rejected boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel, column: str = "text") -> DataFrame:
    """``docs`` without the documents the model rejects, all columns kept. Narrow."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(column)

    def run(batches):
        for batch in row_blocks(batches, column):
            keep = [not x.is_valid or bool(known.value.exceed(x.as_buffer().to_pybytes())[0] < 0.5) for x in batch.column(place).cast(pa.binary())]
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return grade(docs, fit(docs, table(spark, folder, "labels")))
