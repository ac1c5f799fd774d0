"""The pivot index of the dense tier, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrloom.operators import matching as mt
from attrloom.operators import vectors as vc

CORPUS = "var_no long, form string, canonical string, guard string, vector array<double>"
TEXTS = "text string, vector array<double>"


def frames(spark, corpus, texts):
    rows = [(i, f"f{i}", f"c{i}", None, v) for i, v in enumerate(corpus)]
    return spark.createDataFrame([(f"t{i}", v) for i, v in enumerate(texts)], TEXTS), spark.createDataFrame(rows, CORPUS)


def cosine(a, b):
    if a is None or b is None or not np.isfinite([*a, *b]).all():
        return None
    if not any(a) or not any(b):
        return 0.0  # whatever the dimension
    if len(a) != len(b):
        return None
    total, size_a, size_b = 0.0, 0.0, 0.0
    for x, y in zip(a, b, strict=True):
        total, size_a, size_b = total + x * y, size_a + x * x, size_b + y * y
    return total / (np.sqrt(size_a) * np.sqrt(size_b))


def best_two(corpus, texts, cut):
    """The two best (score, number) of every text at ``cut`` or above."""
    out = {}
    for i, t in enumerate(texts):
        scores = [(cosine(t, v), -n) for n, v in enumerate(corpus)]
        top = sorted((s for s in scores if s[0] is not None), reverse=True)[:2]
        out[f"t{i}"] = [(-n, round(s, 9)) for s, n in top if s >= cut]
    return {t: top for t, top in out.items() if top}


def found(scored):
    out = {}
    for r in scored.collect():
        out.setdefault(r["text"], []).append((r["score"], -r["var_no"]))
    return {t: [(-n, round(s, 9)) for s, n in sorted(rows, reverse=True)[:2]] for t, rows in out.items()}


def clustered(rng, rows, groups=20, dimension=24, spread=0.06, centres=None):
    centres = rng.normal(size=(groups, dimension)) if centres is None else centres
    return centres, (centres[rng.integers(0, len(centres), rows)] + spread * rng.normal(size=(rows, centres.shape[1]))).tolist()


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(vc, "CORPUS_BLOCK", 16)


@pytest.mark.parametrize("cut", [0.62, 0.1, -2.0])
@pytest.mark.parametrize("shuffled", [False, True])
def test_equals_brute_force(spark, small_blocks, monkeypatch, cut, shuffled):
    if shuffled:
        monkeypatch.setattr(vc, "BROADCAST_VECTORS", 0)
        monkeypatch.setattr(vc, "TEXTS_PER_COPY", 5)
    rng = np.random.default_rng(5)
    centres, near = clustered(rng, 150, groups=6, dimension=8)
    corpus = near + rng.normal(size=(150, 8)).tolist()
    corpus += [corpus[0]] * 60 + [[2 * x for x in corpus[1]]] * 3  # a hot cell of copies, and scaled copies
    corpus += [[0.0] * 8, [0.0] * 8, None, [float("nan")] * 8, [1.0] * 7 + [float("inf")], [1.0, 2.0, 3.0], [3.0, 2.0, 1.0]]
    texts = clustered(rng, 30, centres=centres)[1][:25] + rng.normal(size=(25, 8)).tolist() + [corpus[0], corpus[1]]
    texts += [[0.0] * 8, None, [float("nan")] * 8, [1.0, 2.0, 3.1], [1.0]]
    expected = best_two(corpus, texts, cut)
    if cut < 0:  # a text without direction scores 0 with every vector
        assert expected[f"t{len(texts) - 5}"] == [(0, 0.0), (1, 0.0)]
    got = found(vc.embedding_scores(*frames(spark, corpus, texts), cut))
    assert got == expected


def test_few_vectors_are_looked_at_in_clustered_data(spark):
    rng = np.random.default_rng(7)
    centres, corpus = clustered(rng, 3000)
    texts = clustered(rng, 100, centres=centres)[1]
    asked, known = frames(spark, corpus, texts)
    index = vc.PivotIndex(vc.measured(known, "length"), len(corpus), 24)
    query = vc.measured(asked, "q_length")
    looked = index.pairs(query, 0.62).agg(F.sum(F.size("near"))).first()[0]
    # The pivots count as well, since every text is compared with them.
    assert looked + len(texts) * index.pivots.select(F.size("pivots")).first()[0] < 0.2 * len(texts) * len(corpus)
    assert found(vc.embedding_scores(asked, known, 0.62)) == best_two(corpus, texts, 0.62)


def test_blocks_stay_small(spark, monkeypatch):
    monkeypatch.setattr(vc, "CORPUS_BLOCK", 100)
    _, known = frames(spark, [[1.0, 0.5]] * 4000, [])
    index = vc.PivotIndex(vc.measured(known, "length"), 4000, 2)
    assert index.pivots.select(F.size("pivots")).first()[0] == 1
    assert index.blocks().agg(F.max(F.size("members"))).first()[0] < 200


def test_ties_go_to_the_smaller_number_and_empty_tables_stay_empty(spark, small_blocks):
    texts, known = frames(spark, [[1.0, 0.0]] * 40 + [[0.0, 1.0]] * 40, [[1.0, 0.1], [0.0, 2.0]])
    got = mt.embedding_match(texts, known, 0.7, 0.0)
    assert {(r["text"], r["variation"]) for r in got.collect()} == {("t0", "f0"), ("t1", "f40")}
    assert mt.embedding_match(texts, known, 0.7, 0.1).count() == 0
    assert mt.embedding_match(texts.limit(0), known, 0.7, 0.1).count() == 0
    assert mt.embedding_match(texts, known.limit(0), 0.7, 0.1).count() == 0
    lone = mt.embedding_match(texts, known.limit(0).union(known.filter("var_no = 3")), 0.7, 0.1)
    assert [r["variation"] for r in lone.collect()] == ["f3"]
