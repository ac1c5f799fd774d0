"""Hard negatives against brute force."""

import math

import numpy as np
import pytest

from attrloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, planes string, uid long, part int"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], SCHEMA)


def brute(rows, every=50, relabel=7, labels=10):
    known = []
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        known.append((i, (label + 1) % labels if i % relabel == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for at, (a, la, va) in enumerate(known):
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(va, vb)), b, lb) for k, (b, lb, vb) in enumerate(known) if k != at]
        for s, p, _ in sorted(x for x in scored if x[2] == la)[:5]:
            fits = sorted(x for x in scored if x[2] != la and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(a, p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    return sorted(tuple(r) for r in negatives.mine(table_of(spark, rows), **options).collect())


def clustered(n, dims, seed, scale=0.3, centres=6):
    random = np.random.default_rng(seed)
    middle = random.normal(0, scale, (centres, dims))
    return [(i, [float(x) for x in (middle[i % centres] + random.normal(0, scale / 2, dims)).astype(np.float32)], int(random.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize(("dims", "scale"), [(64, 0.2), (13, 3.0), (1, 1.0)])
def test_equals_brute_force(spark, monkeypatch, dims, scale):
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 3)
    rows = clustered(400, dims, dims, scale)
    want = brute(rows)
    assert want and mined(spark, rows) == want


def test_ties_repeats_and_a_hot_vector(spark):
    rows = clustered(300, 8, 1) + [(1000 + i, [0.5] * 8, i % 3) for i in range(300)]
    rows += [rows[50], rows[51], rows[400]]
    assert mined(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    rows = clustered(200, 8, 2)
    rows += [(None, [0.5] * 8, 1), (400, None, 1), (401, [0.1] * 8, None), (450, [float("nan")] * 8, 1), (500, [float("inf")] + [0.1] * 7, 1),
             (550, [None] * 8, 1), (600, [], 1), (601, [0.5] * 3, 2), (650, [0.25] * 8, 3), (-50, [0.3] * 8, 0), (-7, [0.3] * 8, 9)]
    assert mined(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(50, [0.5, 0.5], 1)], [(i, [0.5, 0.1], 1) for i in (1, 2, 50)], [(1, [0.5], 1), (2, [0.5], 2)]])
def test_no_results(spark, rows):
    assert mined(spark, rows) == [] and brute(rows) == []


def test_too_large_components_fail(spark):
    with pytest.raises(ValueError, match="too large"):
        mined(spark, [(50, [1e30], 1), (51, [1e30], 1)])


def test_lookups_equal_products():
    random = np.random.default_rng(3)
    values, anchors = random.integers(-300, 300, (500, 24)), random.integers(-300, 300, (7, 24))
    packed = negatives.pack_planes(values, 10)
    assert (negatives.unpack_planes(packed) == values).all()
    assert (negatives.scores(negatives.subset_sums(anchors, np.int32), packed) == values @ anchors.T).all()
