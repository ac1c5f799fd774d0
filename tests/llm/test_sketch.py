"""Short texts inside long ones."""

import math
import random

import numpy as np
import pytest

from attrloom.llm import sketch


def shingles(text):
    words = text.split()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("n", [5, 14, 20, 60])
def test_short_text_in_long_one_is_exact(n):
    rng = random.Random(n)
    for _ in range(40):
        long = [f"w{rng.getrandbits(30)}" for _ in range(1500)]
        at = rng.randrange(1500 - n)
        short, long = " ".join(long[at:at + n]), " ".join(long)
        a, b = sketch.sketch(short.encode()), sketch.sketch(long.encode())
        x, y = shingles(short), shingles(long)
        assert sketch.containment(a, b) == 1.0
        assert sketch.containment(b, a) == len(x & y) / len(y)
        assert sketch.likeness(a, b) == len(x & y) / len(x | y)


def test_stand_in_is_compared_where_both_are_known():
    rng, seen = random.Random(1), 0
    for _ in range(200):
        long = [f"w{rng.getrandbits(30)}" for _ in range(600)]
        a, b = (sketch.sketch(" ".join(x).encode(), 16) for x in (long[50:62], long))
        inside = sketch.containment(a, b, 16)
        if a[0] >= np.uint64((1 << 48) // 16):
            seen += 1
            assert math.isnan(inside)
        else:
            assert inside == 1.0
    assert seen > 50
