"""Personal data in forms the base patterns do not take."""

import random

import numpy as np
import pytest

from attrloom.llm import pii


def prose(rng, n):
    return " ".join(rng.choice(("the", "report", "came", "late", "again", "river", "stone", "green")) for _ in range(n))


def card(rng, right):
    while True:
        digits = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        if pii.luhn(digits) == right:
            return " ".join(digits[k:k + 4] for k in range(0, 16, 4))


def address(rng):
    return f"{rng.choice(('ann', 'bob', 'carl'))}.{rng.choice(('lee', 'moss', 'dahl'))}{rng.randrange(100)}", rng.choice(("mail.example.org", "post.net", "firm.co.uk"))


def number(rng):
    return f"{rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"


HIDDEN = {"email": lambda r: "{0} (at) {1}".format(*address(r)), "email_dots": lambda r: "{0}[at]{1}".format(*address(r)).replace(".", "[dot]"),
          "phone": number, "card": lambda r: card(r, False)}


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    rows, hidden = [], {}
    for doc in range(1500):
        text = f"{prose(rng, 9)}. The {prose(rng, 6)}. Write to {'@'.join(address(rng))} or call +1 {number(rng)} today, card {card(rng, True)}. {prose(rng, 5)}"
        if doc % 2:
            kind = rng.choice(list(HIDDEN))
            form = HIDDEN[kind](rng)
            text += f". {dict(e='Write to', p='call', c='card')[kind[0]]} {form} today"
            hidden[doc] = (kind.split("_")[0], text.rindex(form), text.rindex(form) + len(form))
        rows.append((doc, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return docs, hidden, {r.doc_id: r.spans for r in pii.find_spans(docs).collect()}, dict(rows)


@pytest.mark.parametrize("kind", ["email", "phone", "card"])
def test_forms_the_base_misses_are_found(tables, kind):
    _, hidden, spans, texts = tables
    mine = {doc: x for doc, x in hidden.items() if x[0] == kind}
    found = [doc for doc, (_, a, b) in mine.items() if any(s.kind == kind and not s.base and s.start == a and s.end == b for s in spans[doc])]
    assert len(mine) > 100 and len(found) > 0.95 * len(mine)


def test_sentences_are_no_addresses(spark, tables):
    docs, *_ = tables
    model = pii.fit(docs)
    plain = spark.createDataFrame([(1, "They looked (at) stones. Then the river came late")], "doc_id long, text string")
    assert pii.find_spans(plain, model).first().spans == []


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 5 * i, lambda i: 1])
def test_the_sample_is_of_rows(spark, ids):
    rows = [(ids(i), f"note {i} call +1 (974) 555-{3000 + i} or mail a{i}.b@mail{i}.example.org now. Then go home") for i in range(1500)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gathered = []
    real = pii.boosting.fit
    pii.boosting.fit = lambda x, y: gathered.append(len(x)) or real(x, y)
    try:
        model = pii.fit(docs, sample=50)
    finally:
        pii.boosting.fit = real
    assert model.trees is not None and 50 < gathered[0] <= 50 * pii.EXAMPLES_EACH


def test_selection_is_not_quadratic():
    import time

    class Sure:
        def probability(self, rows):
            return np.linspace(1, 0.99, len(rows))

    wide = [(3, 10 * k + d, 10 * k + d + 8) for k in range(50_000) for d in (0, 2)]
    start = time.time()
    got = pii.Model(Sure(), [0.0] * 4).select([(0, 0, 4)], wide, np.zeros((len(wide), 1)))
    assert time.time() - start < 5 and got[0] == (0, 0, 4) and len(got) == 50_000
