"""Personal data: validated base patterns, plus spans a boosted classifier selects among wide candidates.

Base spans (e-mail, IP, card, phone) are leftmost, non-overlapping matches per kind that pass their
check. High-recall generators propose further, overlapping spans: separated digit groups, long digit
runs, dotted numbers, spelled-out e-mail addresses. Boosted trees score each proposal from its format
and its context, never from what the base checks test (the plus sign, the check digit, the ranges), so
they learn from the base spans of a bounded sample how personal data looks and carry that over to forms
the base patterns miss. For that every base span of the sample is also rewritten in its place without what
the base looks for: addresses are spelled out, phone numbers lose the plus and the country, card numbers
their check digit. A proposal that looks like a positive but has no label is no negative. Calibrated probabilities are cut per kind at a held-out precision; overlapping
selections go to the higher probability, and never touch a base span.

Defined results: null and empty texts have no spans; repeated documents each get their row; without
documents or without any candidate nothing is added to the base spans; extra columns are kept by
``redact`` and ignored by ``find_spans``. Positions are code points, ends are exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrloom.llm import boosting
from attrloom.llm.common import doc_texts, record_batch, row_blocks, table

KINDS = ["email", "ip", "card", "phone"]
#: Documents the classifier is fitted on, at most.
SAMPLE_DOCUMENTS = 20_000
#: Examples for each of these documents, on average and at most.
EXAMPLES_EACH = 20
#: Held-out precision from which on a probability selects a span.
PRECISION = 0.98

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Every base match but e-mail lies inside one such stretch. Possessive and start-bound forms keep the scans linear.
STRETCH = re.compile(r"[+0-9][+0-9 ().-]*")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}(?: ?[(\[]dot[)\]] ?[A-Za-z0-9._%+-]{1,64}){0,4} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,64}(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{1,64}){1,8}", re.I)
GROUPS = re.compile(r"\(?[0-9]{2,5}\)?[ .-]{1,2}[0-9]{3,5}(?:[ .-][0-9]{3,5}){1,3}")
RUN = re.compile(r"(?<![0-9])[0-9]{9,19}(?![0-9])")
DOTTED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def count_digits(text: str) -> int:
    return sum("0" <= c <= "9" for c in text)


def emails(text: str) -> list[tuple[int, int]]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def stretches(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in STRETCH.finditer(text) if m.end() - m.start() >= 7]


def base_spans(text: str, areas: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """``(kind number, start, end)``, by kind and start."""
    found = [(0, a, b) for a, b in emails(text)]
    for a, b in areas:
        for m in IP.finditer(text, a, b):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((1, *m.span()))
        for m in CARD.finditer(text, a, b):
            if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                found.append((2, *m.span()))
        if "+" in text[a:b]:
            for m in PHONE.finditer(text, a, b):
                if 8 <= count_digits(m[0]) <= 15:
                    found.append((3, *m.span()))
    return sorted(found)


def proposals(text: str, areas: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """High-recall candidates; they may overlap each other and base spans."""
    found = set()
    if "at)" in text or "at]" in text or "AT)" in text or "AT]" in text:
        found |= {(0, *m.span()) for m in SPELLED.finditer(text)}
    for a, b in areas:
        found |= {(1, *m.span()) for m in DOTTED.finditer(text, a, b)}
        for m in GROUPS.finditer(text, a - (text[a - 1:a] == "("), b):
            found.add((2 if count_digits(m[0]) >= 13 else 3, *m.span()))
        for m in RUN.finditer(text, a, b):
            found.add((2 if m.end() - m.start() >= 13 else 3, *m.span()))
    return sorted(found)


WORDS_NEAR = ("card", "visa", "phone", "tel", "call", "mail", "contact", "ip", "host", "token", "key", "id", "no", "ref")


def features(text: str, area: tuple[int, int], kind: int, start: int, end: int) -> list[int]:
    """Format of the span and what stands around its stretch, as integers below 64."""
    span = text[start:end]
    left, right = min(start, area[0]), max(end, area[1])
    before, after = text[max(0, left - 24):left], text[right:right + 12]
    near = before.lower()
    groups = re.findall(r"[0-9]+", span)
    last = before.rstrip()[-1:]
    return [min(63, x) for x in (
        kind, len(span), count_digits(span), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        span.count(" "), span.count("."), span.count("-"), span.count("("), len({*span} & set("0123456789")),
        2 if before[-1:].isalpha() else 1 if before[-1:].isspace() or not before else 0,
        2 if after[:1].isalpha() else 1 if after[:1].isspace() or not after else 0,
        1 + "=:\"'|#/_".find(last) if last else 0, 1 + "=:\"'|#/_,.".find(after.lstrip()[:1]) if after.strip() else 0,
        1 + next((k for k, w in enumerate(WORDS_NEAR) if w in near), 62), sum(c.isalpha() for c in span), sum(c.isdigit() for c in text[left:start] + text[end:right]), len(re.findall(r"\. | \.", span)))]



def candidates(text: str) -> tuple[list, list, np.ndarray]:
    """Base spans, proposals, and the proposals' features."""
    areas = stretches(text)
    base, wide = base_spans(text, areas), proposals(text, areas)
    rows = np.zeros((len(wide), 19), dtype=np.int64)
    at = 0
    for k, (kind, start, end) in enumerate(sorted(wide, key=lambda x: x[1])):
        while at < len(areas) and areas[at][1] <= start:
            at += 1
        inside = at < len(areas) and areas[at][0] <= start and end <= areas[at][1]
        rows[k] = features(text, areas[at] if inside else (start, end), kind, start, end)
    return base, sorted(wide, key=lambda x: x[1]), rows


#: The first features describe the form of a span alone: two proposals alike in these are look-alikes.
FORM = 10
SENTENCE = re.compile(r"([A-Za-z]{2,20}) ([A-Za-z]{2,20})\. ([A-Za-z]{2,20})")
CONTEXT = 64


def rewritten(text: str, kind: int, start: int, end: int) -> list[str]:
    """Forms of a base span that the base patterns do not take."""
    span = text[start:end]
    if kind == 0:
        local, domain = span.split("@", 1)
        return [f"{local if dot == '.' else local.replace('.', dot)}{at}{domain.replace('.', dot)}" for at, dot in
                ((" (at) ", "."), ("(at)", "."), (" [at] ", "."), ("[at]", "."), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "[dot]"))]
    if kind == 2:
        return [span[:-1] + str((int(span[-1]) + 1) % 10)]
    if kind == 3:
        inside = [span[a:b] for k, a, b in proposals(span, [(0, len(span))]) if k == 3]
        return [span[1:], *inside]
    return []


def examples(text: str) -> tuple[list[list[int]], list[bool]]:
    """Features and labels a text gives: its proposals, and its base spans rewritten where they stand.

    A proposal is positive if it lies inside a base span of its kind; a phone number counts only as rewritten, since the
    plus in front of it would show. A spelled-out address has no label as it stands and is left out. An ``(at)`` between the words of two sentences is the negative of a spelled-out address.
    """
    base, wide, rows = candidates(text)
    data, labels = [], []
    # Base spans of one kind do not overlap, so only the last that begins in time can hold a proposal.
    spans = {kind: sorted((a, b) for k, a, b in base if k == kind) for kind in range(len(KINDS))}
    for (kind, start, end), row in zip(wide, rows.tolist(), strict=True):
        at = bisect_right(spans[kind], (start, math.inf)) - 1
        own = at >= 0 and end <= spans[kind][at][1]
        if kind != 0 and not (own and kind == 3):
            data.append(row)
            labels.append(own)
    made = [(kind, a, b, form, True) for kind, a, b in base for form in rewritten(text, kind, a, b)]
    if any(kind == 0 for kind, _, _ in base):
        m = SENTENCE.search(text)
        if m:
            made += [(0, m.start(), m.end(), f"{m[1]} {at} {m[2]}. {m[3]}", False) for at in ("(at)", "[at]")]
    for kind, a, b, form, label in made:
        left, right = text[max(0, a - CONTEXT):a], text[b:b + CONTEXT]
        _, found, rows = candidates(left + form + right)
        for (k, start, end), row in zip(found, rows.tolist(), strict=True):
            if k == kind and len(left) <= start and end <= len(left) + len(form):
                data.append(row)
                labels.append(label)
    return data, labels


class Model:
    def __init__(self, trees: boosting.Trees | None, cuts: list[float]):
        self.trees, self.cuts = trees, cuts

    def select(self, base: list, wide: list, rows: np.ndarray) -> list[tuple[int, int, int]]:
        """Base spans and the added ones, by kind and start."""
        if self.trees is None or not wide:
            return base
        chance = self.trees.probability(rows)
        taken = bytearray(max(end for _, _, end in [*base, *wide]))
        for _, start, end in base:
            taken[start:end] = b"\1" * (end - start)
        chosen = list(base)
        for k in np.argsort(-chance, kind="stable"):
            kind, start, end = wide[k]
            if chance[k] >= self.cuts[kind] and taken.find(1, start, end) < 0:
                chosen.append(wide[k])
                taken[start:end] = b"\1" * (end - start)
        return sorted(chosen)


def fit(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS, precision: float = PRECISION, examples_each: int = EXAMPLES_EACH) -> Model:
    """Fit on the candidates of at most ``sample`` different rows, the first by the hash of id and text, and of these on at most
    ``sample * examples_each`` examples.

    A proposal of phone or card kind without a label that has the form of a positive may be personal data the base misses and
    is left out. A fifth of the sample is held out for the calibration and the cuts.
    """
    def gather(batches):
        for batch in row_blocks(batches):
            data, labels, fold = [], [], []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, known = examples(text)
                data += rows
                labels += known
                fold += [number % 5 == 0] * len(rows)
            if data:
                yield record_batch(schema, [data, labels, fold])

    schema = pa.schema([("x", pa.list_(pa.int64())), ("y", pa.bool_()), ("held", pa.bool_())])
    plain = doc_texts(docs).filter(F.col("text").rlike(r"[0-9][0-9 ().-]{5}|[(\[]at[)\]]|@"))
    plain = plain.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("number"), "text")
    # The sample ends at one hash; equal rows have equal hashes and count once.
    last = plain.select("number").distinct().orderBy("number").limit(sample).agg(F.max("number")).first()[0]
    few = plain.filter(F.col("number") <= (last if last is not None else 0)).dropDuplicates(["number"])
    found = (few.mapInArrow(gather, "x array<long>, y boolean, held boolean")
             .orderBy(F.xxhash64("x", "y", "held")).limit(sample * examples_each).toArrow())
    if not found.num_rows or not 0 < sum(found["held"].to_pylist()) < found.num_rows:
        # Without examples on both sides of the fold nothing can be learnt or calibrated: the base spans alone.
        return Model(None, [2.0] * len(KINDS))
    x = np.array(found["x"].to_pylist(), dtype=np.int64)
    y, held = (np.array(found[c].to_pylist(), dtype=bool) for c in ("y", "held"))
    forms = {tuple(r) for r in x[y & (x[:, 0] >= 2), :FORM].tolist()}
    sure = y | (x[:, 0] < 2) | ~np.array([tuple(r) in forms for r in x[:, :FORM].tolist()], dtype=bool)
    x, y, held = x[sure], y[sure], held[sure]
    order = np.lexsort((*x.T, y, held))
    x, y, held = x[order], y[order].astype(float), held[order]
    trees = boosting.calibrate(boosting.fit(x[~held], y[~held]), x[held], y[held])
    chance = trees.probability(x[held])
    return Model(trees, [boosting.cut_for_precision(chance[k], y[held][k], precision) for kind in range(len(KINDS)) for k in [x[held][:, 0] == kind]])


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def find_spans(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id`` and its spans by kind (email, ip, card, phone) and start. Narrow: no shuffle."""
    known = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(SPAN))])

    def run(batches):
        judge = known.value
        for batch in row_blocks(batches):
            found = []
            for text in batch.column(1).to_pylist():
                base, wide, rows = candidates(text)
                sure = set(base)
                found.append([{"kind": KINDS[k], "start": a, "end": b, "base": (k, a, b) in sure} for k, a, b in judge.select(base, wide, rows)])
            yield record_batch(schema, [batch.column(0), found])

    return doc_texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>")


def blank_out(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span becomes its kind in brackets; of overlapping spans the union takes the first one's kind."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model | None = None, column: str = "text") -> DataFrame:
    """``docs`` with every span of ``column`` replaced; nulls stay null. Narrow."""
    known = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    place = docs.columns.index(column)

    def run(batches):
        judge = known.value
        for batch in row_blocks(batches, column):
            texts = []
            for text in batch.column(place).to_pylist():
                base, wide, rows = candidates(text) if text else ([], [], None)
                spans = judge.select(base, wide, rows)
                texts.append(blank_out(text, spans) if spans else text)
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, type=batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)


def op8_pii(spark, folder: str) -> DataFrame:
    found = find_spans(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
