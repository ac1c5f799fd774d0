"""Rules of free text, applied to Arrow batches of texts.

The module is shipped to the workers by value; they need no copy of the package.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from attrloom.functions.text import HEADER_WORDS, WS

# What the rules take as \s, and the letters that case-insensitive patterns see as i, s and k.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
FOLDED = (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k"))

KEY_VALUE = re.compile(r"([A-Za-z][^:=\-]{1,80}?)[%s]*[:=\-]+[%s]*(.*)" % (WS, WS))
HEADER = re.compile(HEADER_WORDS.removeprefix("(?iu)"), re.IGNORECASE)
NUMERIC = re.compile(r"[\d%s.,]+" % WS)
DIGIT = re.compile(r"\d")
# Names whose verdict a task remembers.
KNOWN_NAMES = 4096
URGENT = re.compile(r"\burgent\b", re.IGNORECASE)


def compiled(pattern: str, ignore_case: bool = True) -> re.Pattern:
    """A rule's pattern with ``\\s`` spelled out."""
    out, inside = [], False
    for part in re.findall(r"\\.|[\[\]]|[^\\\[\]]+", pattern):
        inside = part == "[" or (inside and part != "]")
        out.append((SPACE if inside else f"[{SPACE}]") if part == r"\s" else part)
    return re.compile("".join(out), re.IGNORECASE if ignore_case else 0)


def triggered(low: str, words: tuple[str, ...], rule):
    """The rule if the folded text holds one of the words without which it finds nothing."""
    if not words:
        return rule
    for word in words:
        if word in low:
            return rule
    return None


def folded(text: str) -> str:
    """Lower case the way case-insensitive patterns see it."""
    if not text.isascii():
        for letter, plain in FOLDED:
            if letter in text:
                text = text.replace(letter, plain)
    return text.lower()


def key_value_pairs(text: str) -> Iterator[tuple[str, str]]:
    for line in text.splitlines():
        if ":" in line or "=" in line or "-" in line:
            pair = KEY_VALUE.fullmatch(line.strip())
            if pair:
                yield pair[1].strip(), pair[2].strip()


def matches(rules, gate: Callable) -> Callable[[str], Iterator[tuple[str, str]]]:
    """Pairs of a text by rules ``(attribute, words, pattern, group, suffix, only the first)``, in their order."""
    rules = [(*rule, not rule[5] and r"\d" in rule[2].pattern) for rule in rules]

    def pairs(text: str) -> Iterator[tuple[str, str]]:
        low = folded(text)
        digits = DIGIT.search(text) is not None
        for attribute, words, pattern, group, suffix, first, needs_digit in rules:
            if (needs_digit and not digits) or gate(low, words, pattern) is None:
                continue
            if first:
                found = pattern.search(text)
                value = found[group].strip() if found and found[group] else ""
                if value:
                    yield attribute, value + suffix
            else:
                for found in pattern.finditer(text):
                    yield attribute, found[group].strip() + suffix

    return pairs


def usable_name(attribute: str) -> bool:
    a = attribute.strip()
    return a != "" and not HEADER.fullmatch(a) and not NUMERIC.fullmatch(a)


def usable_pairs() -> Callable[[str, str], bool]:
    """Whether a pair has a value and a name that is neither a header word nor a number."""
    known: dict[str, bool] = {}

    def usable(attribute: str, value: str) -> bool:
        verdict = known.get(attribute)
        if verdict is None:
            if len(known) >= KNOWN_NAMES:
                known.clear()
            verdict = known[attribute] = usable_name(attribute)
        return verdict and value.strip() != ""

    return usable


def first_pairs(pairs: Callable, column: str, fold_value: bool = False) -> Callable[[Iterator], Iterator]:
    """A batch function: the pairs of every row's ``column``, the first of each name and value, as rows behind its other columns.

    ``pos`` is a pair's place among all of its row.
    """
    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows, places, attributes, values = [], [], [], []
            for row, cell in enumerate(batch.column(column).to_pylist()):
                seen = set()
                for place, (attribute, value) in enumerate(pairs(cell)):
                    key = (attribute.strip().lower(), value.lower() if fold_value else value.strip())
                    if key not in seen:
                        seen.add(key)
                        rows.append(row)
                        places.append(place)
                        attributes.append(attribute)
                        values.append(value)
            rest = batch.drop_columns([column]).take(pa.array(rows, pa.int64()))
            found = [pa.array(places, pa.int64()), pa.array(attributes, pa.string()), pa.array(values, pa.string())]
            yield pa.RecordBatch.from_arrays([*rest.columns, *found], names=[*rest.schema.names, "pos", "attribute", "value"])

    return read
