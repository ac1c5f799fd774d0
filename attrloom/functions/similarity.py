"""Similarity expressions that stay on the JVM.

The token-sort ratio is ``100 * (1 - d / (|a| + |b|))`` with ``d`` the insert/delete distance of the
two texts after sorting their words; ``d`` follows from the longest common subsequence. Its length is
computed with the published bit-vector recurrence (Crochemore et al. 2001, Hyyro 2004): one
and/add/or step per character of the query against per-character position masks of the other text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attrloom.functions.text import col, words

# Positions of a text that fit one bigint with room for the carry.
MASK_BITS = 62

# Letters from frequent to rare in English; the order only steers how selective a block is.
LETTERS_BY_FREQUENCY = " etaoinrshdlucmfywgpbvkxqjz"


def sorted_words(c: Column | str) -> Column:
    return F.array_join(F.array_sort(words(c)), " ")


def chars(c: Column | str) -> Column:
    return F.filter(F.split(col(c), ""), lambda x: x != "")


def position_masks(cs: Column | str) -> Column:
    """Character -> bit mask of its positions; null for texts beyond MASK_BITS characters."""
    cs = col(cs)

    def mask(x: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(cs) - 1), lambda j: F.get(cs, j) == x)
        bit = lambda j: F.call_function("shiftleft", F.lit(1).cast("bigint"), j)
        return F.aggregate(at, F.lit(0).cast("bigint"), lambda acc, j: acc.bitwiseOR(bit(j)))

    keys = F.array_distinct(cs)
    return F.when(F.size(cs).between(1, MASK_BITS), F.map_from_arrays(keys, F.transform(keys, mask)))


def lcs_by_masks(query_chars: Column | str, masks: Column | str, length: Column | str) -> Column:
    """Longest common subsequence of a query and a masked text."""
    full = F.call_function("shiftleft", F.lit(1).cast("bigint"), col(length).cast("int")) - 1

    def step(v: Column, c: Column) -> Column:
        m = F.coalesce(F.element_at(col(masks), c), F.lit(0).cast("bigint"))
        u = v.bitwiseAND(m)
        return (v + u).bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(full)

    return F.aggregate(col(query_chars), full, step, lambda v: (col(length) - F.bit_count(v)).cast("int"))


def lcs_by_rows(a_chars: Column | str, b_chars: Column | str) -> Column:
    """Longest common subsequence by dynamic programming, for texts too long for one mask."""
    b = col(b_chars)
    zero = F.array_repeat(F.lit(0), F.size(b) + 1)

    def next_row(row: Column, c: Column) -> Column:
        start = F.array(F.lit(0))
        def cell(acc: Column, j: Column) -> Column:
            taken = F.get(row, j - 1) + 1
            kept = F.greatest(F.get(row, j), F.get(acc, j - 1))
            return F.array_append(acc, F.when(F.get(b, j - 1) == c, taken).otherwise(kept))
        return F.when(F.size(b) > 0, F.aggregate(F.sequence(F.lit(1), F.size(b)), start, cell)).otherwise(start)

    return F.aggregate(col(a_chars), zero, next_row, lambda row: F.get(row, F.size(b)))


def ratio(lcs: Column | str, len_a: Column | str, len_b: Column | str) -> Column:
    """Insert/delete similarity in points, 0 to 100."""
    total = col(len_a) + col(len_b)
    return (F.lit(1.0) - (total - F.lit(2) * col(lcs)).cast("double") / total) * F.lit(100.0)


EPSILON = 1e-9


def shared_needed(len_a: Column, len_b: Column, cut: float) -> Column:
    """Least common subsequence length that brings two lengths to the cut."""
    return F.ceil((len_a + len_b) * F.lit(cut / 200.0) - F.lit(EPSILON)).cast("int")


def shortest_partner(length: Column, cut: float) -> Column:
    return F.ceil(length * F.lit(cut / (200.0 - cut)) - F.lit(EPSILON)).cast("int")


def longest_partner(length: Column, cut: float) -> Column:
    return F.floor(length * F.lit((200.0 - cut) / cut) + F.lit(EPSILON)).cast("int")


def block_tokens(cs: Column | str) -> Column:
    """The characters of a text as numbered tokens, rarest first.

    The second ``e`` of a text is another token than the first, so two texts share as many tokens as
    they share characters, counted with multiplicity. Later occurrences and rare letters sort first.
    """
    cs = col(cs)
    ranks = "".join(chr(0x7A - i) for i in range(len(LETTERS_BY_FREQUENCY)))

    def token(x: Column, i: Column) -> Column:
        nth = F.size(F.filter(F.slice(cs, F.lit(1), i + 1), lambda y: y == x))
        return F.concat(F.lpad((F.lit(999_999_999) - nth).cast("string"), 9, "0"),
                        F.translate(x, LETTERS_BY_FREQUENCY, ranks))

    return F.array_sort(F.transform(cs, token))


# From this cut on blocks are pairs of tokens; below it pairs would outnumber the texts they tell apart.
PAIR_CUT = 70.0


def blocks(tokens: Column | str, length: Column, shared: Column, cut: float) -> Column:
    """Blocking keys of a text that must share ``shared`` of its numbered characters.

    Two texts that share s tokens have at least k of them among their first ``length - s + k`` tokens
    (Chaudhuri et al. 2006), so for s of at least two they meet in a pair of leading tokens.
    """
    tokens = col(tokens)

    def leading(k: int) -> Column:
        return F.slice(tokens, F.lit(1), F.greatest(F.lit(0), F.least(length, length - shared + k)).cast("int"))

    if cut < PAIR_CUT:
        return leading(1)
    first = leading(2)
    pairs = F.flatten(F.transform(first, lambda a, i: F.transform(F.slice(first, i + 2, F.size(first)), lambda b: F.concat(a, b))))
    return F.when(shared >= 2, pairs).otherwise(leading(1))


def leading_grams(vector: Column | str, cut: float) -> Column:
    """The n-grams of a unit vector (rarest first) up to the point from which on the rest is too short
    for a cosine of ``cut`` with any unit vector (Bayardo et al. 2007)."""
    enough = cut * cut * (1 - EPSILON)
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, g: Column) -> Column:
        total = s["sum"] + g["weight"] * g["weight"]
        return F.struct(total.alias("sum"), F.when(total >= enough, F.array_append(s["kept"], g["gram"])).otherwise(s["kept"]).alias("kept"))

    return F.aggregate(F.reverse(col(vector)), start, step, lambda s: s["kept"])


def ngrams(c: Column | str, low: int = 2, high: int = 4) -> Column:
    """Character n-grams inside word boundaries: each word is padded with one space on both sides."""
    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        size = F.length(w) + 2
        def of_size(n: int) -> Column:
            starts = F.when(size >= n, F.sequence(F.lit(1), size - F.lit(n - 1)))
            return F.coalesce(
                F.transform(starts, lambda i: F.substring(padded, i, F.lit(n))),
                F.array().cast("array<string>"),
            )
        return F.concat(*[of_size(n) for n in range(low, high + 1)])

    return F.flatten(F.transform(words(F.lower(col(c))), of_word))


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm2(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str, norm_a: Column, norm_b: Column) -> Column:
    """Cosine of two vectors with known norms; 0 when either is the zero vector."""
    zero = (norm_a == 0) | (norm_b == 0)
    return F.when(zero, F.lit(0.0)).otherwise(dot(a, b) / (norm_a * norm_b))
