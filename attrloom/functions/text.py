"""Column functions on names and cells.

Patterns spell the whitespace class out, since Java's ``\\s`` and ``trim`` know only ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that count as whitespace.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# Cell texts a spreadsheet or CSV reader takes as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Attribute texts that mark a header row.
HEADER_WORDS = r"(?iu)^(field[%s]*label|attribute|key|column|header|name|label|field|value|#|no\.?)$" % WS

# Abbreviations and the words they stand for.
ABBREVIATIONS = {
    "stat": "status",
    "add": "address",
    "addr": "address",
    "no": "number",
    "num": "number",
    "req": "required",
    "del": "delivery",
    "tot": "total",
    "ord": "order",
    "qty": "quantity",
    "amt": "amount",
    "inv": "invoice",
    "curr": "currency",
    "rep": "representative",
    "cust": "customer",
    "bill": "billing",
    "ship": "shipping",
    "wh": "warehouse",
    "pay": "payment",
    "py": "payment",
    "pri": "priority",
    "trk": "tracking",
    "typ": "type",
    "cel": "celsius",
    "kmpl": "kmpl",
    "cc": "cc",
    "per": "percentage",
    "pct": "percentage",
}

# Path parts that carry no meaning in a name.
PATH_NOISE = ("data", "root", "record", "records")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def collapse(c: Column | str) -> Column:
    """Strip, and turn every run of whitespace into one space."""
    return F.regexp_replace(strip(c), f"[{WS}]+", " ")


def words(c: Column | str) -> Column:
    """Whitespace-separated words; empty array for a blank text."""
    return F.filter(F.split(col(c), f"[{WS}]+"), lambda w: w != "")


def blank_na(c: Column | str) -> Column:
    """Cell text with the missing-value tokens turned into null."""
    return F.when(~col(c).isin(*NA_TOKENS), col(c))


def clean_cell(c: Column | str) -> Column:
    """Stripped text; null, ``nan`` and ``none`` become empty."""
    s = strip(F.coalesce(col(c), F.lit("")))
    return F.when(F.lower(s).isin("nan", "none"), F.lit("")).otherwise(s)


def clean_cells(cells: Column | str) -> Column:
    return F.transform(col(cells), clean_cell)


def normalize_column_name(c: Column | str) -> Column:
    """Cleaned, lower-cased, with underscores and dashes as spaces."""
    return strip(F.regexp_replace(F.lower(clean_cell(c)), f"[_{WS}-]+", " "))


def is_header_row(attribute: Column | str, value: Column | str) -> Column:
    """The pair is a header line, not data."""
    a = strip(F.coalesce(col(attribute), F.lit("")))
    v = strip(F.coalesce(col(value), F.lit("")))
    pair = F.lower(a).isin("field label", "attribute", "name") & F.lower(v).isin("value", "values")
    return (a == "") | a.rlike(HEADER_WORDS) | pair


def is_numeric_only(attribute: Column | str) -> Column:
    """Only digits, separators and whitespace."""
    return col(attribute).rlike(r"(?U)\A[\d%s.,]+\z" % WS)


def row_pair(cells: Column | str) -> Column:
    """C4: ``struct(attribute, value)`` of the first and second non-empty cell; both empty when there are fewer than two."""
    def pair(filled: Column) -> Column:
        both = F.size(filled) >= 2
        return F.struct(F.when(both, F.get(filled, F.lit(0))).otherwise(F.lit("")).alias("attribute"),
                        F.when(both, F.get(filled, F.lit(1))).otherwise(F.lit("")).alias("value"))

    return let(F.filter(clean_cells(cells), lambda x: x != ""), pair)


def row_to_pair(cells: Column | str) -> tuple[Column, Column]:
    """C4: the fields of ``row_pair``."""
    pair = row_pair(cells)
    return pair["attribute"], pair["value"]


def normalize(c: Column | str) -> Column:
    """Strip, lower, collapse whitespace."""
    return F.regexp_replace(F.lower(strip(c)), f"[{WS}]+", " ")


def snake_to_space(c: Column | str) -> Column:
    """Underscores and dashes as spaces, then D1."""
    return normalize(F.regexp_replace(col(c), r"[_\-]+", " "))


def expand_abbreviations(spaced: Column | str) -> Column:
    """D3: every known abbreviation among the words of a D2 text spelled out."""
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    spelled = F.transform(words(spaced), lambda t: F.coalesce(F.element_at(table, t), t))
    return F.array_join(spelled, " ")


def tokens(c: Column | str) -> Column:
    """Distinct words longer than one character."""
    return F.array_distinct(F.filter(words(c), lambda t: F.length(t) > 1))


def forms(c: Column | str) -> Column:
    """The distinct spellings D1, D2 and D3 of D2, in that order."""
    spaced = snake_to_space(c)
    return F.array_distinct(F.array(normalize(c), spaced, expand_abbreviations(spaced)))


def lines(c: Column | str) -> Column:
    """Stripped non-blank lines."""
    return F.filter(F.transform(F.split(col(c), LINE_BREAK), strip), lambda ln: ln != "")


def friendly_name(path: Column | str) -> Column:
    """Readable name of a dotted path."""
    def part_text(p: Column) -> Column:
        spaced = F.regexp_replace(p, "[_-]", " ")
        return strip(F.lower(F.regexp_replace(spaced, "([a-z])([A-Z])", "$1 $2")))

    parts = F.filter(F.split(strip(path), r"\."), lambda p: ~F.lower(p).isin(*PATH_NOISE))
    return F.array_join(F.filter(F.transform(parts, part_text), lambda p: p != ""), " ")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, where lambdas would otherwise repeat it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compute_once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """All columns of ``df`` with a costly value that later filters and columns read and do not compute again.

    The optimizer copies an expression into every filter that is moved below it, but not one that an explode gives.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def explode_costly(df: DataFrame, items: Column | str, name: str, pos: str = "_pos") -> DataFrame:
    """All columns of ``df`` with one row per item of an array that is costly to compute.

    An outer explode and a filter behind it: below an inner explode the optimizer puts a non-empty
    test that computes the whole array a second time.
    """
    return df.select("*", F.posexplode_outer(col(items)).alias(pos, name)).filter(F.col(pos).isNotNull())
