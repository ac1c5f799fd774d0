"""Cell grids to records.

A grid is ``(doc_id, sheet, row_no, cells array<string>)``; a null cell is a missing one. Header rows
are found per sheet by an aggregate and joined back per key, so a sheet may have any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrloom.functions import text as tx
from attrloom.operators.lookups import join_per_key
from attrloom.operators.records import dedupe_records, usable

SHEET = ["doc_id", "sheet"]

# Header texts of an attribute column and of a value column.
ATTRIBUTE_HEADERS = (
    "attribute", "raw_attribute", "field", "field_name", "field label",
    "label", "key", "name", "attribute name", "raw attribute",
)
VALUE_HEADERS = (
    "value", "raw_value", "field_value", "val", "attribute_value",
    "attribute value", "raw value",
)
# Fixed value: the characters of a plain header cell.
PLAIN_CELL = r"\A[A-Za-z0-9 _\-/()%.#]+\z"


def has_content(cells: Column | str) -> Column:
    return F.exists(tx.col(cells), lambda c: tx.clean_cell(c) != "")


def _literals(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def looks_like_header(cells: Column | str) -> Column:
    """An attribute and a value header together, or at least three short plain cells."""
    filled = F.filter(tx.clean_cells(cells), lambda c: c != "")
    names = F.transform(filled, tx.normalize_column_name)
    both = F.arrays_overlap(names, _literals(ATTRIBUTE_HEADERS)) & F.arrays_overlap(names, _literals(VALUE_HEADERS))
    plain = F.forall(filled, lambda c: c.rlike(PLAIN_CELL) & (F.length(c) <= 30))
    return (F.size(filled) > 0) & (both | ((F.size(filled) >= 3) & plain))


def unique_headers(cells: Column | str) -> Column:
    """Blank headers become ``col_{i}``; a repeated one gets its running number."""
    base = F.transform(tx.col(cells), lambda c, i: F.when(
        tx.clean_cell(c) == "", F.concat(F.lit("col_"), (i + 1).cast("string"))).otherwise(tx.clean_cell(c)))

    def numbered(ordered: Column) -> Column:
        # Equal headers stand together after the sort, so a group's numbers are those up to the next group's start.
        new = F.transform(ordered, lambda x, i: F.when((i == 0) | (F.get(ordered, i - 1)["b"] != x["b"]), i))
        nth = tx.let(F.filter(new, lambda i: i.isNotNull()), lambda starts: F.flatten(F.transform(
            starts, lambda at, k: F.sequence(F.lit(1), F.coalesce(F.get(starts, k + 1), F.size(ordered)) - at))))
        placed = F.array_sort(F.zip_with(ordered, nth, lambda x, n: F.struct(x["i"].alias("i"), x["b"].alias("b"), n.alias("n"))))
        return F.transform(placed, lambda x: F.when(x["n"] == 1, x["b"]).otherwise(F.concat(x["b"], F.lit("_"), x["n"].cast("string"))))

    def named(names: Column) -> Column:
        ordered = F.array_sort(F.transform(names, lambda b, i: F.struct(b.alias("b"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(names)) == F.size(names), names).otherwise(tx.let(ordered, numbered))

    return tx.let(base, named)


def attribute_position(headers: Column | str) -> Column:
    """Index of the attribute column, the first column without a better one."""
    hit = F.array_position(F.transform(tx.col(headers), lambda h: tx.normalize_column_name(h).isin(*ATTRIBUTE_HEADERS)), True)
    return F.when(hit > 0, hit - 1).otherwise(F.lit(0)).cast("int")


def value_position(headers: Column | str) -> Column:
    """Index of the value column, the second column (or only one) without a better one."""
    hit = F.array_position(F.transform(tx.col(headers), lambda h: tx.normalize_column_name(h).isin(*VALUE_HEADERS)), True)
    fallback = F.least(F.lit(1), F.size(tx.col(headers)) - 1)
    return F.when(hit > 0, hit - 1).otherwise(fallback).cast("int")


def clean_workbook(grid: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Missing-value tokens to null, all-null rows and columns dropped, cells stripped, blank rows
    dropped; ``width`` is the number of columns left in the sheet."""
    keys = keys or SHEET
    nulled = grid.withColumn("cells", F.transform("cells", tx.blank_na)).filter(F.exists("cells", lambda c: c.isNotNull()))
    used = F.filter(F.sequence(F.lit(0), F.size("cells") - 1), lambda i: F.get(F.col("cells"), i).isNotNull())
    columns = (nulled.select(*keys, F.explode(used).alias("_c"))
               .groupBy(*keys).agg(F.sort_array(F.collect_set("_c")).alias("_columns"), F.count("*").alias("_n")))
    joined = join_per_key(nulled, columns, keys, "_n")
    kept = F.transform("_columns", lambda c: tx.strip(F.coalesce(F.get(F.col("cells"), c), F.lit(""))))
    return (joined.withColumn("cells", kept).withColumn("width", F.size("cells")).drop("_columns")
            .filter(has_content("cells")))


def prepare_grid(grid: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cleaned non-blank rows with the ``headers`` of their sheet; a header row is consumed."""
    return _prepared(grid, keys or SHEET)


def _prepared(grid: DataFrame, keys: list[str], at: Column | None = None) -> DataFrame:
    """``prepare_grid``, with ``at``, which follows from the headers, as ``_at``."""
    clean = grid.withColumn("cells", tx.clean_cells("cells")).filter(has_content("cells"))
    top = clean.groupBy(*keys).agg(
        F.min_by("cells", "row_no").alias("first"), F.min("row_no").alias("first_no"),
        F.max(F.size("cells")).alias("width"), F.count("*").alias("_n"))
    padded = F.concat("first", F.array_repeat(F.lit(""), F.col("width") - F.size("first")))
    header = top.select(*keys, "_n", looks_like_header("first").alias("has_header"), "first_no", padded.alias("padded"), "width")
    generic = F.transform(F.sequence(F.lit(1), F.col("width")), lambda i: F.concat(F.lit("col_"), i.cast("string")))
    header = header.select(*keys, "_n", "has_header", "first_no",
                           F.when(F.col("has_header"), unique_headers("padded")).otherwise(generic).alias("headers"))
    rows = join_per_key(clean, header if at is None else header.withColumn("_at", at), keys, "_n")
    full = F.concat("cells", F.array_repeat(F.lit(""), F.size("headers") - F.size("cells")))
    return (rows.filter(~F.col("has_header") | (F.col("row_no") > F.col("first_no")))
            .withColumn("cells", full).drop("has_header", "first_no"))


def extract_wide(grid: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Records of a grid with more than two columns, all source columns kept in ``extras``."""
    keys = keys or SHEET
    # The columns are looked for once per sheet, and cells and pair made once per row.
    at = F.struct(attribute_position("headers").alias("attribute"), value_position("headers").alias("value"))
    prepared = tx.compute_once(_prepared(grid, keys, at), F.col("cells"), "_cells")
    pair = F.struct(F.get("_cells", F.col("_at.attribute")).alias("attribute"), F.get("_cells", F.col("_at.value")).alias("value"))
    pairs = tx.compute_once(prepared, pair, "_pair").select(
        *keys, F.col("row_no").alias("pos"), "_pair.attribute", "_pair.value", "headers", F.col("_cells").alias("cells"))
    # The extras are built behind the dedupe, whose shuffle then carries every cell once.
    kept = dedupe_records(usable(pairs), keys, also=["cells"])
    return kept.withColumn("extras", F.map_from_arrays("headers", "cells")).drop("headers", "cells")


def _row_pairs(grid: DataFrame, keys: list[str]) -> DataFrame:
    """The first two filled cells of every row, looked for once."""
    paired = tx.compute_once(grid.select(*keys, F.col("row_no").alias("pos"), "cells"), tx.row_pair("cells"), "_pair")
    return paired.select(*keys, "pos", "_pair.attribute", "_pair.value")


def extract_pairs(grid: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First two filled cells of every row; header lines go, first (name, value) per sheet stays."""
    keys = keys or SHEET
    return dedupe_records(_row_pairs(grid, keys).filter(~tx.is_header_row("attribute", "value")), keys)


def extract_csv_pairs(grid: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First two filled cells of every row unless the first is a header word; no dedupe."""
    pairs = _row_pairs(grid, keys or SHEET)
    return pairs.filter((F.col("attribute") != "") & ~F.lower("attribute").isin("field label", "attribute", "name"))


def sheet_widths(grid: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Columns per sheet and whether it is read with all its columns."""
    widths = grid.groupBy(*(keys or SHEET)).agg(F.max(F.size("cells")).alias("width"), F.count("*").alias("rows"))
    return widths.withColumn("is_multicolumn", F.col("width") > 2)


def promote_header(grid: DataFrame, keys: list[str] | None = None, min_rows: int = 1) -> DataFrame:
    """The first row as header, blank headers as ``Col{i}``, every later row as a map.

    A table is as wide as its widest row, so cells right of the header row get headers ``Col{i}`` too. ``min_rows`` non-blank rows are needed for a table to count.
    """
    keys = keys or SHEET
    filled = grid.filter(has_content("cells"))
    top = filled.groupBy(*keys).agg(
        F.min_by("cells", "row_no").alias("first"), F.min("row_no").alias("first_no"),
        F.max(F.size("cells")).alias("width"), F.count("*").alias("_n"))
    padded = F.concat("first", F.array_repeat(F.lit(""), F.col("width") - F.size("first")))
    names = F.transform(padded, lambda c, i: F.when(
        tx.clean_cell(c) == "", F.concat(F.lit("Col"), i.cast("string"))).otherwise(tx.clean_cell(c)))
    header = top.filter(F.col("_n") >= min_rows).select(*keys, "_n", "first_no", names.alias("headers"))
    rows = join_per_key(filled, header, keys, "_n").filter(F.col("row_no") > F.col("first_no"))
    full = F.concat(tx.clean_cells("cells"), F.array_repeat(F.lit(""), F.size("headers") - F.size("cells")))
    return rows.select(*keys, "row_no", "headers", full.alias("cells"),
                       F.map_from_arrays("headers", full).alias("row"))


TEXT_BLOCK = 4096


def joined_text(lines: DataFrame, line: Column | str, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """The non-blank lines of a document as one text, in order.

    Two steps: stretches of neighbouring lines are joined first, so the last step gathers a few
    stretches per document instead of all its lines.
    """
    keys = keys or ["doc_id"]
    kept = lines.select(*keys, *order, tx.col(line).alias("_line")).filter(tx.strip("_line") != "")
    first = order[:-1]
    stretch = (F.col(order[-1]) - F.pmod(F.col(order[-1]), F.lit(TEXT_BLOCK))).alias("_stretch")
    gather = lambda by, what: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, what))), lambda s: s[what]), "\n")
    parts = kept.groupBy(*keys, *first, stretch).agg(gather([order[-1]], "_line").alias("_part"))
    whole = parts.groupBy(*keys).agg(gather([*first, "_stretch"], "_part").alias("text"))
    return whole.withColumn("text", tx.strip("text"))


def row_text(cells: Column | str) -> Column:
    """The non-blank cells of a row joined with bars."""
    return F.array_join(F.filter(tx.clean_cells(cells), lambda c: c != ""), " | ")


def grid_text(grid: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One text per document of a grid."""
    return joined_text(grid.withColumn("_row_text", row_text("cells")), "_row_text", order or ["sheet", "row_no"])
