"""Per-format plans from extracted rows, lines and texts to records.

Every plan returns ``(records, documents)``: records ``(doc_id, pos, attribute, value, ...)`` ready
for matching, and ``documents(doc_id, input_format, doc_type, n_records)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrloom.functions import text as tx
from attrloom.operators import freetext as ft
from attrloom.operators import grids as gr
from attrloom.operators.lookups import if_few, join_per_key
from attrloom.operators.nested import flatten_json, flatten_xml
from attrloom.operators.records import broken_table_flags, dedupe_records, key_value_lines
from attrloom.session import materialize

NO_EXTRAS = "map<string,string>"


def _page_pos(page: str, no: str, row: str | None = None) -> Column:
    """Reading order inside a document as one number."""
    base = F.col(page).cast("bigint") * 1_000_000_000_000
    return base + F.col(no).cast("bigint") * (100_000_000 if row else 1) + (F.col(row).cast("bigint") if row else F.lit(0))


# Tables of a page and rows of a table that have room in the plain number.
PAGE_TABLES, TABLE_ROWS = 10_000, 100_000_000


def _with_row_pos(rows: DataFrame) -> DataFrame:
    """Rows with ``pos``, their place in the document as one number that no other row has.

    Page, table and row are written side by side where they have room. In documents with more tables on a page or
    more rows in a table, a table begins behind the last row of the one before.
    """
    plain = _page_pos("page", "table_no", "row_no")
    large = rows.filter((F.col("table_no") >= PAGE_TABLES) | (F.col("row_no") >= TABLE_ROWS)).select("doc_id")
    if large.isEmpty():
        return rows.withColumn("pos", plain)
    table = ["doc_id", "page", "table_no"]
    sizes = rows.join(large.distinct(), "doc_id", "left_semi").groupBy(*table).agg((F.max("row_no").cast("bigint") + 1).alias("_n"))
    before = Window.partitionBy("doc_id").orderBy("page", "table_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*table, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), "_n")
    placed = join_per_key(rows, starts, table, "_n")
    return placed.withColumn("pos", F.coalesce(F.col("_start") + F.col("row_no"), plain)).drop("_start")


def table_row_records(rows: DataFrame) -> DataFrame:
    """First two filled cells of document table rows, one dedupe scope for the whole document."""
    paired = tx.compute_once(_with_row_pos(rows), tx.row_pair("cells"), "_pair")
    pairs = paired.select("doc_id", "pos", "_pair.attribute", "_pair.value")
    kept = pairs.filter(~tx.is_header_row("attribute", "value") & ~tx.is_numeric_only("attribute"))
    return dedupe_records(kept)


def _stored(records: DataFrame) -> DataFrame:
    """Records are read again for counts and routing, so they are written once."""
    return materialize(records, "records")


def _counts(records: DataFrame, name: str = "n_records") -> DataFrame:
    return records.groupBy("doc_id").agg(F.count("*").alias(name))


def _line_records(lines: DataFrame) -> DataFrame:
    return key_value_lines(lines.select("doc_id", _page_pos("page", "line_no").alias("pos"), "line"))


def _tables_else_lines(table_records: DataFrame, lines: DataFrame) -> DataFrame:
    """Table records, and line records of the documents without any."""
    per_doc = lines.select("doc_id", F.lit(1).alias("is_line")).unionByName(
        table_records.select("doc_id", F.lit(0).alias("is_line")))
    flags = per_doc.groupBy("doc_id").agg(F.max(1 - F.col("is_line")).alias("has_table"), F.count("*").alias("_n"))
    without = join_per_key(lines, flags, ["doc_id"], "_n").filter("has_table = 0").drop("has_table")
    return table_records.unionByName(_line_records(without))


def line_verdicts(lines: DataFrame) -> DataFrame:
    """T1 of line tables, written once for the plans that ask more than once."""
    return materialize(ft.narrative_lines(lines).select("doc_id", "is_narrative", F.col("n_lines").alias("_n")), "verdicts")


def pdf_records(rows: DataFrame, lines: DataFrame, verdict: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Table rows, else key/value lines; nothing for narrative documents, which are tagged.

    ``verdict`` takes the ``line_verdicts`` of the lines where the caller needs them too.
    """
    verdict = line_verdicts(lines) if verdict is None else verdict
    tables = _stored(table_row_records(rows))
    sizes = lines.groupBy("doc_id").agg(F.count("*").alias("_lines"))
    good = broken_table_flags(tables).join(_counts(tables, "_n"), "doc_id").select("doc_id", (~F.col("is_broken")).alias("has_table"), "_n")
    facts = good.join(sizes, "doc_id", "full").join(verdict.select("doc_id", "is_narrative"), "doc_id", "left")
    # What is taken of a document: nothing, its table records, or its line records.
    told = F.coalesce("is_narrative", F.lit(False))
    taken = F.when(told, F.lit("none")).when(F.coalesce("has_table", F.lit(False)), F.lit("tables")).otherwise(F.lit("lines"))
    facts = facts.select("doc_id", taken.alias("_taken"), (F.coalesce("_n", F.lit(0)) + F.coalesce("_lines", F.lit(0))).alias("_n"))
    facts = materialize(facts, "taken")
    from_tables = join_per_key(tables, facts, ["doc_id"], "_n").filter("_taken = 'tables'").drop("_taken")
    from_lines = _line_records(join_per_key(lines, facts, ["doc_id"], "_n").filter("_taken = 'lines'").drop("_taken"))
    kept = _stored(from_tables.unionByName(from_lines))
    return kept, _documents("pdf", rows, lines, verdict, kept)


def docx_records(rows: DataFrame, paragraphs: DataFrame, verdict: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Table rows, else key/value paragraphs; narrative documents are tagged."""
    verdict = ft.narrative_lines(paragraphs) if verdict is None else verdict
    records = _stored(_tables_else_lines(_stored(table_row_records(rows)), paragraphs))
    return records, _documents("docx", rows, paragraphs, verdict, records)


def _documents(fmt: str, rows: DataFrame, lines: DataFrame, verdict: DataFrame, records: DataFrame) -> DataFrame:
    ids = rows.select("doc_id").union(lines.select("doc_id")).distinct()
    kind = F.when(F.coalesce("is_narrative", F.lit(False)), F.lit("unstructured")).otherwise(F.lit("keyvalue"))
    return (ids.join(verdict.select("doc_id", "is_narrative"), "doc_id", "left").join(_counts(records), "doc_id", "left")
            .select("doc_id", F.lit(fmt).alias("input_format"), kind.alias("doc_type"),
                    F.coalesce("n_records", F.lit(0)).alias("n_records")))


def pdf_tables(rows: DataFrame) -> DataFrame:
    """Table rows as maps under their header row, for tables of at least two filled rows."""
    return gr.promote_header(rows, ["doc_id", "page", "table_no"], min_rows=2)


def pdf_text(lines: DataFrame) -> DataFrame:
    """The non-blank lines of all pages as one text."""
    return gr.joined_text(lines, "line", ["page", "line_no"])


def docx_text(rows: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Paragraphs, then table rows joined with bars."""
    head = paragraphs.select("doc_id", F.lit(0).alias("section"), F.col("page").cast("bigint").alias("part"),
                             F.col("line_no").cast("bigint").alias("row_no"), tx.strip("line").alias("line"))
    tail = rows.select("doc_id", F.lit(1).alias("section"), _page_pos("page", "table_no").alias("part"),
                       F.col("row_no").cast("bigint").alias("row_no"), gr.row_text("cells").alias("line"))
    return gr.joined_text(head.unionByName(tail), "line", ["section", "part", "row_no"])


def _with_free_text(structured: DataFrame, texts: DataFrame, routed: DataFrame) -> DataFrame:
    """Records of the routed documents replaced by free-text records."""
    free = ft.extract_chunked(texts.join(routed, "doc_id", "left_semi").select("doc_id", "text"))
    kept = structured.join(routed, "doc_id", "left_anti")
    return kept.unionByName(free, allowMissingColumns=True)


def route_lines(records: DataFrame, documents: DataFrame, texts, rows_and_lines: DataFrame,
                verdict: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """T3 for PDF and DOCX: tagged documents, and those T2 picks, go to free-text extraction.

    ``rows_and_lines`` are the lines as a table, whose statistics decide without any text. ``texts`` are the assembled
    document texts, or a function that assembles those of the documents it is given; then no other text is put together.
    ``verdict`` takes the ``line_verdicts`` of the lines where they are known.
    """
    verdict = ft.narrative_lines(rows_and_lines) if verdict is None else verdict
    facts = verdict.select("doc_id", F.col("is_narrative").alias("_narrative"))
    judged = documents.join(facts, "doc_id", "left").withColumn(
        "_routed", (F.col("doc_type") == "unstructured")
        | (F.coalesce("_narrative", F.lit(False)) & (F.col("n_records") <= 1)))
    if callable(texts):
        judged = materialize(judged, "judged")
        routed = if_few(materialize(judged.filter("_routed").select("doc_id"), "routed"))
        texts = texts(routed)
    else:
        routed = judged.filter("_routed").select("doc_id")
    out = _with_free_text(records, texts, routed)
    kinds = judged.withColumn("doc_type", F.when(F.col("_routed"), F.lit("unstructured")).otherwise(F.col("doc_type")))
    return out, kinds.select(*documents.columns)


def _grid_documents(fmt: str, grid: DataFrame, clean: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E4, T2, T3 for grids: returns records after routing and the document table."""
    flags = gr.sheet_widths(clean).groupBy("doc_id").agg(F.max("is_multicolumn").alias("multi"))
    lines = grid.select("doc_id", "sheet", "row_no", gr.row_text("cells").alias("line"))
    facts = ft.narrative_lines(lines).select("doc_id", "is_narrative")
    judged = (grid.select("doc_id").distinct().join(flags, "doc_id", "left").join(facts, "doc_id", "left")
              .join(_counts(records), "doc_id", "left")
              .withColumn("_routed", F.coalesce("is_narrative", F.lit(False)) & (F.coalesce("n_records", F.lit(0)) <= 1)))
    judged = materialize(judged, "judged")
    routed = if_few(materialize(judged.filter("_routed").select("doc_id"), "routed"))
    texts = gr.joined_text(lines.join(routed, "doc_id", "left_semi"), "line", ["sheet", "row_no"])
    kind = (F.when(F.col("_routed"), F.lit("unstructured"))
            .when(F.coalesce("multi", F.lit(False)), F.lit("multicolumn")).otherwise(F.lit("keyvalue")))
    docs = judged.select("doc_id", F.lit(fmt).alias("input_format"), kind.alias("doc_type"),
                         F.coalesce("n_records", F.lit(0)).alias("n_records"))
    return _with_free_text(records, texts, routed), docs


def _wide_or_pairs(clean: DataFrame, pairs) -> DataFrame:
    """Sheets with more than two columns keep them all, the others give pairs."""
    wide = gr.extract_wide(clean.filter("is_multicolumn").drop("is_multicolumn"))
    narrow = pairs(clean.filter("not is_multicolumn").drop("is_multicolumn"))
    return wide.unionByName(narrow.withColumn("extras", F.lit(None).cast(NO_EXTRAS)))


def excel_records(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """N3 for workbooks given as cell grids."""
    clean = _stored(gr.clean_workbook(grid).withColumn("is_multicolumn", F.col("width") > 2).drop("width"))
    return _grid_documents("excel", grid, clean, _stored(_wide_or_pairs(clean, gr.extract_pairs)))


def csv_records(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """N3 for CSV grids."""
    widths = gr.sheet_widths(grid).select("doc_id", "sheet", "is_multicolumn", F.col("rows").alias("_n"))
    clean = join_per_key(grid, widths, gr.SHEET, "_n")
    return _grid_documents("csv", grid, clean, _stored(_wide_or_pairs(clean, gr.extract_csv_pairs)))


def json_records(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """N3 for JSON texts ``(doc_id, text)``."""
    records = _stored(flatten_json(docs))
    return records, _nested_documents("json", docs, records)


def xml_records(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """N3 for XML texts ``(doc_id, text)``."""
    records = _stored(flatten_xml(docs))
    return records, _nested_documents("xml", docs, records)


def _nested_documents(fmt: str, docs: DataFrame, records: DataFrame) -> DataFrame:
    counts = _counts(records)
    return docs.select("doc_id").join(counts, "doc_id", "left").select(
        "doc_id", F.lit(fmt).alias("input_format"), F.lit(fmt).alias("doc_type"),
        F.coalesce("n_records", F.lit(0)).alias("n_records"))
