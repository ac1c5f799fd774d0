"""Files to grids and document texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attrloom.functions import text as tx
from attrloom.operators.grids import has_content
from attrloom.sources.csvsplit import csv_records

# File suffixes and the format that reads them.
FORMATS = {".pdf": "pdf", ".xlsx": "excel", ".xls": "excel", ".csv": "csv", ".docx": "docx", ".json": "json", ".xml": "xml"}


def file_format(path: Column | str, strict: bool = True) -> Column:
    """Format by lower-cased suffix. An unknown one fails the job, or is null when not strict."""
    suffix = F.lower(F.regexp_extract(tx.col(path), r"[^./\\](\.[^./\\]*)$", 1))
    table = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    known = F.element_at(table, suffix)
    if not strict:
        return known
    return F.coalesce(known, F.raise_error(F.concat(F.lit("Unsupported file type: "), suffix)).cast("string"))


def csv_fields(record: Column | str) -> Column:
    """Fields of a raw CSV record of any width, unquoted. Possessive repeats keep the match linear."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), tx.col(record)), F.lit(r',("[^"]*+(?:""[^"]*+)*+"|[^,]*+)'), F.lit(1))
    return F.transform(fields, lambda f: F.when(
        f.startswith('"') & (F.length(f) > 1), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))


def csv_grid(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Header-less CSV files as a grid ``(doc_id, sheet, row_no, cells)``; missing-value tokens
    become empty, blank rows go, ``doc_id`` is the file.

    Records may have any number of fields. ``multi_line`` allows line breaks in quoted fields; large files
    are divided either way. Without it the CSV reader takes every line as a record, in one scan.
    """
    if multi_line:
        raw = csv_records(spark, path)
        cells, doc_id, row_no = csv_fields(F.regexp_replace("record", r"[\r\n]+\z", "")), F.col("doc_id"), F.col("row_no")
    else:
        raw = spark.read.csv(path, schema="c0 string, _raw string", header=False, quote='"', escape='"',
                             mode="PERMISSIVE", columnNameOfCorruptRecord="_raw")
        # A record with more fields than the schema comes back whole and is taken apart in the row.
        cells, doc_id = F.coalesce(csv_fields(F.regexp_replace("_raw", r"[\r\n]+\z", "")), F.array("c0")), F.col("_metadata.file_path")
        row_no = F.col("_metadata.file_block_start") * F.lit(1 << 16) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    grid = raw.select(doc_id.alias("doc_id"), F.lit("").alias("sheet"), row_no.alias("row_no"),
                      F.transform(cells, lambda c: F.coalesce(tx.blank_na(c), F.lit(""))).alias("cells"))
    return grid.filter(has_content("cells"))


def text_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file with its whole text; undecodable bytes are dropped."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("doc_id"),
                        F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit("")).alias("text"))


def table_grid(df: DataFrame, doc_id: Column, sheet: Column, row_no: Column, columns: list[Column] | None = None) -> DataFrame:
    """Rows of a table as a grid."""
    cells = columns or [F.col(f"`{c}`") for c in df.columns]
    return df.select(doc_id.alias("doc_id"), sheet.alias("sheet"), row_no.cast("bigint").alias("row_no"),
                     F.array(*[c.cast("string") for c in cells]).alias("cells"))
