"""Case N3: documents of all six formats through one plan, with those that cannot be read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrloom.functions import text as tx
from attrloom.plans.mixed import DocumentInputs, document_records
from suite import freetext_cases, grid_cases, nested_cases  # noqa: F401
from suite import sqlparts as q
from suite.registry import ORACLES, Tables, case

# The documents of the cases of each format, under a prefix of their own.
SUFFIX = {"x": "xlsx", "c": "csv", "p": "PDF", "d": "docx", "j": "json", "m": "xml"}


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumn("doc_id", F.concat(F.lit(prefix), F.col("doc_id").cast("string")))


def _inputs(t: Tables) -> DocumentInputs:
    lines = tx.explode_costly(t.documents.select("doc_id", "text"), tx.lines("text"), "line", "row_no")
    csv = lines.select("doc_id", F.lit("").alias("sheet"), F.col("row_no").cast("bigint").alias("row_no"), F.array("line").alias("cells"))
    rows, text_lines = t.sql(grid_cases._table_rows(q.SPARK)), t.sql(grid_cases._text_lines(q.SPARK))
    bad = t.region.select(F.concat(F.lit("jr"), "r_regionkey").alias("doc_id"), F.lit('{"open": ').alias("text"))
    named = {"x": grid_cases._grid(t), "c": t.documents, "p": text_lines, "d": text_lines, "j": nested_cases._order_json(t), "m": nested_cases._part_xml(t)}
    ids = [_prefixed(df.select("doc_id").distinct(), k).withColumn("path", F.concat(F.lit("in/"), "doc_id", F.lit(f".{SUFFIX[k]}"))) for k, df in named.items()]
    ids += [bad.select("doc_id", F.lit("bad.json").alias("path")),
            t.nation.select(F.concat(F.lit("n"), "n_nationkey"), F.when(F.col("n_nationkey") % 2 == 0, "a.exe").otherwise("gone.xml"))]
    paths = ids[0]
    for more in ids[1:]:
        paths = paths.union(more)
    both = lambda df: _prefixed(df, "p").union(_prefixed(df, "d"))
    columns = ["doc_id", "sheet", "row_no", "cells"]
    return DocumentInputs(paths, _prefixed(grid_cases._grid(t).select(columns), "x").union(_prefixed(csv, "c")), both(rows), both(text_lines),
                          _prefixed(named["j"], "j").union(_prefixed(named["m"], "m")).union(bad))


def _counted(records: str) -> str:
    return f"(SELECT doc_id, count(*) AS n FROM ({ORACLES[records]}) r GROUP BY doc_id)"


_TYPES = ORACLES["s05_s06_document_types"]


@case("n03_mixed_documents", f"""
    SELECT 'x' || doc_id AS doc_id, 'excel' AS input_format, doc_type, coalesce(n, 0) AS n_records, NULL AS error
      FROM ({ORACLES["n03_excel_document_types"]}) k LEFT JOIN {_counted("n03_excel_documents")} c USING (doc_id)
    UNION ALL SELECT 'c' || doc_id, 'csv', doc_type, n_records, NULL FROM ({ORACLES["n03_narrative_csv_documents"]}) k
    UNION ALL SELECT 'p' || doc_id, 'pdf', doc_type, coalesce(n, 0), NULL FROM ({_TYPES}) k LEFT JOIN {_counted("t03_routed_pdf_records")} c USING (doc_id)
    UNION ALL SELECT 'd' || doc_id, 'docx', doc_type, coalesce(n, 0), NULL FROM ({_TYPES}) k LEFT JOIN {_counted("t03_routed_docx_records")} c USING (doc_id)
    UNION ALL SELECT 'j' || doc_id, 'json', 'json', count(*), NULL FROM {nested_cases.JSON_ROWS} r GROUP BY doc_id
    UNION ALL SELECT 'm' || doc_id, 'xml', 'xml', count(*), NULL FROM {nested_cases.XML_ROWS} r GROUP BY doc_id
    UNION ALL SELECT 'jr' || r_regionkey, 'json', NULL, 0, 'malformed' FROM region
    UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE 'xml' END, NULL, 0, CASE WHEN n_nationkey % 2 = 0 THEN 'unknown format' ELSE 'nothing was read' END FROM nation
    UNION ALL SELECT 'c' || doc_id, 'csv', NULL, 0, 'nothing was read' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({ORACLES["n03_narrative_csv_documents"]}) k)""")
def n03_mixed(t: Tables):
    """Every document once: its format, kind and records, or why it was not read."""
    records, docs, errors = document_records(_inputs(t))
    counted = records.groupBy("doc_id").agg(F.count("*").alias("n"))
    read = docs.join(counted, "doc_id", "left").select("doc_id", "input_format", "doc_type", F.coalesce("n", F.lit(0)).alias("n_records"), F.lit(None).cast("string").alias("error"))
    return read.unionByName(errors.select("doc_id", "input_format", F.lit(None).cast("string").alias("doc_type"), F.lit(0).cast("bigint").alias("n_records"), "error"))
