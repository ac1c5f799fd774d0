"""Cases K1-K5 on normalized orders and sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from attrloom.operators import grids as gr
from attrloom.plans.normalize import normalize_records
from attrloom.session import scratch_path
from attrloom.sinks import writers as wr
from attrloom.sources.dictionary import seed_dictionary
from suite import sqlparts as q
from suite.grid_cases import GRID, WIDE, _prepared
from suite.matching_cases import CASCADE
from suite.registry import Tables, case

NORMALIZED = "nr AS (SELECT doc_id, pos, canonical_attr AS attribute, value FROM matched)"


def _normalized(t: Tables):
    return normalize_records(t.sql(q.order_names(q.SPARK)), seed_dictionary(t.spark))


# Extra source columns of the sheets that the projection carries.
EXTRAS = ["Note", "Key", "Note_2", "col_4", "col_6", "Item", "Amount", "Remark", "Remark_2", "col_1", "col_2", "col_3", "col_5"]


def _extra(name: str) -> str:
    return f"CASE WHEN list_position(headers, {q.lit(name)}) > 0 THEN cells[list_position(headers, {q.lit(name)})] END AS \"{name}\""


@case("k01_output_projection", f"""WITH {GRID}, {_prepared('g')}, {WIDE}
    SELECT attribute AS "Output Attribute", value AS "Value", {', '.join(_extra(c) for c in EXTRAS)}, CASE WHEN list_position(headers, 'Value') > 0 THEN cells[list_position(headers, 'Value')] END AS "Value_src" FROM wide""")
def k01(t: Tables):
    wide = gr.extract_wide(t.sql(q.sheets(q.SPARK))).withColumn("Value_src", F.element_at("extras", F.lit("Value")))
    records = wide.withColumn("extras", F.map_filter("extras", lambda k, v: k != "Value"))
    return wr.output_projection(records, wr.extra_columns(records))


@case("k02_csv_files", f"{CASCADE}, {NORMALIZED} SELECT doc_id, attribute AS \"Output Attribute\", value AS \"Value\" FROM nr")
def k02(t: Tables):
    path = scratch_path(t.spark, "out-csv")
    wr.write_csv(_normalized(t), path)
    return t.spark.read.csv(path, header=True, escape='"', schema="doc_id bigint, `Output Attribute` string, Value string", nullValue="\u0001", emptyValue="")


@case("k03_json_documents", f"""{CASCADE}, {NORMALIZED}
    SELECT doc_id, '[' || string_agg('{{"attribute":' || to_json(attribute)::varchar || ',"value":' || to_json(value)::varchar || '}}', ',' ORDER BY pos) || ']' AS json FROM nr GROUP BY doc_id""".replace("{{", "{").replace("}}", "}"))
def k03(t: Tables):
    return wr.json_documents(_normalized(t))


@case("k03_json_files", f"{CASCADE}, {NORMALIZED} SELECT doc_id, attribute, value FROM nr")
def k03b(t: Tables):
    path = scratch_path(t.spark, "out-json")
    wr.write_json(_normalized(t), path)
    return t.spark.read.json(path, schema="doc_id bigint, attribute string, value string")


def _tag(x: str) -> str:
    safe = f"regexp_replace(lower({x}), '[^a-z0-9_.-]', '_', 'g')"
    return f"(CASE WHEN regexp_matches({safe}, '^[a-z_]') THEN {safe} ELSE '_' || {safe} END)"


def _esc(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


XML_HEAD = "'<?xml version=''1.0'' encoding=''utf-8''?>' || chr(10) || '<normalized_records>'"


@case("k04_xml_documents", f"""{CASCADE}, {NORMALIZED}, e AS (SELECT doc_id, pos, {_tag(q.strip('attribute'))} AS tag, {_esc(q.strip('value'))} AS v FROM nr WHERE {q.strip('attribute')} <> '')
    SELECT doc_id, {XML_HEAD} || string_agg('<' || tag || '>' || v || '</' || tag || '>', '' ORDER BY pos) || '</normalized_records>' AS xml FROM e GROUP BY doc_id""")
def k04(t: Tables):
    return wr.xml_documents(_normalized(t))


@case("k04_xml_nested", f"""
    WITH e AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, CASE WHEN l_linenumber % 2 = 0 THEN 'line' ELSE 'Supply Info' END AS grp, cast(l_partkey AS varchar) AS v FROM lineitem),
    e1 AS (SELECT doc_id, min(pos) AS p, CASE grp WHEN 'line' THEN '<line>' ELSE '<supply_info><deep>' END || string_agg('<part>' || v || '</part>', '' ORDER BY pos, '<part>' || v || '</part>')
        || CASE grp WHEN 'line' THEN '</line>' ELSE '</deep></supply_info>' END AS x FROM e GROUP BY doc_id, grp)
    SELECT doc_id, {XML_HEAD} || string_agg(x, '' ORDER BY p) || '</normalized_records>' AS xml FROM e1 GROUP BY doc_id""")
def k04b(t: Tables):
    name = F.when(F.col("l_linenumber") % 2 == 0, F.lit("line.part")).otherwise(F.lit("Supply Info.deep.part"))
    return wr.xml_documents(t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("bigint").alias("pos"),
                                              name.alias("attribute"), F.col("l_partkey").cast("string").alias("value")))


@case("k05_sheet_folders", f"""WITH {GRID}, {_prepared('g')}, {WIDE}
    SELECT substr('Sheet of the market segment ' || sheet, 1, 31) AS sheet_name, attribute AS "Output Attribute", value AS "Value", {_extra('Note')}, {_extra('Key')} FROM wide""")
def k05(t: Tables):
    path = scratch_path(t.spark, "out-sheets")
    wide = gr.extract_wide(t.sql(q.sheets(q.SPARK))).withColumn("sheet", F.concat(F.lit("Sheet of the market segment "), "sheet"))
    wr.write_tabular(wide, path, extras=["Note", "Key"])
    return t.spark.read.csv(path, header=True, escape='"', schema="sheet_name string, `Output Attribute` string, Value string, Note string, Key string",
                            nullValue="\u0001", emptyValue="")


@case("k05_column_widths", """
    SELECT c_mktsegment AS sheet, c AS "column", cast(least(greatest(length(c), CASE c WHEN 'c_name' THEN a WHEN 'c_acctbal' THEN b ELSE k END) + 4, 45) AS bigint) AS width
    FROM (SELECT c_mktsegment, max(length(c_name)) AS a, max(length(cast(c_acctbal AS varchar))) AS b, max(length(cast(c_custkey AS varchar))) AS k FROM customer GROUP BY 1) m,
         (SELECT unnest(['c_name', 'c_acctbal', 'c_custkey']) AS c) n""")
def k05b(t: Tables):
    table = t.customer.select(F.col("c_mktsegment").alias("sheet"), "c_name", "c_acctbal", "c_custkey")
    return wr.column_widths(table, ["sheet"]).withColumn("width", F.col("width").cast("bigint"))
