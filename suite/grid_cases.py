"""Cases S1, S2, S5-S10, S12, C6-C9, E1-E9, T3 on grids, table rows and lines built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from attrloom.functions import text as tx
from attrloom.operators import grids as gr
from attrloom.operators import records as rc
from attrloom.plans import documents as dc
from attrloom.session import scratch_path
from attrloom.sources import files
from suite import sqlparts as q
from suite.registry import Tables, case, order_records

# ------------------------------------------------------------------ DuckDB restatements on grids

NA = "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"
ATTR = "('attribute', 'raw_attribute', 'field', 'field_name', 'field label', 'label', 'key', 'name', 'attribute name', 'raw attribute')"
VAL = "('value', 'raw_value', 'field_value', 'val', 'attribute_value', 'attribute value', 'raw value')"


def _filled(cells: str) -> str:
    return f"len(list_filter({cells}, lambda x_: {q.clean('x_')} <> '')) > 0"


GRID = f"g AS ({q.sheets(q.DUCK)})"
# Workbook cleaning cell by cell: a column survives when any of its cells is not missing.
CLEAN = f"""{GRID},
    g1 AS (SELECT doc_id, sheet, row_no, list_transform(cells, lambda c_: CASE WHEN c_ IN {NA} THEN NULL ELSE c_ END) AS cells FROM g),
    g2 AS (SELECT * FROM g1 WHERE len(list_filter(cells, lambda c_: c_ IS NOT NULL)) > 0),
    cc AS (SELECT doc_id, sheet, row_no, i, cells[i] AS c FROM (SELECT *, unnest(range(1, len(cells) + 1)) AS i FROM g2) u),
    kc AS (SELECT doc_id, sheet, i FROM cc GROUP BY ALL HAVING count(c) > 0),
    wb0 AS (SELECT doc_id, sheet, row_no, list({q.strip("coalesce(c, '')")} ORDER BY i) AS cells FROM cc JOIN kc USING (doc_id, sheet, i) GROUP BY ALL),
    wb AS (SELECT * FROM wb0 WHERE {_filled('cells')})"""


def _prepared(src: str) -> str:
    uniq = ("list_transform(base, lambda b_, i_: CASE WHEN len(list_filter(base[1:i_], lambda y_: y_ = b_)) = 1 THEN b_ "
            "ELSE b_ || '_' || cast(len(list_filter(base[1:i_], lambda y_: y_ = b_)) AS varchar) END)")
    return f"""
    p0 AS (SELECT doc_id, sheet, row_no, {q.clean_list('cells')} AS cells FROM {src} WHERE {_filled('cells')}),
    p1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sheet ORDER BY row_no) AS rn FROM p0),
    ph AS (SELECT doc_id, sheet, cells AS h, list_filter(cells, lambda x_: x_ <> '') AS f FROM p1 WHERE rn = 1),
    ph2 AS (SELECT *, list_transform(f, lambda x_: {q.col_name('x_')}) AS names,
        len(f) >= 3 AND len(list_filter(f, lambda x_: NOT (regexp_full_match(x_, '[A-Za-z0-9 _\\-/()%.#]+') AND length(x_) <= 30))) = 0 AS plain FROM ph),
    ph3 AS (SELECT *, (len(f) > 0) AND (plain OR (len(list_filter(names, lambda x_: x_ IN {ATTR})) > 0 AND len(list_filter(names, lambda x_: x_ IN {VAL})) > 0)) AS has_header,
        list_transform(h, lambda c_, i_: CASE WHEN c_ = '' THEN 'col_' || cast(i_ AS varchar) ELSE c_ END) AS base FROM ph2),
    ph4 AS (SELECT *, CASE WHEN has_header THEN {uniq} ELSE list_transform(h, lambda c_, i_: 'col_' || cast(i_ AS varchar)) END AS headers FROM ph3),
    prep AS (SELECT p1.doc_id, p1.sheet, row_no, cells, headers FROM p1 JOIN ph4 USING (doc_id, sheet) WHERE NOT has_header OR rn > 1)"""


WIDE = f"""
    wd0 AS (SELECT *, coalesce(list_position(list_transform(headers, lambda h_: {q.col_name('h_')} IN {ATTR}), true), 1) AS ai,
        coalesce(list_position(list_transform(headers, lambda h_: {q.col_name('h_')} IN {VAL}), true), least(2, len(headers))) AS vi FROM prep),
    wd1 AS (SELECT *, cells[ai] AS attribute, cells[vi] AS value FROM wd0),
    wd2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sheet, lower(attribute), value, cells ORDER BY row_no) AS rk FROM wd1
            WHERE attribute <> '' AND value <> '' AND NOT {q.is_header('attribute', 'value')} AND NOT {q.numeric_only('attribute')}),
    wide AS (SELECT doc_id, sheet, row_no AS pos, attribute, value, headers, cells FROM wd2 WHERE rk = 1)"""


def _pairs(src: str, out: str) -> str:
    return f"""
    {out}0 AS (SELECT doc_id, sheet, row_no, list_filter({q.clean_list('cells')}, lambda x_: x_ <> '') AS f FROM {src}),
    {out}1 AS (SELECT doc_id, sheet, row_no, f[1] AS attribute, f[2] AS value FROM {out}0 WHERE len(f) >= 2),
    {out} AS (SELECT doc_id, sheet, row_no AS pos, attribute, value FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, sheet, lower(attribute), value ORDER BY row_no) AS rk FROM {out}1
        WHERE NOT {q.is_header('attribute', 'value')}) z WHERE rk = 1)"""


def _grid(t: Tables):
    return t.sql(q.sheets(q.SPARK))


def _bars(c):
    return F.array_join(F.transform(c, lambda x: F.coalesce(x, F.lit("<null>"))), "|")


@case("s02_workbook_cleaning", f"WITH {CLEAN} SELECT doc_id, sheet, row_no, cast(len(cells) AS bigint) AS width, array_to_string(cells, '|') AS cells FROM wb")
def s02(t: Tables):
    return gr.clean_workbook(_grid(t)).select("doc_id", "sheet", "row_no", F.col("width").cast("bigint").alias("width"), _bars("cells").alias("cells"))


@case("c06_looks_like_header", f"WITH {GRID}, {_prepared('g')} SELECT doc_id, sheet, has_header FROM ph3")
def c06(t: Tables):
    rows = _grid(t).filter(gr.has_content("cells"))
    top = rows.groupBy("doc_id", "sheet").agg(F.min_by("cells", "row_no").alias("first"))
    return top.select("doc_id", "sheet", gr.looks_like_header("first").alias("has_header"))


@case("c07_unique_headers", f"WITH {GRID}, {_prepared('g')} SELECT doc_id, sheet, array_to_string(headers, '|') AS headers FROM ph4 WHERE has_header")
def c07(t: Tables):
    rows = _grid(t).filter(gr.has_content("cells"))
    top = rows.groupBy("doc_id", "sheet").agg(F.min_by("cells", "row_no").alias("first"))
    return top.filter(gr.looks_like_header("first")).select("doc_id", "sheet", F.array_join(gr.unique_headers("first"), "|").alias("headers"))


@case("c08_prepared_grid", f"WITH {GRID}, {_prepared('g')} SELECT doc_id, sheet, row_no, array_to_string(headers, '|') AS headers, array_to_string(cells, '|') AS cells FROM prep")
def c08(t: Tables):
    return gr.prepare_grid(_grid(t)).select("doc_id", "sheet", "row_no", _bars("headers").alias("headers"), _bars("cells").alias("cells"))


@case("c09_detected_columns", f"WITH {GRID}, {_prepared('g')}, {WIDE} SELECT DISTINCT doc_id, sheet, headers[ai] AS attribute_column, headers[vi] AS value_column FROM wd0")
def c09(t: Tables):
    p = gr.prepare_grid(_grid(t)).select("doc_id", "sheet", "headers").distinct()
    return p.select("doc_id", "sheet", F.get("headers", gr.attribute_position("headers")).alias("attribute_column"),
                    F.get("headers", gr.value_position("headers")).alias("value_column"))


@case("e01_wide_records", f"""WITH {GRID}, {_prepared('g')}, {WIDE}
    SELECT doc_id, sheet, pos, attribute, value, array_to_string(list_transform(headers, lambda h_, i_: h_ || '=' || cells[i_]), ';') AS extras FROM wide""")
def e01(t: Tables):
    entries = F.transform(F.map_entries("extras"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return gr.extract_wide(_grid(t)).select("doc_id", "sheet", "pos", "attribute", "value", F.array_join(entries, ";").alias("extras"))


@case("e02_sheet_pairs", f"WITH {CLEAN}, {_pairs('wb', 'pr')} SELECT * FROM pr")
def e02(t: Tables):
    return gr.extract_pairs(gr.clean_workbook(_grid(t)))


@case("e03_csv_pairs", f"""WITH {GRID} SELECT doc_id, sheet, row_no AS pos, f[1] AS attribute, f[2] AS value
    FROM (SELECT *, list_filter({q.clean_list('cells')}, lambda x_: x_ <> '') AS f FROM g) u
    WHERE len(f) >= 2 AND lower(f[1]) NOT IN ('field label', 'attribute', 'name')""")
def e03(t: Tables):
    return gr.extract_csv_pairs(_grid(t))


@case("e04_column_branch", f"WITH {CLEAN} SELECT doc_id, sheet, cast(max(len(cells)) AS bigint) AS width, count(*) AS rows, max(len(cells)) > 2 AS is_multicolumn FROM wb GROUP BY doc_id, sheet")
def e04(t: Tables):
    return gr.sheet_widths(gr.clean_workbook(_grid(t))).withColumn("width", F.col("width").cast("bigint"))


# Every fifth row is one cell wider than its sheet.
PROMOTED = f"""{GRID},
    t00 AS (SELECT doc_id, sheet, row_no, CASE WHEN row_no % 5 = 0 THEN list_append(cells, 'extra ' || cast(row_no AS varchar)) ELSE cells END AS cells FROM g),
    t0 AS (SELECT doc_id, sheet, row_no, {q.clean_list('cells')} AS cells, max(len(cells)) OVER (PARTITION BY doc_id, sheet) AS width, row_number() OVER (PARTITION BY doc_id, sheet ORDER BY row_no) AS rn,
           count(*) OVER (PARTITION BY doc_id, sheet) AS n FROM t00 WHERE {_filled('cells')}),
    th AS (SELECT doc_id, sheet, n, width, list_transform(range(width), lambda i_: CASE WHEN coalesce(cells[i_ + 1], '') = '' THEN 'Col' || cast(i_ AS varchar) ELSE cells[i_ + 1] END) AS headers FROM t0 WHERE rn = 1),
    tw AS (SELECT t0.doc_id, t0.sheet, row_no, rn, th.n, array_to_string(headers, '|') AS headers, array_to_string(list_transform(range(th.width), lambda i_: coalesce(cells[i_ + 1], '')), '|') AS cells FROM t0 JOIN th USING (doc_id, sheet) WHERE rn > 1)"""


def _ragged(t: Tables):
    wider = F.concat("cells", F.array(F.concat(F.lit("extra "), F.col("row_no").cast("string"))))
    return _grid(t).withColumn("cells", F.when(F.col("row_no") % 5 == 0, wider).otherwise(F.col("cells")))



@case("e05_promoted_header", f"WITH {PROMOTED} SELECT doc_id, sheet, row_no, headers, cells FROM tw")
def e05(t: Tables):
    return gr.promote_header(_ragged(t)).select("doc_id", "sheet", "row_no", _bars("headers").alias("headers"), _bars("cells").alias("cells"))


@case("s07_table_frames", f"WITH {PROMOTED} SELECT doc_id, sheet AS page, row_no, headers, cells FROM tw WHERE n >= 2")
def s07(t: Tables):
    rows = _ragged(t).withColumnRenamed("sheet", "page").withColumn("table_no", F.lit(0))
    return dc.pdf_tables(rows).select("doc_id", "page", "row_no", _bars("headers").alias("headers"), _bars("cells").alias("cells"))


@case("s08_grid_text", f"""WITH {GRID}, r AS (SELECT doc_id, sheet, row_no, array_to_string(list_filter({q.clean_list('cells')}, lambda x_: x_ <> ''), ' | ') AS line FROM g)
    SELECT doc_id, {q.strip("string_agg(line, chr(10) ORDER BY sheet, row_no)")} AS text FROM r WHERE line <> '' GROUP BY doc_id""")
def s08(t: Tables):
    return gr.grid_text(_grid(t))


# ------------------------------------------------------------------ CSV round trip

# Fields of the widest CSV record.
WIDE_FIELDS = 600


@case("s01_csv_files", f"""
    SELECT cast(o_custkey % 40 AS bigint) AS doc, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS row_no,
      array_to_string([cast(o_orderkey AS varchar), CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END, o_orderpriority, 'a "quoted", cell'], '|') AS cells
    FROM orders UNION ALL
    SELECT 40, row_number() OVER (ORDER BY r_regionkey), array_to_string(list_transform(range({WIDE_FIELDS}), lambda i_: 'f' || cast(i_ AS varchar) || r_name), '|') FROM region""")
def s01(t: Tables):
    """Orders written as header-less CSV files, one folder per document, with one file of wide records, read back as grids."""
    from pyspark.sql import Window
    path = scratch_path(t.spark, "csv")
    rows = t.orders.select((F.col("o_custkey") % 40).alias("doc"), F.col("o_orderkey").cast("string"),
                           F.when(F.col("o_orderstatus") == "P", F.lit("NaN")).otherwise(F.col("o_orderstatus")),
                           "o_orderpriority", F.lit('a "quoted", cell').alias("note"))
    rows.repartition("doc").sortWithinPartitions("doc", F.col("o_orderkey").cast("bigint")).write.partitionBy("doc").csv(path, escape='"')
    wide = t.region.orderBy("r_regionkey").select(*[F.concat(F.lit(f"f{i}"), "r_name").alias(f"c{i}") for i in range(WIDE_FIELDS)])
    wide.coalesce(1).write.csv(f"{path}/doc=40", escape='"')
    grid = files.csv_grid(t.spark, [f"{path}/*/*.csv"])
    doc = F.regexp_extract("doc_id", r"doc=(\d+)", 1).cast("bigint").alias("doc")
    return grid.select(doc, F.row_number().over(Window.partitionBy("doc_id").orderBy("row_no")).cast("bigint").alias("row_no"), _bars("cells").alias("cells"))


@case("s12_format_dispatch", """
    SELECT doc_id, CASE WHEN doc_id % 7 IN (1, 2) THEN 'excel' WHEN doc_id % 7 = 0 THEN 'pdf' WHEN doc_id % 7 = 3 THEN 'csv' WHEN doc_id % 7 = 4 THEN 'docx'
      WHEN doc_id % 7 = 5 THEN 'json' ELSE 'xml' END AS input_format FROM documents""")
def s12(t: Tables):
    suffix = F.get(F.array(*[F.lit(s) for s in (".PDF", ".xlsx", ".xls", ".csv", ".DocX", ".json", ".Xml")]), (F.col("doc_id") % 7).cast("int"))
    path = F.concat(F.lit("/in/v1.2/"), "source", F.lit("."), F.col("doc_id").cast("string"), suffix)
    return t.documents.select("doc_id", files.file_format(path).alias("input_format"))


# ------------------------------------------------------------------ records and lines

KV = rf"^([A-Za-z][^:=\-]{{1,80}}?)[{q.W}]*[:=\-]+[{q.W}]*(.*)$"


def _kv(src: str, where: str = "length(line) >= 3") -> str:
    a, v = q.strip(f"regexp_extract(line, '{KV}', 1)"), q.strip(f"regexp_extract(line, '{KV}', 2)")
    return f"""(SELECT * FROM (SELECT *, {a} AS attribute, {v} AS value FROM {src} WHERE {where} AND regexp_matches(line, '{KV}')) k
      WHERE NOT {q.is_header('attribute', 'value')})"""


@case("e06_key_value_lines", f"""
    WITH l AS (SELECT doc_id, ls[i] AS line, cast(i AS bigint) AS pos FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (
        SELECT doc_id, {q.lines('text')} AS ls FROM documents UNION ALL SELECT -1 - doc_id, {q.lines('text')} FROM ({q.sentences(q.DUCK)}) s) d) u)
    SELECT doc_id, pos, attribute, value FROM {_kv('l')} r""")
def e06(t: Tables):
    docs = t.documents.select("doc_id", "text").union(t.sql(q.sentences(q.SPARK)).select((-1 - F.col("doc_id")), "text"))
    lines = tx.explode_costly(docs, tx.lines("text"), "line", "pos")
    return rc.key_value_lines(lines.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "line"))


def _table_rows(d: q.Dialect, blank: bool = True) -> str:
    """Two-cell table rows of customer documents, some of them badly cut; a third of the documents has only blank rows."""
    n, a = d.text("o_orderkey"), "o_orderpriority"
    label = d.at(d.arr(*[q.lit(x) for x in q.PHRASES]), f"o_orderkey % {len(q.PHRASES)}")
    bad = f"CASE WHEN o_custkey % 5 = 0 AND o_orderkey % 2 = 0 THEN {n} WHEN o_orderkey % 11 = 0 THEN 'Key' WHEN o_orderkey % 13 = 0 THEN '1,2 3' ELSE {label} END"
    val = f"CASE WHEN o_custkey % 7 = 0 THEN 'a=b=' || {n} WHEN o_orderkey % 3 = 0 THEN '' ELSE {a} END"
    full = d.arr("' '", bad, "'None'", val)
    cells = f"CASE WHEN o_custkey % 3 = 0 THEN {d.arr(*[q.lit(' ')] * 4)} ELSE {full} END" if blank else full
    return f"""SELECT o_custkey AS doc_id, 1 AS page, cast(o_orderkey % 2 AS bigint) AS table_no, o_orderkey AS row_no, {cells} AS cells
      FROM {d.table('orders')}"""


def _text_lines(d: q.Dialect) -> str:
    """Text lines of the same customer documents: key/value lines, or prose for some."""
    n = d.text("o_orderkey")
    kv = f"CASE o_orderkey % 3 WHEN 0 THEN 'Order Key: ' || {n} WHEN 1 THEN 'Priority - ' || o_orderpriority ELSE 'name: x' END"
    prose = "'The buyer asked us to send ' || " + n + " || ' of the goods in the morning and said thanks. All is well now.'"
    return f"""SELECT o_custkey AS doc_id, 1 AS page, o_orderkey AS line_no, CASE WHEN o_custkey % 4 = 0 THEN {prose} ELSE {kv} END AS line
      FROM {d.table('orders')}"""


def _table_records(blank: bool = True) -> str:
    return f"""
    tr AS ({_table_rows(q.DUCK, blank)}),
    tr1 AS (SELECT doc_id, 1000000000000 + table_no * 100000000 + row_no AS pos, list_filter({q.clean_list('cells')}, lambda x_: x_ <> '') AS f FROM tr),
    tr2 AS (SELECT doc_id, pos, f[1] AS attribute, f[2] AS value FROM tr1 WHERE len(f) >= 2),
    trec AS (SELECT doc_id, pos, attribute, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(attribute), value ORDER BY pos) AS rk FROM tr2
        WHERE NOT {q.is_header('attribute', 'value')} AND NOT {q.numeric_only('attribute')}) z WHERE rk = 1)"""


TABLE_RECORDS = _table_records()
BROKEN = r"""
    bt0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM trec),
    bt AS (SELECT doc_id, count(*) AS sampled, cast(sum(CASE WHEN regexp_full_match(attribute, '\d+') OR length(attribute) <= 2 THEN 1 ELSE 0 END) AS bigint) AS odd_names,
        cast(sum(CASE WHEN length(value) - length(replace(value, '=', '')) >= 2 THEN 1 ELSE 0 END) AS bigint) AS odd_values FROM bt0 WHERE rn <= 20 GROUP BY doc_id),
    broken AS (SELECT *, odd_names >= greatest(2, sampled // 3) OR odd_values >= greatest(2, sampled // 3) AS is_broken FROM bt)"""


@case("e07_broken_table", f"WITH {_table_records(False)}, {BROKEN} SELECT * FROM broken")
def e07(t: Tables):
    return rc.broken_table_flags(dc.table_row_records(t.sql(_table_rows(q.SPARK, False))))


@case("e08_record_dedupe", f"""
    SELECT doc_id, pos, attribute, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(attribute), value ORDER BY pos) AS rk FROM (
      SELECT l_orderkey AS doc_id, cast(l_linenumber * 10 + i AS bigint) AS pos, CASE i WHEN 1 THEN 'returnflag' WHEN 2 THEN 'LineStatus' WHEN 3 THEN 'quantity' ELSE '1,5' END AS attribute,
        CASE i WHEN 1 THEN l_returnflag WHEN 2 THEN l_linestatus WHEN 3 THEN cast(cast(l_quantity AS int) AS varchar) ELSE 'x' END AS value
      FROM lineitem, (SELECT unnest([1, 2, 3, 4]) AS i) n) r
      WHERE attribute <> '1,5') q WHERE rk = 1""")
def e08(t: Tables):
    s = lambda c: F.col(c).cast("int").cast("string")
    wide = t.lineitem
    records = rc.unpivot_table(wide.withColumn("_doc", F.struct("l_orderkey", "l_linenumber")), "_doc", {
        "returnflag": F.col("l_returnflag"), "LineStatus": F.col("l_linestatus"), "quantity": s("l_quantity"), "1,5": F.lit("x")})
    records = records.select(F.col("doc_id.l_orderkey").alias("doc_id"), (F.col("doc_id.l_linenumber") * 10 + F.col("pos") + 1).cast("bigint").alias("pos"), "attribute", "value")
    return rc.clean_records(records)


@case("e09_table_row_dedupe", f"WITH {_table_records(False)} SELECT doc_id, pos, attribute, value FROM trec")
def e09(t: Tables):
    return dc.table_row_records(t.sql(_table_rows(q.SPARK, False)))


LINES = f"tl AS ({_text_lines(q.DUCK)}), ln AS (SELECT doc_id, 1000000000000 + line_no AS pos, {q.strip('line')} AS line FROM tl)"


def _narrative(src: str, out: str) -> str:
    w = f"len({q.words('line')})"
    return f"""
    {out}0 AS (SELECT doc_id, count(*) AS n_lines, sum({w}) AS n_words, sum(CASE WHEN {w} >= 10 THEN 1 ELSE 0 END) AS long_lines,
        sum(CASE WHEN regexp_matches(line, '[:=\\-]') AND {w} <= 12 THEN 1 ELSE 0 END) AS kv_lines,
        sum(length(line) - length(regexp_replace(line, '[.?!]', '', 'g'))) AS marks FROM {src} WHERE line <> '' GROUP BY doc_id),
    {out} AS (SELECT doc_id, (n_lines <= 5 AND n_words / n_lines >= 12) OR (long_lines >= greatest(2, n_lines // 2) AND kv_lines = 0)
        OR (marks >= 2 AND kv_lines = 0 AND n_words / n_lines >= 8) AS is_narrative FROM {out}0)"""


PDF = f"""{TABLE_RECORDS}, {BROKEN}, {LINES}, {_narrative('ln', 'nv')},
    good AS (SELECT r.* FROM trec r JOIN broken b USING (doc_id) WHERE NOT is_broken),
    lrec AS (SELECT doc_id, pos, attribute, value FROM {_kv('ln')} k WHERE doc_id NOT IN (SELECT doc_id FROM good)),
    rec AS (SELECT * FROM good UNION ALL SELECT * FROM lrec),
    kept AS (SELECT r.* FROM rec r LEFT JOIN nv USING (doc_id) WHERE NOT coalesce(is_narrative, false))"""


@case("s06_pdf_records", f"WITH {PDF} SELECT * FROM kept")
def s06(t: Tables):
    return dc.pdf_records(t.sql(_table_rows(q.SPARK)), t.sql(_text_lines(q.SPARK)))[0]


DOCX = f"""{TABLE_RECORDS}, {LINES}, {_narrative('ln', 'nv')},
    lrec AS (SELECT doc_id, pos, attribute, value FROM {_kv('ln')} k WHERE doc_id NOT IN (SELECT doc_id FROM trec)),
    rec AS (SELECT * FROM trec UNION ALL SELECT * FROM lrec)"""


@case("s05_docx_records", f"WITH {DOCX} SELECT * FROM rec")
def s05(t: Tables):
    return dc.docx_records(t.sql(_table_rows(q.SPARK)), t.sql(_text_lines(q.SPARK)))[0]


@case("s05_s06_document_types", f"""
    WITH {PDF}, ids AS (SELECT doc_id FROM tr UNION SELECT doc_id FROM tl), c AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id)
    SELECT doc_id, 'pdf' AS input_format, CASE WHEN coalesce(is_narrative, false) THEN 'unstructured' ELSE 'keyvalue' END AS doc_type, coalesce(n, 0) AS n_records
    FROM ids LEFT JOIN nv USING (doc_id) LEFT JOIN c USING (doc_id)""")
def s05b(t: Tables):
    return dc.pdf_records(t.sql(_table_rows(q.SPARK)), t.sql(_text_lines(q.SPARK)))[1]


@case("s09_page_text", f"WITH {LINES} SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM ln GROUP BY doc_id")
def s09(t: Tables):
    return dc.pdf_text(t.sql(_text_lines(q.SPARK)))


@case("s10_paragraph_and_table_text", f"""
    WITH {LINES}, tr AS ({_table_rows(q.DUCK)}),
    parts AS (SELECT doc_id, 0 AS s, 0 AS a, pos AS b, line FROM ln UNION ALL
      SELECT doc_id, 1, table_no, row_no, array_to_string(list_filter({q.clean_list('cells')}, lambda x_: x_ <> ''), ' | ') FROM tr)
    SELECT doc_id, string_agg(line, chr(10) ORDER BY s, a, b) AS text FROM parts WHERE line <> '' GROUP BY doc_id""")
def s10(t: Tables):
    return dc.docx_text(t.sql(_table_rows(q.SPARK)), t.sql(_text_lines(q.SPARK)))


@case("t03_routing_pdf", f"""
    WITH {PDF}, ids AS (SELECT doc_id FROM tr UNION SELECT doc_id FROM tl)
    SELECT doc_id, count(r.attribute) AS n_structured, coalesce(any_value(is_narrative), false) AS routed FROM ids LEFT JOIN nv USING (doc_id)
    LEFT JOIN kept r USING (doc_id) GROUP BY doc_id""")
def t03(t: Tables):
    rows, lines = t.sql(_table_rows(q.SPARK)), t.sql(_text_lines(q.SPARK))
    verdict = dc.line_verdicts(lines)
    records, docs = dc.pdf_records(rows, lines, verdict)
    _, kinds = dc.route_lines(records, docs, dc.pdf_text(lines), lines, verdict)
    return kinds.select("doc_id", F.col("n_records").alias("n_structured"), (F.col("doc_type") == "unstructured").alias("routed"))


@case("n03_excel_documents", f"""
    WITH {CLEAN}, sw AS (SELECT doc_id, sheet, max(len(cells)) > 2 AS multi FROM wb GROUP BY ALL),
    src_w AS (SELECT wb.* FROM wb JOIN sw USING (doc_id, sheet) WHERE multi), src_n AS (SELECT wb.* FROM wb JOIN sw USING (doc_id, sheet) WHERE NOT multi),
    {_prepared('src_w')}, {WIDE}, {_pairs('src_n', 'pr')}
    SELECT doc_id, sheet, pos, attribute, value FROM wide UNION ALL SELECT doc_id, sheet, pos, attribute, value FROM pr""")
def n03(t: Tables):
    return dc.excel_records(_grid(t))[0].select("doc_id", "sheet", "pos", "attribute", "value")


@case("n03_excel_document_types", f"""
    WITH {CLEAN}, sw AS (SELECT doc_id, max(len(cells)) > 2 AS multi FROM wb GROUP BY doc_id)
    SELECT doc_id, 'excel' AS input_format, CASE WHEN multi THEN 'multicolumn' ELSE 'keyvalue' END AS doc_type FROM sw""")
def n03b(t: Tables):
    return dc.excel_records(_grid(t))[1].select("doc_id", "input_format", "doc_type")


@case("q13_unpivot_mode", f"SELECT doc_id, pos, attribute, value FROM ({q.order_records(q.DUCK)}) t")
def q13(t: Tables):
    return order_records(t)
