"""Cases C1-C5, D1-D9, V1-V6, A10, S13 on names, cells and values of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from attrloom.functions import shapes as sh
from attrloom.functions import text as tx
from attrloom.sources.dictionary import dictionary_from
from suite import sqlparts as q
from suite.registry import Tables, case, order_records

# Every document text as a cell, and cells of many shapes derived from every document row.
def _cells(d: q.Dialect) -> str:
    return f"""
    SELECT doc_id, text AS cell FROM {d.table('documents')} UNION ALL
    SELECT -1 - doc_id, CASE doc_id % 7 WHEN 0 THEN ' NaN ' WHEN 1 THEN 'none' WHEN 2 THEN ' ' || source || ' '
                     WHEN 3 THEN NULL WHEN 4 THEN lang || '  ' || source WHEN 5 THEN '' ELSE text END
    FROM {d.table('documents')}"""


@case("c01_clean_cell", f"SELECT doc_id, {q.clean('cell')} AS cleaned FROM ({_cells(q.DUCK)}) t")
def c01(t: Tables):
    return t.sql(_cells(q.SPARK)).select("doc_id", tx.clean_cell("cell").alias("cleaned"))


@case("c02_column_name", f"SELECT pos, {q.col_name('attribute')} AS column_name FROM ({q.order_names(q.DUCK)}) t")
def c02(t: Tables):
    return t.sql(q.order_names(q.SPARK)).select("pos", tx.normalize_column_name("attribute").alias("column_name"))


def _header_cells(d: q.Dialect) -> str:
    names = d.arr(*[q.lit(x) for x in ("Field  Label", "attribute", "KEY", "No.", "no", "#", "Value", "Values", "names", "Name ", "Label x", "12, 3.5", "1,200")])
    return f"""SELECT o_orderkey AS pos, {d.at(names, 'o_orderkey % 13')} AS a,
      CASE o_custkey % 3 WHEN 0 THEN 'Values' WHEN 1 THEN 'value' ELSE o_orderpriority END AS v FROM {d.table('orders')}"""


@case("c03_header_row", f"SELECT pos, {q.is_header(q.strip('a'), q.strip('v'))} AS is_header FROM ({_header_cells(q.DUCK)}) t")
def c03(t: Tables):
    return t.sql(_header_cells(q.SPARK)).select("pos", tx.is_header_row("a", "v").alias("is_header"))


@case("c04_row_to_pair", f"""
    SELECT doc_id, sheet, row_no, CASE WHEN len(f) >= 2 THEN f[1] ELSE '' END AS attribute,
           CASE WHEN len(f) >= 2 THEN f[2] ELSE '' END AS value
    FROM (SELECT *, list_filter({q.clean_list('cells')}, lambda x_: x_ <> '') AS f FROM ({q.sheets(q.DUCK)}) t) u""")
def c04(t: Tables):
    a, v = tx.row_to_pair("cells")
    return t.sql(q.sheets(q.SPARK)).select("doc_id", "sheet", "row_no", a.alias("attribute"), v.alias("value"))


@case("c05_numeric_only", f"""
    SELECT l_orderkey, cast(l_linenumber AS bigint) AS line_no, {q.numeric_only('a')} AS is_numeric
    FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN cast(l_partkey AS varchar) || ', ' || cast(l_suppkey AS varchar) || '.5'
          WHEN 1 THEN l_returnflag || cast(l_partkey AS varchar) ELSE '-' || cast(l_suppkey AS varchar) END AS a FROM lineitem) t""")
def c05(t: Tables):
    s = lambda c: F.col(c).cast("string")
    a = (F.when(F.col("l_linenumber") % 3 == 0, F.concat(s("l_partkey"), F.lit(", "), s("l_suppkey"), F.lit(".5")))
         .when(F.col("l_linenumber") % 3 == 1, F.concat("l_returnflag", s("l_partkey"))).otherwise(F.concat(F.lit("-"), s("l_suppkey"))))
    return t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line_no"), tx.is_numeric_only(a).alias("is_numeric"))


@case("d01_d03_name_texts", f"""
    SELECT pos, f1 AS norm, f2 AS spaced, {q.d3('f2')} AS expanded
    FROM (SELECT pos, {q.d1('attribute')} AS f1, {q.d2('attribute')} AS f2 FROM ({q.order_names(q.DUCK)}) t) u""")
def d01(t: Tables):
    spaced = tx.snake_to_space("attribute")
    return t.sql(q.order_names(q.SPARK)).select(
        "pos", tx.normalize("attribute").alias("norm"), spaced.alias("spaced"), tx.expand_abbreviations(spaced).alias("expanded"))


@case("d04_tokens", f"""
    SELECT doc_id, cast(len({q.tokens('text')}) AS bigint) AS n_tokens, array_to_string(list_sort({q.tokens('text')}), ' ') AS tokens FROM documents""")
def d04(t: Tables):
    return t.documents.select("doc_id", tx.tokens("text").alias("t")).select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join(F.array_sort("t"), " ").alias("tokens"))


@case("d05_forms", f"""
    SELECT pos, array_to_string(CASE WHEN f2 = f1 THEN (CASE WHEN f3 = f1 THEN [f1] ELSE [f1, f3] END)
                                 ELSE (CASE WHEN f3 IN (f1, f2) THEN [f1, f2] ELSE [f1, f2, f3] END) END, '|') AS forms
    FROM (SELECT *, {q.d3('f2')} AS f3 FROM (SELECT pos, {q.d1('attribute')} AS f1, {q.d2('attribute')} AS f2 FROM ({q.order_names(q.DUCK)}) t) u) w""")
def d05(t: Tables):
    return t.sql(q.order_names(q.SPARK)).select("pos", F.array_join(tx.forms("attribute"), "|").alias("forms"))


# A dictionary derived from the parts: types are canonical names, article names their variations.
PART_ENTRIES = """
    SELECT cast(row_number() OVER (ORDER BY p_brand, p_type) - 1 AS int) AS entry_no,
           p_type || CASE WHEN p_brand < 'Brand#2' THEN ' Qty' ELSE '_No' END AS canonical, variations
    FROM (SELECT p_brand, p_type, list_sort(list(DISTINCT p_name || CASE WHEN p_size % 4 = 0 THEN '-' || p_type WHEN p_size % 4 = 1 THEN ' amt' ELSE '' END)) AS variations
          FROM part GROUP BY p_brand, p_type) t"""


def part_dictionary(t: Tables):
    from pyspark.sql import Window
    variation = F.concat("p_name", F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("-"), "p_type"))
                         .when(F.col("p_size") % 4 == 1, F.lit(" amt")).otherwise(F.lit("")))
    groups = t.part.groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_set(variation)).alias("variations"))
    canonical = F.concat("p_type", F.when(F.col("p_brand") < "Brand#2", F.lit(" Qty")).otherwise(F.lit("_No")))
    # Only the (brand, type) pairs, a small fixed vocabulary, are numbered in one task; the texts stay spread.
    pairs = t.part.select("p_brand", "p_type").distinct()
    number = pairs.select("p_brand", "p_type", (F.row_number().over(Window.orderBy("p_brand", "p_type")) - 1).alias("entry_no"))
    numbered = groups.join(number, ["p_brand", "p_type"]).select("entry_no", canonical.alias("canonical"), "variations")
    return dictionary_from(numbered)


@case("d06_exact_table", f"WITH {q.dictionary_ctes(PART_ENTRIES)} SELECT form, canonical FROM d_exact")
def d06(t: Tables):
    return part_dictionary(t).exact.select("form", "canonical")


@case("d07_variation_list", f"WITH {q.dictionary_ctes(PART_ENTRIES)} SELECT cast(var_no AS bigint) AS var_no, form, canonical FROM d_var")
def d07(t: Tables):
    return part_dictionary(t).variations.select("var_no", "form", "canonical")


@case("d08_corpus", f"WITH {q.dictionary_ctes(PART_ENTRIES)} SELECT form, canonical FROM d_corpus")
def d08(t: Tables):
    return part_dictionary(t).corpus.select("form", "canonical")


@case("d09_tfidf_fit", f"""
    WITH {q.dictionary_ctes(PART_ENTRIES)}, n_texts AS (SELECT DISTINCT form AS text FROM d_corpus), {q.tfidf_ctes('n_texts')}
    SELECT cast(var_no AS bigint) AS var_no, gram, round(weight, 9) AS weight FROM w_var""")
def d09(t: Tables):
    return part_dictionary(t).gram_weights.select("var_no", "gram", F.round("weight", 9).alias("weight"))


@case("a10_dictionary_profile", f"""
    WITH e AS ({PART_ENTRIES}) SELECT cast(entry_no AS bigint) AS entry_no, canonical, array_to_string(variations[1:5], ', ') AS sample,
      (SELECT count(*) FROM e) AS entries FROM e""")
def a10(t: Tables):
    return part_dictionary(t).profile().withColumn("entry_no", F.col("entry_no").cast("bigint"))


@case("s13_dictionary_source", f"""
    WITH e AS ({PART_ENTRIES}) SELECT cast(entry_no AS bigint) AS entry_no, canonical, unnest(list_prepend(canonical, variations)) AS text FROM e""")
def s13(t: Tables):
    """The derived dictionary written as a dictionary file and read back."""
    from attrloom.session import scratch_path
    from attrloom.sources.dictionary import load_dictionary
    path = scratch_path(t.spark, "dictionary")
    entries = part_dictionary(t).entries
    entries.orderBy("entry_no").agg(F.array_sort(F.collect_list(F.struct("entry_no", "canonical", "variations"))).alias("e")).select(
        F.to_json(F.struct(F.transform("e", lambda e: F.struct(e["canonical"].alias("canonical"), e["variations"].alias("variations")))
                           .alias("master_attributes")))).write.text(path)
    loaded = load_dictionary(t.spark, path).entries
    return loaded.select(F.col("entry_no").cast("bigint").alias("entry_no"), "canonical",
                         F.explode(F.concat(F.array("canonical"), "variations")).alias("text"))


for _no, _kind in enumerate(["date", "phone", "email", "amount", "id"], start=1):
    @case(f"v0{_no}_{_kind}_shape", f"""
        SELECT source, k, n_lines, hits FROM (
          SELECT source, 'document' AS k, count(*) AS n_lines, cast(count(*) FILTER (WHERE {q.shape(_kind, 'line')}) AS bigint) AS hits
          FROM (SELECT doc_id, source, unnest({q.lines('text')}) AS line FROM documents) t GROUP BY source
          UNION ALL
          SELECT attribute, 'order', count(*), cast(count(*) FILTER (WHERE {q.shape(_kind, q.strip('value'))}) AS bigint)
          FROM ({q.order_records(q.DUCK)}) r GROUP BY attribute
          UNION ALL
          SELECT 'note', 'order name', count(*), cast(count(*) FILTER (WHERE {q.shape(_kind, q.strip('value'))}) AS bigint)
          FROM ({q.order_names(q.DUCK)}) r) u""")
    def _shape(t: Tables, kind=_kind):
        is_kind = sh.SHAPES[kind]
        lines = tx.explode_costly(t.documents.select("source", "text"), tx.lines("text"), "v").select(
            "source", F.lit("document").alias("k"), "v")
        values = order_records(t).select(F.col("attribute").alias("source"), F.lit("order").alias("k"), tx.strip("value").alias("v"))
        names = t.sql(q.order_names(q.SPARK)).select(F.lit("note").alias("source"), F.lit("order name").alias("k"), tx.strip("value").alias("v"))
        return lines.union(values).union(names).groupBy("source", "k").agg(
            F.count("*").alias("n_lines"), F.count_if(is_kind("v")).alias("hits"))


_CANONICALS = ["Phone Number", "email address", "Order Date", "Maintenance Date", "Total Order Value", "Unit Price", "Order Number",
               "Tracking ID", "Serial Number", "Remarks"]


@case("v06_value_guard", f"""
    SELECT pos, canonical, {q.guard_ok(q.guard_of('canonical'), 'value')} AS passes
    FROM (SELECT pos, value, unnest([{', '.join(q.lit(c) for c in _CANONICALS)}]) AS canonical FROM ({q.order_names(q.DUCK)}) t) u""")
def v06(t: Tables):
    names = t.sql(q.order_names(q.SPARK)).withColumn("canonical", F.explode(F.array(*[F.lit(c) for c in _CANONICALS])))
    return names.select("pos", "canonical", sh.passes_guard(sh.guard_kind("canonical"), "value").alias("passes"))


@case("x03_friendly_name", f"""
    SELECT pos, {q.friendly('path')} AS attribute
    FROM (SELECT pos, 'data.' || replace(attribute, ' ', '.') || '.itemCount_2.Record.unitPrice-' || lower(value) AS path FROM ({q.order_names(q.DUCK)}) t) u""")
def x03(t: Tables):
    path = F.concat(F.lit("data."), F.replace(F.col("attribute"), F.lit(" "), F.lit(".")), F.lit(".itemCount_2.Record.unitPrice-"), F.lower("value"))
    return t.sql(q.order_names(q.SPARK)).select("pos", tx.friendly_name(path).alias("attribute"))


