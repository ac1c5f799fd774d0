"""Cases S3, S4, S11, X1-X5, N3 for JSON and XML built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from attrloom.operators import nested as ns
from attrloom.plans import documents as dc
from attrloom.session import scratch_path
from attrloom.sources import files
from suite.registry import Tables, case


def _order_json(t: Tables):
    """Orders as nested JSON: an object, a list of objects, a list of scalars, a boolean and a null."""
    s = lambda c: F.col(c).cast("string")
    return t.orders.select(F.col("o_orderkey").alias("doc_id"), F.concat(
        F.lit('{"data":{"orderNo":"ORD-'), s("o_orderkey"), F.lit('","name":"x","customer":{"custKey":'), s("o_custkey"),
        F.lit(',"name":"Buyer '), s("o_custkey"), F.lit('","is_open":'), F.when(F.col("o_orderstatus") == "O", F.lit("true")).otherwise(F.lit("false")),
        F.lit(',"fax":null},"items":[{"pay-mode":"'), F.col("o_orderpriority"), F.lit('"},{"pay-mode":"card"},["x"]],"tags":["a","b"]},"total":'),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("}")).alias("text"))


JSON_ROWS = """(
    SELECT o_orderkey AS doc_id, 'order no' AS attribute, 'ORD-' || cast(o_orderkey AS varchar) AS value, 'data.orderNo' AS raw_attribute FROM orders UNION ALL
    SELECT o_orderkey, 'customer cust key', cast(o_custkey AS varchar), 'data.customer.custKey' FROM orders UNION ALL
    SELECT o_orderkey, 'customer name', 'Buyer ' || cast(o_custkey AS varchar), 'data.customer.name' FROM orders UNION ALL
    SELECT o_orderkey, 'customer is open', CASE WHEN o_orderstatus = 'O' THEN 'True' ELSE 'False' END, 'data.customer.is_open' FROM orders UNION ALL
    SELECT o_orderkey, 'items 1 pay mode', o_orderpriority, 'data.items_1.pay-mode' FROM orders UNION ALL
    SELECT o_orderkey, 'items 2 pay mode', 'card', 'data.items_2.pay-mode' FROM orders UNION ALL
    SELECT o_orderkey, 'total', cast(o_totalprice AS varchar), 'total' FROM orders)"""

# Objects around the value of the deepest documents.
DEEP = 40


@case("x01_json_flatten", f"""
    SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS bigint) AS pos, attribute, value, raw_attribute
    FROM (SELECT *, list_position(['data.customer.custKey', 'data.customer.is_open', 'data.customer.name', 'data.items_1.pay-mode', 'data.items_2.pay-mode', 'data.orderNo', 'total'], raw_attribute) AS place FROM {JSON_ROWS} r) p
    UNION ALL SELECT -1 - r_regionkey, 0, repeat('a ', {DEEP}) || 'deep', r_name, repeat('a.', {DEEP}) || 'deep' FROM region""")
def x01(t: Tables):
    deep = t.region.select((-1 - F.col("r_regionkey")).cast("bigint"), F.concat(
        F.lit('{"a":' * DEEP + '{"deep":"'), "r_name", F.lit('"}' + "}" * DEEP)))
    return ns.flatten_json(_order_json(t).union(deep))


@case("x01_event_properties", """
    SELECT event_id AS doc_id, 'k' AS attribute, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def x01b(t: Tables):
    docs = t.events.select(F.col("event_id").alias("doc_id"), F.col("props").alias("text"))
    return ns.flatten_json(docs).select("doc_id", "attribute", "value")


@case("s03_json_files", f"SELECT 'ORD-' || cast(doc_id AS varchar) AS doc_id, attribute, value, raw_attribute FROM {JSON_ROWS} r")
def s03(t: Tables):
    """Orders written one JSON document per line, read back and flattened."""
    path = scratch_path(t.spark, "json-lines")
    _order_json(t).select(F.concat(F.col("text")).alias("value")).write.text(path)
    docs = t.spark.read.text(path).select(F.get_json_object("value", "$.data.orderNo").alias("doc_id"), F.col("value").alias("text"))
    return dc.json_records(docs)[0].select("doc_id", "attribute", "value", "raw_attribute")


@case("s11_raw_text", "SELECT cast(n_nationkey AS bigint) AS doc_id, '{\"nation\":\"' || n_name || '\"}' || chr(10) AS text FROM nation")
def s11(t: Tables):
    """One file per nation, read whole as text."""
    path = scratch_path(t.spark, "raw")
    t.nation.select(F.col("n_nationkey").alias("doc"), F.concat(F.lit('{"nation":"'), "n_name", F.lit('"}')).alias("value")
                    ).repartition("doc").write.partitionBy("doc").text(path)
    docs = files.text_documents(t.spark, [f"{path}/*/*.txt"])
    return docs.select(F.regexp_extract("doc_id", r"doc=(\d+)", 1).cast("bigint").alias("doc_id"), "text")


def _part_xml(t: Tables):
    s = lambda c: F.col(c).cast("string")
    return t.part.select(F.col("p_partkey").alias("doc_id"), F.concat(
        F.lit('<root><part id="P-'), s("p_partkey"), F.lit('" unitSize="'), s("p_size"), F.lit('"> <p_name>'), "p_name",
        F.lit(" &amp; co</p_name><kind><type>"), "p_type", F.lit("</type><type>"), "p_type", F.lit("</type>007</kind><empty/></part></root>")).alias("text"))


XML_ROWS = """(
    SELECT p_partkey AS doc_id, 0 AS o, 'part id' AS attribute, 'P-' || cast(p_partkey AS varchar) AS value, 'root.part.id' AS raw_attribute FROM part UNION ALL
    SELECT p_partkey, 1, 'part unit size', cast(p_size AS varchar), 'root.part.unitSize' FROM part UNION ALL
    SELECT p_partkey, 2, 'part p name', p_name || ' & co', 'root.part.p_name' FROM part UNION ALL
    SELECT p_partkey, 3, 'part kind type', p_type, 'root.part.kind.type' FROM part)"""


@case("x02_xml_flatten", f"SELECT doc_id, cast(o AS bigint) AS pos, attribute, value, raw_attribute FROM {XML_ROWS} r")
def x02(t: Tables):
    return ns.flatten_xml(_part_xml(t))


@case("s04_xml_documents", f"SELECT doc_id, count(*) AS n_records, 'xml' AS input_format, 'xml' AS doc_type FROM {XML_ROWS} r GROUP BY doc_id")
def s04(t: Tables):
    return dc.xml_records(_part_xml(t))[1]


@case("x04_x05_salvage", """
    SELECT o_orderkey AS doc_id, cast(i AS bigint) AS pos, CASE i WHEN 0 THEN 'order key' ELSE 'priority' END AS attribute,
      CASE i WHEN 0 THEN cast(o_orderkey AS varchar) ELSE o_orderpriority END AS value
    FROM orders, (SELECT unnest([0, 1]) AS i) n WHERE o_orderkey % 6 <> 4""")
def x04(t: Tables):
    """Model answers built from orders: a bare array, arrays under known keys, arrays in prose, junk."""
    k, p = F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    arr = F.concat(F.lit('[{"attribute": " order key ", "value": '), k, F.lit('}, {"attribute": "priority", "value": "'), p,
                   F.lit('"}, 7, {"attribute": "", "value": "x"}, {"value": "y"}]'))
    objects = F.replace(arr, F.lit(", 7"), F.lit(""))
    kind = F.col("o_orderkey") % 6
    response = (F.when(kind == 0, arr).when(kind == 1, F.concat(F.lit('{"items": '), arr, F.lit(', "data": []}')))
                .when(kind == 2, F.concat(F.lit("Sure! Here it is:\n"), objects, F.lit("\nDone.")))
                .when(kind == 3, F.concat(F.lit('{"other": '), objects, F.lit("}")))
                .when(kind == 4, F.lit("no list [here] at all")).otherwise(F.concat(F.lit("["), arr)))
    return ns.salvaged_records(t.orders.select(F.col("o_orderkey").alias("doc_id"), response.alias("response")))
