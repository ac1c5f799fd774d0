import re

from pyspark.sql import functions as F

from attrloom.functions import shapes as sh
from attrloom.functions import text as tx


def one(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", fn("v").alias("o")).orderBy("i").collect()]


def test_clean_cell_blanks(spark):
    assert one(spark, tx.clean_cell, [None, " NaN ", "none", "", " x ", "nano"]) == ["", "", "", "", "x", "nano"]


def test_strip_and_collapse_follow_unicode_whitespace(spark):
    values = [" a   b\x1f", "\x85x　y ", " plain  text\t"]
    assert one(spark, tx.collapse, values) == [re.sub(r"\s+", " ", v.strip()) for v in values]
    assert one(spark, tx.normalize, ["  A  B "]) == ["a b"]


def test_forms_in_order(spark):
    assert one(spark, tx.forms, ["Ship_Cost", "qty", "Plain"]) == [
        ["ship_cost", "ship cost", "shipping cost"], ["qty", "quantity"], ["plain"]]


def test_header_rows(spark):
    df = spark.createDataFrame([("Field  Label", "x"), ("no.", "1"), ("", "x"), ("Name ", "Values"), ("names", "value"), ("#", "")], "a string, v string")
    assert [r[0] for r in df.select(tx.is_header_row("a", "v")).collect()] == [True, True, True, True, False, True]


def test_numeric_only(spark):
    assert one(spark, tx.is_numeric_only, ["1,200", "1.5 2", "a1", "-1", "١٢"]) == [True, True, False, False, True]


def test_friendly_name(spark):
    assert one(spark, tx.friendly_name, ["data.order.payMode", "root.items_1.unit-price", "Record"]) == ["order pay mode", "items 1 unit price", ""]


def test_lines_split_like_text_lines(spark):
    text = "a\r\nb\rc\x0bd  e \n\n f"
    assert one(spark, tx.lines, [text]) == [[ln.strip() for ln in text.splitlines() if ln.strip()]]


def test_shapes(spark):
    assert one(spark, sh.is_date, ["12/3/24", "2024-02-01", "12 March 2024", "March 12, 2024", "soon", "1234-567-8"]) == [True] * 4 + [False, False]
    assert one(spark, sh.is_phone, ["+49 170 1234567", "12345", "1234567890123456"]) == [True, False, False]
    assert one(spark, sh.is_email, ["mail a@b.co now", "a@b", "not-an-email"]) == [True, False, False]
    assert one(spark, sh.is_amount, ["₹5", "Rs. x", "TRK1", "none"]) == [True, True, True, False]
    assert one(spark, sh.is_id_like, ["ORD1024", "12345", "ab-1", "WO-1023"]) == [True, False, False, True]


def test_guard(spark):
    df = spark.createDataFrame([("Phone Number", "12345"), (" phone number", ""), ("Remarks", "12"), ("Order Date", "2024-01-01"), ("Unit Price", "free")], "c string, v string")
    got = [r[0] for r in df.select(sh.passes_guard(sh.guard_kind("c"), "v")).collect()]
    assert got == [False, True, True, True, False]


def test_explode_costly_keeps_nulls_and_drops_empty(spark):
    df = spark.createDataFrame([(1, ["a", None]), (2, []), (3, None)], "i int, xs array<string>")
    assert [(r["i"], r["x"]) for r in tx.explode_costly(df, "xs", "x").orderBy("i", "_pos").collect()] == [(1, "a"), (1, None)]
    assert df.select(tx.let(F.lit(2), lambda x: x * x)).first()[0] == 4
