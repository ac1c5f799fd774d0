"""The free-text rules run on batches of texts, not as nested expressions for every rule."""

from pyspark.sql import functions as F

from attrloom.functions import textrules
from attrloom.operators import freetext as ft


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_run_in_one_batch_function(spark):
    df = spark.createDataFrame([(1, "x", "PO 7 for 5 pcs of ring at")], "doc_id int, kind string, text string")
    for found in (ft.extract_fields(df), ft.extract_sentences(df), ft.extract_chunked(df)):
        assert "MapInArrow" in _plan(found) and "regexp_extract(" not in _plan(found)
        assert found.columns == ["doc_id", "kind", "pos", "attribute", "value"]
    assert [tuple(r) for r in ft.extract_fields(df).collect()] == [(1, "x", 0, "Purchase Order Number", "PO 7")]


def test_null_empty_and_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "amount of 5 RUPEEſ"), (4, "amount\n5\x1crupees")], "doc_id int, text string")
    assert [tuple(r) for r in ft.extract_sentences(df).collect()] == [(3, 0, "Total Order Value", "5 RUPEEſ")]
    broken = spark.range(1).select(F.lit(1).alias("doc_id"), F.expr("cast(concat(X'FF', cast(' WO-12 ' AS binary)) AS string)").alias("text"))
    assert [r.value for r in ft.extract_fields(broken).collect()] == ["WO-12"]


def test_names_are_judged_as_records_are():
    usable = textrules.usable_pairs()
    assert [usable(a, "v") for a in ("Items", " name ", "No.", "Field  Label", "1.2 3", "", "name x")] == [True, False, False, False, False, False, True]
    assert not usable("Items", "  ")
