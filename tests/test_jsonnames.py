"""Leaves of short JSON documents are named and filtered by the reader; what it leaves to Spark gets the same."""

from attrloom.functions import jsonleaves, textrules
from attrloom.functions import text as tx
from attrloom.operators import nested as ns

TEXTS = ['{"data":{"orderNo":"7","name":"x","unit-price":12.5},"n":5,"z":-0.25}', '{"a":1,"A":1,"b":2.50}', '{"é":1,"b_c":1e3}', '{"a":"  ","7":"x","record":{"kmPl":-0}}']


def test_reader_names_plain_documents(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    assert {r.doc_id for r in ns._short_leaves(df).filter("plain").collect()} == {0, 3}
    assert sorted(tuple(r) for r in ns.flatten_json(df).collect()) == [
        (0, 0, "order no", "7", "data.orderNo"), (0, 1, "unit price", "12.5", "data.unit-price"), (0, 2, "n", "5", "n"), (0, 3, "z", "-0.25", "z"),
        (1, 0, "a", "1", "A"), (1, 2, "b", "2.5", "b"), (2, 0, "b c", "1000.0", "b_c"), (2, 1, "é", "1", "é"), (3, 0, "km pl", "0", "record.kmPl")]


def test_reader_and_spark_agree(spark, monkeypatch):
    more = ['{"v":%s}' % n for n in ("0", "-0", "12", "999999999999999", "9999999999999999", "0.1", "10.250", "1.001", "-7.5", "100.0")]
    df = spark.createDataFrame(list(enumerate(TEXTS + more)), "doc_id int, text string")
    got = sorted(tuple(r) for r in ns.flatten_json(df).collect())
    monkeypatch.setattr(jsonleaves, "naming", lambda keep, noise: lambda leaves: None)
    assert sorted(tuple(r) for r in ns.flatten_json(df).collect()) == got


def test_a_task_remembers_a_bounded_number_of_names():
    named = jsonleaves.naming(textrules.usable_name, tx.PATH_NOISE)
    assert all(named([(f"k{i}X", "v", None)]) == [(f"k{i}X", "v", None, f"k{i}x")] for i in range(jsonleaves.KNOWN_PATHS + 5))
