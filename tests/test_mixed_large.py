from pyspark.sql import functions as F

from attrloom.functions import jsonleaves, textrules
from attrloom.functions import text as tx
from attrloom.operators import nested as ns
from attrloom.plans.mixed import DocumentInputs, document_records


def test_every_input_row_is_read_once(spark):
    """The tables given are read by one job each; all plans read the stored rows of their format."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    def table(rows, schema):
        return spark.createDataFrame(rows, schema).mapInArrow(counted, schema)

    paths = spark.createDataFrame([("a", "a.xlsx"), ("b", "b.csv"), ("c", "c.pdf"), ("d", "d.docx"), ("e", "e.json"), ("f", "f.xml"), ("t", "t.csv"),
                                   ("t", "t.xlsx"), (None, "n.csv"), ("gone", "gone.pdf")], "doc_id string, path string")
    grid = table([(d, "", i, [f"name {i}", "v"]) for d in ("a", "b", "t", "unnamed", None) for i in range(3)], "doc_id string, sheet string, row_no long, cells array<string>")
    rows = table([("c", 1, 0, 0, ["Total Cost", "45"])], "doc_id string, page int, table_no int, row_no int, cells array<string>")
    lines = table([("c", 1, 0, "head"), ("d", 1, 0, "Due: today")], "doc_id string, page int, line_no int, line string")
    texts = table([("e", '{"k": 1}'), ("f", "<r><q>2</q></r>")], "doc_id string, text string")
    records, docs, errors = document_records(DocumentInputs(paths, grid, rows, lines, texts))
    counts = {(r["doc_id"], r["n"]) for r in records.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {("a", 3), ("b", 3), ("t", 6), ("c", 1), ("d", 1), ("e", 1), ("f", 1)}
    # A document named with two formats is read as both.
    assert sorted((r["doc_id"], r["input_format"]) for r in docs.collect()) == [
        ("a", "excel"), ("b", "csv"), ("c", "pdf"), ("d", "docx"), ("e", "json"), ("f", "xml"), ("t", "csv"), ("t", "excel")]
    assert sorted((r["doc_id"] or "", r["error"]) for r in errors.collect()) == [("", "nothing was read"), ("gone", "nothing was read")]
    assert read.value == 15 + 1 + 2 + 2


def test_repeated_names_keep_first_value_and_place(spark, monkeypatch):
    texts = [("<r><t>a</t><t> a </t><name>x</name><t>b</t><q k='1'>7</q></r>", "x"), ('{"a":{"t":"x"},"data":{"a":{"t":" x "}},"root":{"a":{"t":"y"}}}', "j"),
             ('{"a":1e5,"data":{"a":100000.0},"b":"z"}', "j"), ('{"a":"\\ud800","data":{"a":"\\udfff"},"root":{"a":"?"}}', "j"), ("<r><b>é</b><b>é</b></r>", "x")]
    docs = spark.createDataFrame([(str(i), t, kind) for i, (t, kind) in enumerate(texts)], "doc_id string, text string, kind string")

    def found():
        both = [ns.flatten_xml(docs.filter("kind = 'x'")), ns.flatten_json(docs.filter("kind = 'j'"))]
        return sorted((r["doc_id"], r["pos"], r["attribute"], r["value"], r["raw_attribute"]) for df in both for r in df.collect())

    got = found()
    assert [x[1:4] for x in got if x[0] == "0"] == [(0, "r t", "a"), (2, "r name", "x"), (3, "r t", "b"), (4, "r q k", "1"), (5, "r q", "7")]
    assert [x[1:4] for x in got if x[0] == "1"] == [(0, "a t", "x"), (2, "a t", "y")]
    monkeypatch.setattr(jsonleaves, "first_leaves", lambda leaves: None)
    assert found() == got


def test_numbers_that_spark_words_are_left_to_it_where_their_name_repeats():
    named = jsonleaves.naming(textrules.usable_name, tx.PATH_NOISE, repeats=True)
    assert named([("a", None, "1e5"), ("data.a", "100000.0", None)]) is None
    assert named([("data.a", "100000.0", None), ("a", None, "1e5")]) is None
    assert named([("a", None, "1e5"), ("b", "x", None), ("data.b", "x ", None)]) == [("a", None, "1e5", "a"), ("b", "x", None, "b"), None]
    assert all(jsonleaves.malformed(t, jsonleaves.parser(str)) == (jsonleaves.whole_leaves(t) is None) for t in (
        None, "", "{", "[1]", "7", '{"a":1}', '{"a":NaN}', "[" * 9000, "[" * 9000 + "]" * 9000, '{"a":' + "1" * 5000 + "}", '﻿{}'))
