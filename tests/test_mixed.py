from pyspark.sql import functions as F

from attrloom import session
from attrloom.plans.mixed import DocumentInputs, document_records, normalize_documents
from attrloom.plans import report as rp

PROSE = "The buyer asked us to send 12 of the goods in the morning and said thanks. Payment was by UPI and all is well now."


def inputs(spark):
    paths = spark.createDataFrame([("a", "x/a.xlsx"), ("b", "b.CSV"), ("c", "c.pdf"), ("d", "d.docx"), ("e", "e.json"), ("f", "f.xml"), ("g", "g.exe"),
                                   ("h", "h.json"), ("i", "i.xml"), ("j", "j.pdf"), ("k", "noext")], "doc_id string, path string")
    grid = spark.createDataFrame([("a", "s", 0, ["Order No", "ORD-1"]), ("a", "s", 1, ["Due Date", "2024-01-02"]), ("b", "", 0, [PROSE])],
                                 "doc_id string, sheet string, row_no long, cells array<string>")
    rows = spark.createDataFrame([("c", 1, 0, 0, ["Total Cost", "45"])], "doc_id string, page int, table_no int, row_no int, cells array<string>")
    lines = spark.createDataFrame([("c", 1, 0, "page head"), ("d", 1, 0, PROSE)], "doc_id string, page int, line_no int, line string")
    texts = spark.createDataFrame([("e", '{"order":{"dueDate":"2024-01-02"}}'), ("f", "<root><qty>2</qty></root>"), ("h", "{"), ("i", "<r>")], "doc_id string, text string")
    return DocumentInputs(paths, grid, rows, lines, texts)


def test_every_document_is_read_or_reported(spark):
    records, docs, errors = document_records(inputs(spark))
    got = {}
    for r in records.collect():
        got.setdefault(r["doc_id"], set()).add((r["attribute"], r["value"]))
    assert got["a"] == {("Order No", "ORD-1"), ("Due Date", "2024-01-02")} and got["c"] == {("Total Cost", "45")}
    assert ("Payment Method", "UPI") in got["b"] and ("Payment Method", "UPI") in got["d"]
    assert got["e"] == {("order due date", "2024-01-02")} and got["f"] == {("qty", "2")}
    assert {r["doc_id"]: (r["input_format"], r["doc_type"]) for r in docs.collect()} == {
        "a": ("excel", "keyvalue"), "b": ("csv", "unstructured"), "c": ("pdf", "keyvalue"), "d": ("docx", "unstructured"),
        "e": ("json", "json"), "f": ("xml", "xml")}
    found = {r["doc_id"]: r["error"] for r in errors.collect()}
    assert found.pop("i") and found == {"g": "unknown format", "k": "unknown format", "h": "malformed", "j": "nothing was read"}


def test_from_documents_to_report(spark, dictionary):
    normalized, _, _ = normalize_documents(inputs(spark), dictionary)
    report = {r["doc_id"]: (r["total_attributes"], r["matched"]) for r in rp.report(normalized).collect()}
    assert report["a"][0] == 2 and report["a"][1] >= 1 and set(report) == {"a", "b", "c", "d", "e", "f"}
    only = DocumentInputs(inputs(spark).paths.filter(F.col("doc_id") == "g"))
    records, docs, errors = document_records(only)
    assert records.isEmpty() and docs.isEmpty() and errors.count() == 1


def test_intermediate_tables_have_an_owner(spark, tmp_path):
    before = dict(session._OWNED)
    session._OWNED.clear()
    held = session.materialize(spark.range(3), "mine")
    path = session._OWNED[spark.sparkContext.applicationId][0].removeprefix("file:")
    import os
    assert held.count() == 3 and os.path.isdir(path)
    session.release(spark)
    assert not os.path.exists(path)
    session._OWNED.update(before)
