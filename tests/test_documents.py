"""Per-format plans, reports, sinks and file sources end to end."""

import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from attrloom.plans import documents as dc
from attrloom.plans import report as rp
from attrloom.plans.normalize import normalize_records
from attrloom.sinks import writers as wr
from attrloom.sources import files
from attrloom.sources.dictionary import load_dictionary

PROSE = "Anna Berg placed an order for 5 units of ring at our store. The total amount is 500 rupees and payment came by UPI"
ROWS = "doc_id int, page int, table_no int, row_no int, cells array<string>"
LINES = "doc_id int, page int, line_no int, line string"


def by_doc(df):
    out = {}
    for r in df.orderBy("doc_id", "pos").collect():
        out.setdefault(r["doc_id"], []).append((r["attribute"], r["value"]))
    return out


@pytest.fixture(scope="module")
def paged(spark):
    rows = spark.createDataFrame([
        (1, 1, 0, 0, ["Qty", "5"]), (1, 2, 0, 0, ["qty", "5"]), (1, 2, 0, 1, ["12", "x"]), (1, 2, 0, 2, ["Value", "y"]),
        (2, 1, 0, 0, ["ab", "1"]), (2, 1, 0, 1, ["cd", "2"]), (4, 1, 0, 0, ["Qty", "9"])], ROWS)
    lines = spark.createDataFrame([
        (1, 1, 0, "Ignored: 1"), (2, 1, 0, "Code: 7"), (2, 1, 1, "Note:"), (3, 1, 0, PROSE + "."), (4, 1, 0, PROSE + ".")], LINES)
    return rows, lines


def test_pdf(paged):
    rows, lines = paged
    records, docs = dc.pdf_records(rows, lines)
    assert by_doc(records) == {1: [("Qty", "5")], 2: [("Code", "7"), ("Note", "")]}
    assert {r["doc_id"]: r["doc_type"] for r in docs.collect()} == {1: "keyvalue", 2: "keyvalue", 3: "unstructured", 4: "unstructured"}
    routed, kinds = dc.route_lines(records, docs, dc.pdf_text(lines), lines)
    free = by_doc(routed)
    assert free[1] == [("Qty", "5")] and ("Customer Name", "Anna Berg") in free[3] and ("Quantity", "5") in free[4]


def test_docx(paged):
    rows, lines = paged
    records, docs = dc.docx_records(rows, lines)
    assert by_doc(records) == {1: [("Qty", "5")], 2: [("ab", "1"), ("cd", "2")], 4: [("Qty", "9")]}
    texts = {r["doc_id"]: r["text"] for r in dc.docx_text(rows, lines).collect()}
    assert texts[1] == "Ignored: 1\nQty | 5\nqty | 5\n12 | x\nValue | y"
    routed, _ = dc.route_lines(records, docs, dc.docx_text(rows, lines), lines)
    assert ("Quantity", "5") in by_doc(routed)[4]


def test_pdf_tables(paged):
    got = [tuple(r) for r in dc.pdf_tables(paged[0]).filter("doc_id = 2").select("headers", "cells").collect()]
    assert got == [(["ab", "1"], ["cd", "2"])]


def test_excel_and_csv_routing(spark):
    grid = spark.createDataFrame([
        (1, "a", 0, ["Key", "Note", "Value"]), (1, "a", 1, ["Qty", "n", "5"]), (1, "b", 0, ["Unit", "kg", None]),
        (2, "a", 0, ["Code", "7"]), (2, "a", 1, ["Name", "x"]), (3, "a", 0, [PROSE + "."])],
        "doc_id int, sheet string, row_no long, cells array<string>")
    records, docs = dc.excel_records(grid)
    got = by_doc(records)
    assert got[1] == [("Unit", "kg"), ("Qty", "5")] and got[2] == [("Code", "7")] and ("Payment Method", "UPI") in got[3]
    assert {r["doc_id"]: r["doc_type"] for r in docs.collect()} == {1: "multicolumn", 2: "keyvalue", 3: "unstructured"}
    records, docs = dc.csv_records(grid.filter("doc_id > 1"))
    assert by_doc(records)[2] == [("Code", "7")] and ("Payment Method", "UPI") in by_doc(records)[3]


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Inv Code,Item,"Grand, Sum"\nINV-1,"two\nlines",₹25\n,,\nNaN,N/A,\n"q""x",y,z\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("k,v\nx\n", encoding="utf-8")
    grid = files.csv_grid(spark, str(tmp_path))
    got = {}
    for r in grid.orderBy("doc_id", "row_no").collect():
        got.setdefault(r["doc_id"][-5:], []).append(r["cells"])
    assert got == {"a.csv": [["Inv Code", "Item", "Grand, Sum"], ["INV-1", "two\nlines", "₹25"], ['q"x', "y", "z"]], "b.csv": [["k", "v"], ["x"]]}
    split = files.csv_grid(spark, str(tmp_path / "b.csv"), multi_line=False)
    assert [r["cells"] for r in split.orderBy("row_no").collect()] == [["k", "v"], ["x"]]
    (tmp_path / "w.csv").write_text(",".join(f"f{i}" for i in range(3000)) + ',"a, ""b""",,"' + "x" * 20000 + '"\n', encoding="utf-8")
    wide = files.csv_grid(spark, str(tmp_path / "w.csv")).first()["cells"]
    assert len(wide) == 3003 and wide[2999:] == ["f2999", 'a, "b"', "", "x" * 20000]


def test_text_documents_and_formats(spark, tmp_path):
    (tmp_path / "x.json").write_bytes(b'{"a":"b\xff"}')
    assert files.text_documents(spark, str(tmp_path)).first()["text"] == '{"a":"b"}'
    names = spark.createDataFrame([("a/b.PDF",), ("c.xls",), ("d.tar.Csv",), ("noext",), (".csv",)], "p string")
    assert [r[0] for r in names.select(files.file_format("p", strict=False)).collect()] == ["pdf", "excel", "csv", None, None]
    with pytest.raises(Exception, match="Unsupported file type"):
        names.select(files.file_format("p")).collect()


def test_dictionary_file(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"master_attributes": [{"canonical": "A b", "variations": ["x", "y"]}, {"canonical": "C"}]}))
    d = load_dictionary(spark, str(tmp_path / "d.json"))
    assert sorted((r["form"], r["canonical"]) for r in d.exact.collect()) == [("a b", "A b"), ("c", "C"), ("x", "A b"), ("y", "A b")]
    assert [tuple(r) for r in d.profile().orderBy("entry_no").collect()] == [(0, "A b", "x, y", 2), (1, "C", "", 2)]


@pytest.fixture(scope="module")
def matched(spark, dictionary):
    rows = [(1, 0, "Order Code", "ORD-1"), (1, 1, "zzz", "q"), (1, 2, "Order Code", "5"), (1, 3, "departmnt", "x"), (2, 0, "zzz", "<&>"), (2, 1, "machine", "m")]
    return normalize_records(spark.createDataFrame(rows, "doc_id int, pos long, attribute string, value string"), dictionary).persist()


def test_reports(spark, matched):
    assert sorted(map(tuple, rp.report(matched).collect())) == [(1, 4, 2, 2), (2, 2, 1, 1)]
    assert sorted(map(tuple, rp.summary_cards(matched).collect())) == [(1, 4, 2, 2, 1, 1, 0), (2, 2, 1, 1, 0, 0, 1)]
    assert [tuple(r) for r in rp.distribution(matched, []).collect()] == [("Unmatched", 3), ("Exact", 1), ("Fuzzy", 1), ("Prefix", 1)]
    assert sorted(r["raw_attr"] for r in rp.unmatched_names(matched).collect()) == ["zzz", "zzz"]
    first = {r["raw_attr"]: r["match_type"] for r in rp.first_per_name(matched).filter("doc_id = 1").collect()}
    assert first == {"Order Code": "exact", "zzz": "unmatched", "departmnt": "fuzzy"}
    assert {r["raw_attr"]: r["matched_variation"] for r in rp.match_listing(matched).filter("doc_id = 2").collect()} == {"zzz": "—", "machine": "machine"}
    assert {r["doc_id"]: r["match_rate"] for r in rp.match_rate(matched).collect()} == {1: 50.0, 2: 50.0}
    docs = spark.createDataFrame([(1, "/x/v1.a.XLSX", "excel", "keyvalue"), (9, "b", "csv", "keyvalue")], "doc_id int, path string, input_format string, doc_type string")
    got = {r["doc_id"]: (r["format"], r["match_rate_pct"], r["output_name"]) for r in rp.diagnostics(matched, docs).collect()}
    assert got == {1: ("EXCEL", 50, "v1.a_normalized.xlsx"), 9: ("CSV", 0, "b_normalized.csv")}


def test_preview_numbers_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(rp, "SERIAL_BLOCK", 4)
    rows = [(d, p * 3, "" if p == 2 else "a", "") for d in (1, 2) for p in range(20)]
    got = rp.preview(spark.createDataFrame(rows, "doc_id int, pos long, attribute string, value string")).orderBy("doc_id", "pos").collect()
    assert [r["serial_no"] for r in got] == list(range(1, 20)) * 2


def test_sinks(spark, matched, tmp_path):
    docs = {r["doc_id"]: r["json"] for r in wr.json_documents(matched).collect()}
    assert json.loads(docs[2]) == [{"attribute": "zzz", "value": "<&>"}, {"attribute": "Machine Type", "value": "m"}]
    tree = ET.fromstring({r["doc_id"]: r["xml"] for r in wr.xml_documents(matched).collect()}[2].split("\n", 1)[1])
    assert [(e.tag, e.text) for e in tree] == [("zzz", "<&>"), ("machine_type", "m")]
    wr.write_csv(matched, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').filter("doc_id = 2")
    assert sorted((r["Output Attribute"], r["Value"]) for r in back.collect()) == [("Machine Type", "m"), ("zzz", "<&>")]
    wr.write_json(matched, str(tmp_path / "json"))
    wr.write_xml(matched, str(tmp_path / "xml"), folders=True)
    wr.write_xml(matched, str(tmp_path / "pieces"))
    assert spark.read.json(str(tmp_path / "pieces")).filter("doc_id = 1").count() == 6
    named = matched.withColumn("doc_id", F.concat(F.lit("/in/" + "long/" * 80), F.col("doc_id").cast("string")))
    wr.write_csv(named, str(tmp_path / "long"))
    assert spark.read.csv(str(tmp_path / "long"), header=True, escape='"').select("doc_id").distinct().count() == 2
    assert spark.read.json(str(tmp_path / "json")).count() == 6
    written = "".join(f.read_text() for f in sorted((tmp_path / "xml" / "doc_id=1").glob("part-*")))
    assert [e.text for e in ET.fromstring(written.split("\n", 1)[1])] == ["ORD-1", "q", "5", "x"]


def test_xml_tags_and_nesting(spark):
    rows = [(1, 0, "Defect Rate (%)", "1"), (1, 1, "a.b.c", "2"), (1, 2, "7x", "3"), (1, 3, "a.b.d", "4"), (1, 4, " ", "5")]
    xml = wr.xml_documents(spark.createDataFrame(rows, "doc_id int, pos long, attribute string, value string")).first()["xml"]
    assert xml.split("\n", 1)[1] == "<normalized_records><defect_rate____>1</defect_rate____><a><b><c>2</c><d>4</d></b></a><_7x>3</_7x></normalized_records>"


def test_output_projection_with_extras(spark, tmp_path):
    rows = [(1, 0, "A", "1", {"Note": "n", "value": "z"}), (1, 1, "B", "2", {"Note": "m", "Extra": "e"})]
    df = spark.createDataFrame(rows, "doc_id int, pos long, attribute string, value string, extras map<string,string>")
    assert wr.output_projection(df).columns == ["Output Attribute", "Value", "extras"]
    out = wr.output_projection(df, wr.extra_columns(df))
    assert out.columns[:2] == ["Output Attribute", "Value"] and sorted(out.columns[2:]) == ["Extra", "Note"]
    wr.write_tabular(df.withColumn("sheet", F.lit("s" * 40)), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).select("sheet_name").distinct().first()[0] == "s" * 31
    widths = {r["column"]: r["width"] for r in wr.column_widths(out).collect()}
    assert widths["Output Attribute"] == 20 and widths["Value"] == 9


def test_pages_with_very_many_tables_keep_their_order(spark, monkeypatch):
    from attrloom.plans import documents as dc
    rows = [(1, 1, k, 0, [f"n{k}", "v"]) for k in range(10_002)] + [(1, 2, 0, 0, ["n10001", "v"]), (1, 2, 1, 0, ["last", "v"]), (2, 1, 3, 4, ["a b", "c"])]
    df = spark.createDataFrame(rows, "doc_id int, page int, table_no int, row_no int, cells array<string>").repartition(5)
    got = {(r.doc_id, r.attribute): r.pos for r in dc.table_row_records(df).collect()}
    # The table beyond the ten-thousandth and the next page's first had one number before.
    order = [got[1, f"n{k}"] for k in range(10_002)] + [got[1, "last"]]
    assert order == sorted(order) and len(set(order)) == 10_003 and got[2, "a b"] == 1_000_300_000_004
    assert len(got) == 10_004
    monkeypatch.setattr(dc, "TABLE_ROWS", 3)
    few = spark.createDataFrame([(1, 1, 0, k, [f"x{k} y", "v"]) for k in range(9)] + [(1, 1, 1, 0, ["next", "v"])], df.schema)
    assert [r.attribute for r in dc.table_row_records(few).orderBy("pos").collect()] == [f"x{k} y" for k in range(9)] + ["next"]
