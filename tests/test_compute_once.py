from pyspark.sql import functions as F

from attrloom.functions import text as tx
from attrloom.operators import freetext as ft
from attrloom.operators import records as rc
from attrloom.plans import documents as dc

LINE = "doc_id long, page int, line_no long, line string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_is_parsed_in_one_place(spark, tmp_path):
    lines = [(1, " Key : a=b "), (2, "name: value"), (3, "x"), (4, None), (5, "no mark here"), (6, " Note - ")]
    spark.createDataFrame(lines, "doc_id long, line string").write.parquet(f"{tmp_path}/t")
    found = rc.key_value_lines(spark.read.parquet(f"{tmp_path}/t"))
    assert sorted(map(tuple, found.collect())) == [(6, "Note", "")]
    assert plan(found).count("{1,80}?") == 3  # the test and the two parts; once for every use of a part before


def test_cells_are_cleaned_in_one_place(spark, tmp_path):
    rows = [(1, 1, 0, 0, [" ", "Qty", "None", "5"]), (1, 1, 0, 1, ["Qty"]), (1, 1, 0, 2, None), (2, 1, 0, 0, ["1,2", "x"]), (2, 1, 0, 1, ["qty ", None, " 5", "6"])]
    spark.createDataFrame(rows, "doc_id long, page int, table_no long, row_no long, cells array<string>").write.parquet(f"{tmp_path}/t")
    got = dc.table_row_records(spark.read.parquet(f"{tmp_path}/t"))
    assert sorted((r.doc_id, r.attribute, r.value) for r in got.collect()) == [(1, "Qty", "5"), (2, "qty", "5")]
    assert plan(got).count("filter(transform(cells") == 1


def test_verdict_in_place_of_the_lines(spark):
    prose = "The buyer asked us to send all of the goods in the morning and said thanks. All is well now!"
    lines = spark.createDataFrame([(1, 1, 0, f" {prose}　 x?"), (2, 1, 0, "Code: 7"), (2, 1, 1, " \t"), (3, 1, 0, None)], LINE)
    rows = spark.createDataFrame([], "doc_id long, page int, table_no long, row_no long, cells array<string>")
    facts = {r["doc_id"]: (r["n_lines"], r["n_words"], r["marks"], r["is_narrative"]) for r in ft.narrative_lines(lines).collect()}
    assert facts == {1: (1, 21, 3, True), 2: (1, 2, 0, False)}
    verdict = dc.line_verdicts(lines)
    records, docs = dc.pdf_records(rows, lines, verdict)
    kinds = dc.route_lines(records, docs, dc.pdf_text(lines), lines, verdict)[1]
    assert sorted((r["doc_id"], r["doc_type"], r["n_records"]) for r in kinds.collect()) == [(1, "unstructured", 0), (2, "keyvalue", 1), (3, "keyvalue", 0)]
    plain = dc.route_lines(*dc.pdf_records(rows, lines), dc.pdf_text(lines), lines)[1]
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, kinds.collect()))
    assert "translate" not in plan(kinds) and "translate" in plan(plain)


def test_one_row_for_every_row(spark):
    got = tx.compute_once(spark.createDataFrame([(1, "a"), (2, None)], "k long, s string"), F.upper("s"), "_u").collect()
    assert sorted((r["k"], r["_u"]) for r in got) == [(1, "A"), (2, None)]
