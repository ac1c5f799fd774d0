"""Grids, lines, nested documents and free text on small literal frames."""

import random
import re

import pytest
from pyspark.sql import functions as F

from attrloom.functions import text as tx
from attrloom.operators import freetext as ft
from attrloom.operators import grids as gr
from attrloom.operators import nested as ns
from attrloom.operators import records as rc

GRID = "doc_id int, sheet string, row_no long, cells array<string>"


def pairs(df, *cols):
    return [tuple(r[c] for c in cols or ("attribute", "value")) for r in df.orderBy("pos").collect()]


def test_fifty_thousand_headers(spark):
    import time

    from pyspark.sql import functions as F
    cells = [f"h{k % 20_000}" if k % 7 else " " for k in range(50_000)]
    df = spark.createDataFrame([(cells,), ([],), (["a", "b"],), (["x"] * 3,)], "c array<string>")
    start = time.time()
    got = [r[0] for r in df.select(gr.unique_headers("c").alias("h")).collect()]
    assert time.time() - start < 20
    seen, want = {}, []
    for k, c in enumerate(cells):
        name = c.strip() or f"col_{k + 1}"
        seen[name] = seen.get(name, 0) + 1
        want.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    assert got == [want, [], ["a", "b"], ["x", "x_2", "x_3"]] and df.filter(F.size("c") < 0).isEmpty()


def test_unique_headers(spark):
    df = spark.createDataFrame([(["A", "A", "", "B", "A"],)], "c array<string>")
    assert df.select(gr.unique_headers("c")).first()[0] == ["A", "A_2", "col_3", "B", "A_3"]


def test_header_heuristic(spark):
    rows = [["Key", "Value"], ["a", "b", "c"], ["a", "b"], ["a", "b", "x" * 31], ["a", "₹5", "c"], ["", None], ["field_name", "val"]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c array<string>")
    assert [r[0] for r in df.orderBy("i").select(gr.looks_like_header("c")).collect()] == [True, True, False, False, False, False, False]


def test_workbook_cleaning_drops_null_columns_but_not_blank_ones(spark):
    grid = spark.createDataFrame([(1, "s", 0, ["a", None, " ", "NaN"]), (1, "s", 1, [None, None, None, None]), (1, "s", 2, ["b", "N/A", None, None])], GRID)
    got = [tuple(r) for r in gr.clean_workbook(grid).select("row_no", "cells", "width").orderBy("row_no").collect()]
    assert got == [(0, ["a", ""], 2), (2, ["b", ""], 2)]


def test_wide_records_keep_columns_and_dedupe_whole_rows(spark):
    rows = [["Key", "Note", "Value"], ["Qty", "n1", "5"], ["qty", "n1", "5"], ["Qty", "n2", "5"], ["Qty", "n1", "5"], ["1,2", "n", "5"], ["name", "n", "5"], ["x", "n", ""]]
    grid = spark.createDataFrame([(1, "s", i, r) for i, r in enumerate(rows)], GRID)
    got = gr.extract_wide(grid).orderBy("pos").collect()
    assert [(r["pos"], r["attribute"], r["value"], r["extras"]["Note"]) for r in got] == [(1, "Qty", "5", "n1"), (2, "qty", "5", "n1"), (3, "Qty", "5", "n2")]


def test_ragged_rows_and_repeated_headers(spark):
    grid = spark.createDataFrame([(1, "s", 0, ["A", "A", "A_2"]), (1, "s", 1, ["x", "1"]), (1, "s", 2, ["y", "2", "3"])], GRID)
    got = gr.extract_wide(grid).orderBy("pos").collect()
    assert [r["extras"] for r in got] == [{"A": "x", "A_2": ""}, {"A": "y", "A_2": "3"}]


def test_pairs_of_two_column_grids(spark):
    rows = [["Field Label", "Value"], ["Qty", "5"], ["qty", "5"], ["", "only"], ["1,200", "x"], ["Attribute", "y"]]
    grid = spark.createDataFrame([(1, "s", i, r) for i, r in enumerate(rows)], GRID)
    assert pairs(gr.extract_pairs(grid)) == [("Qty", "5"), ("1,200", "x")]
    assert pairs(gr.extract_csv_pairs(grid)) == [("Qty", "5"), ("qty", "5"), ("1,200", "x")]


def test_key_value_lines(spark):
    lines = ["Items: 5", "Status:shipped", "a-b", "ab", "1x: 5", "name: x", "Empty:", "A = b = c", "x" * 90 + ": y"]
    df = spark.createDataFrame([(1, i, ln) for i, ln in enumerate(lines)], "doc_id int, pos long, line string")
    line_rule = re.compile(r"^([A-Za-z][^:=\-]{1,80}?)[\s]*[:=\-]+[\s]*(.*)$")
    expected = [(m[1].strip(), m[2].strip()) for ln in lines if len(ln) >= 3 and (m := line_rule.match(ln)) and m[1].strip() != "name"]
    assert pairs(rc.key_value_lines(df)) == expected


def test_dedupe_keys(spark):
    df = spark.createDataFrame([(1, 0, "A", "x"), (1, 1, "a", "x"), (1, 2, "a", "X")], "doc_id int, pos long, attribute string, value string")
    assert rc.clean_records(df).count() == 2
    assert pairs(rc.dedupe_records(df, ignore_value_case=True)) == [("A", "x")]


@pytest.mark.parametrize(("rows", "broken"), [
    ([("12", "x")] * 1 + [(f"name {i}", "v") for i in range(5)], False),
    ([("12", "x"), ("ab", "y")] + [(f"name {i}", "v") for i in range(4)], True),
    ([("abc", "a=b=c"), ("abd", "a=b=")], True),
    ([(f"name {i}", "v") for i in range(20)] + [("1", "x")] * 30, False),
])
def test_broken_table(spark, rows, broken):
    df = spark.createDataFrame([(1, i, a, v) for i, (a, v) in enumerate(rows)], "doc_id int, pos long, attribute string, value string")
    assert rc.broken_table_flags(df).first()["is_broken"] is broken


def test_unpivot_treats_headers_as_names(spark):
    df = spark.createDataFrame([(7, "x", None)], "o_key int, o_status string, note string")
    assert pairs(rc.unpivot_table(df, "o_key")) == [("key", "7"), ("status", "x"), ("note", "")]


def test_json_flatten(spark):
    docs = [(1, '{"data":{"order":{"payMode":"UPI","items":[{"qty":2}],"tags":["x"]}}}'), (2, '{"name":"Bob","customer":{"name":"Bob"}}'),
            (3, '[{"a":1.0,"b":true,"c":null,"e":1.5e-7},[{"z":1}],{},5]'), (4, "{bad"), (5, '{"k":1,"k":2}'), (6, '"scalar"')]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    got = {}
    for r in ns.flatten_json(df).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append((r["attribute"], r["value"]))
    assert got == {1: [("order items 1 qty", "2"), ("order pay mode", "UPI")], 2: [("customer name", "Bob")],
                   3: [("item 1 a", "1.0"), ("item 1 b", "True"), ("item 1 e", "1.5e-07"), ("item 2 1 z", "1")], 5: [("k", "2")]}
    assert [r["doc_id"] for r in ns.unparsable_json(df).collect()] == [4]
    assert ns.flatten_json(df.filter("doc_id = 2"), strip_headers=False).count() == 2


def test_json_of_any_depth_is_read(spark):
    deep = "".join(f'{{"k{i}":[' for i in range(60)) + '{"a":1,"b":[[{"c":2}]]}' + "]}" * 60
    df = spark.createDataFrame([(1, deep), (2, '[[[{"a":1}]]]'), (3, '{"a":{"b":{"c":1}}}')], "doc_id int, text string")
    got = {r["raw_attribute"]: r["value"] for r in ns.flatten_json(df).filter("doc_id = 1").collect()}
    path = ".".join(f"k{i}_1" for i in range(60))
    assert got == {f"{path}.a": "1", f"{path}.b_1_1.c": "2"}
    assert pairs(ns.flatten_json(df.filter("doc_id > 1"))) == [("a b c", "1"), ("item 1 1 1 a", "1")] or len(pairs(ns.flatten_json(df.filter("doc_id > 1")))) == 2


def test_documents_that_cannot_be_read_are_listed_with_a_reason(spark, monkeypatch):
    df = spark.createDataFrame([(1, "{bad"), (2, "{" + " " * 40), (3, '{"a":1}'), (4, None), (5, ""), (6, '{"a":1} x'), (7, '{"a":01}')], "doc_id int, text string")
    want = {1: "malformed", 2: "malformed", 4: "malformed", 5: "malformed", 6: "malformed", 7: "malformed"}
    assert {r["doc_id"]: r["error"] for r in ns.unparsable_json(df).collect()} == want
    # The same in pieces; null and empty texts have none.
    monkeypatch.setattr(ns, "PIECED_BYTES", 1)
    assert {r["doc_id"]: r["error"] for r in ns.unparsable_json(df).collect()} == want


JSON_TEXTS = [
    '{"data":{"order":{"payMode":"UPI","items":[{"qty":2}],"tags":["x"]}}}', '[{"a":1.0,"b":true,"c":null,"e":1.5e-7},[{"z":1}],{},5]', "{bad", '{"k":1,"k":2}',
    '{"a":{"x":1,"y":[{"q":1}]},"b":2,"a":{"y":3},"b":{"c":4}}', '"scalar"', "[]", " {} ", '{"é\\u00e9":"\\ud83d\\ude00 \\ud800","":{"a":"q\\"\\\\"},"z":"\U0001f600","\uffff":1}',
    '{"n":[1,2],"m":{"big":123456789012345678901234567890,"tiny":1e-300,"huge":1e400,"int":-0,"dec":12.50}}', '{"same":"v","Same":"v","same ":"v"}', '{"a":1}{"b":2}',
    "".join(f'{{"k{i}":[' for i in range(60)) + '{"a":1,"b":[[{"c":2}]]}' + "]}" * 60]


def test_pieces_give_what_whole_texts_give(spark, monkeypatch):
    from attrloom.functions import jsonleaves
    df = spark.createDataFrame(list(enumerate(JSON_TEXTS)), "doc_id int, text string").repartition(3)
    want = sorted(tuple(r) for r in ns.flatten_json(df).collect())
    assert {i for i, *_ in want} == {0, 1, 3, 4, 8, 9, 10, 12}
    assert [r[2:] for r in want if r[0] == 4] == [("a y", "3", "a.y"), ("b c", "4", "b.c")]
    monkeypatch.setattr(ns, "PIECED_BYTES", 1)
    monkeypatch.setattr(ns, "PIECE_BYTES", 7)
    monkeypatch.setattr(jsonleaves, "STRETCH", 10)
    assert sorted(tuple(r) for r in ns.flatten_json(df).collect()) == want


def test_json_readers_agree_with_the_plain_tree():
    import json
    import random

    from attrloom.functions import jsonleaves
    rng = random.Random(1)

    def plain(v, path="", keyed=False):
        if isinstance(v, dict):
            return [x for k in sorted(v) for x in plain(v[k], f"{path}.{k}" if path else k, True)]
        if isinstance(v, list):
            return [x for i, y in enumerate(v, 1) for x in plain(y, f"{path or 'item'}_{i}")]
        return [(path, "" if v is None else v if isinstance(v, str) else str(v))] if keyed else []

    def make(depth):
        kind = rng.random()
        if depth > 5 or kind < 0.35:
            return rng.choice([1, -2.5, True, None, "x", 'é\n"q\\', "", 1e3, " "])
        if kind < 0.7:
            return {rng.choice(["a", "b", "A", "é", "k k", "", "z.y"]) + str(rng.randint(0, 3)): make(depth + 1) for _ in range(rng.randint(0, 5))}
        return [make(depth + 1) for _ in range(rng.randint(0, 4))]

    def is_json(text):
        try:
            json.loads(text)
        except ValueError:
            return False
        return True

    for _ in range(600):
        tree = make(0)
        text = json.dumps(tree, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        got = jsonleaves.whole_leaves(text)
        assert [(p, v if v is not None else str(json.loads(n))) for p, v, n in got] == plain(tree)
        data = text.encode()
        reader, step, found = jsonleaves.LeafReader(), rng.randint(1, 9), []
        for at in range(0, len(text), step):
            found += reader.feed(text[at:at + step], False)
        found += reader.feed("", True)
        assert not reader.failed and [x[2:] for x in sorted(found, key=lambda x: x[1])] == got
        pieces = jsonleaves.read_pieces([data[k:k + 5] for k in range(0, len(data), 5)])
        assert [x[2:] for x in sorted((x for part in pieces for x in part), key=lambda x: x[1])] == got
        place = rng.randrange(len(text))
        for broken in (text[:place], text[:place] + rng.choice('{}[],:"1a\\ ') + text[place + 1:]):
            reader = jsonleaves.LeafReader()
            reader.feed(broken, True)
            assert (not reader.failed) == is_json(broken) == (jsonleaves.whole_leaves(broken) is not None)


def test_very_deep_and_very_large_json(spark, tmp_path):
    from pyspark.sql import functions as F
    deep = spark.createDataFrame([(1, '{"a":' * 5000 + '{"leaf":"deep"}' + "}" * 5000)], "doc_id int, text string")
    row = ns.flatten_json(deep).first()
    assert (row.value, row.raw_attribute) == ("deep", "a." * 5000 + "leaf") and ns.unparsable_json(deep).isEmpty()
    with open(tmp_path / "large.json", "w") as out:
        for k in range(3000):
            out.write(f'{"," if k else "{"}"k{k}":"{"x" * 100_000}"')
        out.write("}")
    large = spark.read.text(str(tmp_path / "large.json"), wholetext=True).select(F.lit(2).alias("doc_id"), F.col("value").alias("text"))
    got = ns.flatten_json(large).agg(F.count("*"), F.countDistinct("raw_attribute"), F.sum(F.length("value")), F.max("pos")).first()
    assert tuple(got) == (3000, 3000, 300_000_000, 2999)


def test_xml_flatten(spark):
    df = spark.createDataFrame([(1, '<root><order id="7"><qty>2</qty>tail<qty>2</qty></order><v>007</v></root>'), (2, "<a><b>")], "doc_id int, text string")
    assert pairs(ns.flatten_xml(df), "attribute", "value", "raw_attribute") == [
        ("order id", "7", "root.order.id"), ("order qty", "2", "root.order.qty"), ("v", "007", "root.v")]
    assert [r["doc_id"] for r in ns.unparsable_xml(df).collect()] == [2]


def test_salvage(spark):
    df = spark.createDataFrame([(1, 'x [ {"attribute":"a","value":"1"}, {"attribute":"b","value":null} ] y'), (2, '{"items":[{"attribute":"k","value":true},3]}'),
                                (3, '{"records":5,"data":[{"attribute":"d","value":1}]}'), (4, "nothing"), (5, None)], "doc_id int, response string")
    got = [(r["doc_id"], r["attribute"], r["value"]) for r in ns.salvaged_records(df).orderBy("doc_id", "pos").collect()]
    assert got == [(1, "a", "1"), (1, "b", "None"), (2, "k", "True"), (3, "d", "1")]


def test_salvage_parses_a_text_once(spark):
    df = spark.createDataFrame([(1, '{"items": [{"attribute": "k", "value": 1.0}]}')], "doc_id int, response string")
    plan = ns.salvaged_records(df)._jdf.queryExecution().optimizedPlan().toString()
    # Once as a whole and once as a bracketed run; five parses of a malformed text were five exceptions.
    assert plan.count("parse_json") + plan.count("parseJson") == 2
    odd = ['No [{"attribute": "a", "value": 1e-7}] more', '\n[{"attribute": "a", "value": 2.0}, [1], null, 7, {"value": 3}]',
           '[[{"attribute": "b", "value": false}]', '{"data": {}, "x": [{"attribute": "c", "value": "d", "e": 1}]}', "nothing", None, "{"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id int, response string")
    got = [(r["doc_id"], r["pos"], r["attribute"], r["value"]) for r in ns.salvaged_records(df).orderBy("doc_id", "pos").collect()]
    assert got == [(0, 0, "a", "1e-07"), (1, 0, "a", "2.0"), (2, 0, "b", "False"), (3, 0, "c", "d")]


def cut(text, size, overlap):
    """The chunk boundaries restated on Python strings."""
    text, out, start = text.strip(), [], 0
    if len(text) <= size:
        return [text] if text else []
    while True:
        end = min(start + size, len(text))
        if end < len(text):
            window = text[start:end]
            at = max(window.rfind(m) for m in ("\n", ". ", "; "))
            if at > int(size * 0.6):
                end = start + at + 1
        if text[start:end].strip():
            out.append(text[start:end].strip())
        if end >= len(text):
            return out
        start = max(end - overlap, start + 1)


@pytest.mark.parametrize(("size", "overlap"), [(2200, 250), (40, 7), (30, 29)])
def test_chunks_against_python(spark, size, overlap):
    rnd = random.Random(size)
    texts = ["", "x", "a" * 5000, " \n" + "b" * 100 + "\n "] + ["".join(rnd.choice("ab .;\n é") for _ in range(rnd.randint(1, 400))) for _ in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {}
    for r in ft.chunks(df, max_chars=size, overlap=overlap).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {i: cut(t, size, overlap) for i, t in enumerate(texts) if cut(t, size, overlap)}


def test_narrative_on_texts_and_lines_agree(spark):
    prose = "The buyer asked us to send all of the goods in the early morning and said many thanks."
    texts = [prose, "Key: 1\nOther: 2", "\n".join([prose] * 7), "\n".join(["Key: value"] * 3 + [prose] * 7), "", "Short one. Two now? Yes!",
             "We came and saw it all there today. It was good."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    by_text = {r["doc_id"]: r["is_narrative"] for r in ft.narrative_facts(df).collect()}
    assert by_text == {0: True, 1: False, 2: True, 3: False, 4: False, 5: False, 6: True}
    lines = df.select("doc_id", F.explode(tx.lines("text")).alias("line"))
    by_line = {r["doc_id"]: r["is_narrative"] for r in ft.narrative_lines(lines).collect()}
    assert by_line == {k: v for k, v in by_text.items() if k != 4}


def test_sentences(spark):
    text = ("John Smith placed an order for 5 units of Blue Widget at the store. The total amount is 500 rupees. Payment was via UPI. "
            "on 12 March 2024\nItems: 5\nname: x\nitems: 5")
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert pairs(ft.extract_sentences(df)) == [
        ("Items", "5"), ("Total Order Value", "500 rupees"), ("Quantity", "5"), ("Order Date", "12 March 2024"), ("Payment Method", "UPI"),
        ("Customer Name", "John Smith"), ("Product Name", "Blue Widget")]
    assert pairs(ft.extract_chunked(df)) == pairs(ft.extract_sentences(df))


def test_chunk_overlap_gives_each_record_once(spark):
    filler = "word " * 420
    df = spark.createDataFrame([(1, filler + "\nCode: A7\n" + filler + "\nCode: B8")], "doc_id int, text string")
    assert pairs(ft.extract_chunked(df)) == [("Code", "A7"), ("Code", "B8")]


def test_fields_and_phrases(spark):
    text = ("Urgent WO-12 and wo-12 for Plant A7, at 45.5 °C; customer John Smith paid ₹ 5,000; payment method was UPI. "
            "fuel type for cars is diesel. remarks saying 'hello  there you'")
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert pairs(ft.extract_fields(df)) == [
        ("Workorder Number", "WO-12"), ("Temperature", "45.5 C"), ("Final Amount", "₹ 5,000"), ("Site", "Plant A7"),
        ("Customer Name", "John Smith paid"), ("Payment Method", "UPI"), ("Fuel Type", "diesel"), ("Remarks", "hello there you"),
        ("Priority Level", "Urgent")]


def test_triggers_never_hide_a_rule(spark, monkeypatch):
    """Every rule finds the same with and without its trigger words, odd letters included."""
    base = ["WO-1 PO 2 INV-3 EQ4 TRK-5 on 2024/01/02 12 C 30 psi 900 cc 5 kmpl a@b.co 7 inr", "model no X1 payment methd cash pay ſtatus paid",
            "order ſtatus open; delivary status closed; bill to company Acme Ltd", "shpping addres 12 Long Road; fuel typ cng; vehcle type big truck",
            "inſurance ſtatus active ownership typ leased comment 'all is well' for İtem", "PAYMENT by CARD; amount of 5 RUPEEſ for 3 PIECES of ring at",
            "tecnician Bob Ray for Site Q1; device type: press; CUSTMER FULL NAME Ann Lee", "trKKmpl 5 KMPL; 5 Kmpl", "account mngr Tim Poe; mode of payment cash"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(base)], "doc_id int, text string")
    run = lambda: (sorted(map(tuple, ft.extract_fields(df).collect())), sorted(map(tuple, ft.extract_sentences(df).collect())))
    with_triggers = run()
    monkeypatch.setattr(ft, "_if_triggered", lambda low, words, found: found)
    assert run() == with_triggers
