"""XML documents are gathered by two aggregates: nothing is stored or joined, and groups at one place stay whole."""

from attrloom.sinks import writers as wr


def test_groups_at_the_same_place_stay_whole(spark):
    df = spark.createDataFrame([(1, 0, "a.x", "1"), (1, 0, "b.y", "2"), (1, 1, "c", None), (1, 2, "a.x", "<3>"), (2, 0, " ", "v")],
                               "doc_id int, pos long, attribute string, value string")
    docs = wr.xml_documents(df)
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Relation" not in plan
    assert [tuple(r) for r in docs.collect()] == [(1, wr.XML_HEAD + "<a><x>1</x><x>&lt;3&gt;</x></a><b><y>2</y></b><c></c>" + wr.XML_FOOT)]
