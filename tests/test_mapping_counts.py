from pyspark.sql import functions as F

from attrloom.operators import records as rc
from attrloom.operators.matching import choices, resolve
from attrloom.plans.normalize import mapping_counts, match_records, name_mapping
from attrloom.sources.dictionary import seed_dictionary

TIERS = ["exact", "prefix", "abbrev", "fuzzy_spaced", "fuzzy_expanded", "semantic_spaced", "semantic_expanded"]


def test_counts_per_pair(spark):
    rows = [("order date", "2024-01-02"), (" order date ", "2024-01-02"), ("order date", "soon"), ("order date", None),
            ("odd thing", None), ("odd thing", "a"), ("odd thing", "a"), (None, "a"), ("", "b")]
    records = spark.createDataFrame(rows, "attribute string, value string")
    dictionary = seed_dictionary(spark)
    mapping = name_mapping(records, dictionary)
    plain = match_records(records, dictionary, mapping=mapping).groupBy("raw_attr", "canonical_attr", "match_type").agg(
        F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))
    got = sorted(map(tuple, mapping_counts(records, dictionary, mapping=mapping).collect()))
    assert got == sorted(map(tuple, plain.collect()))
    assert {r[0]: r[3:] for r in got if r[0] != "order date"} == {"odd thing": (3, 1), "": (2, 2)}
    assert sum(r[3] for r in got) == len(rows)


def test_first_accepting_choice(spark):
    hit = "struct<canonical:string,guard:string,match_type:string,confidence:double,variation:string>"
    c = lambda name, guard=None: (name, guard, "t", 1.0, None)
    names = [("settled", c("A"), c("B", "date")), ("asked", c("A", "date"), c("B", "date"), c("C", "amount"), c("D"), c("E", "id")), ("none",)]
    rows = [(n, *hits, *[None] * (7 - len(hits))) for n, *hits in names]
    side = spark.createDataFrame(rows, ", ".join(["norm string", *(f"{t} {hit}" for t in TIERS)])).select("norm", *choices())
    asked = {r["norm"]: r["choices"] for r in side.collect()}
    assert [x["canonical"] for x in asked["asked"]] == ["A", "C", "D"] and asked["settled"] is None and asked["none"] is None
    values = spark.createDataFrame([("2024-01-02",), ("rs",), ("word",), ("",), (None,)], "value string")
    got = {(r["norm"], r["value"]): r["m"]["canonical"] for r in side.crossJoin(values).withColumn("m", resolve("norm", "value")).collect()}
    assert {v: got["asked", v] for v in ("2024-01-02", "rs", "word", "", None)} == {"2024-01-02": "A", "rs": "C", "word": "D", "": "A", None: "A"}
    assert {got["settled", v] for v in ("word", None)} == {"A"} and got["none", "word"] == "none"


def test_names_alone_read_no_value(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (2, None)], "o_key long, o_note string").write.parquet(f"{tmp_path}/t")
    long = rc.unpivot_table(spark.read.parquet(f"{tmp_path}/t"), "o_key")
    assert sorted(map(tuple, long.collect())) == [(1, 0, "key", "1"), (1, 1, "note", "x"), (2, 0, "key", "2"), (2, 1, "note", "")]
    names = long.groupBy("attribute").count()
    assert "ReadSchema: struct<>" in names._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, names.collect())) == [("key", 2), ("note", 2)]
