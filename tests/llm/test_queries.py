"""The registered queries against their SQL, and the pipeline's stages."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.mark.parametrize("name", ["op3_chat", "op10_decontaminate", "op11_hard_negatives", "op12_page_text", "op13_collocations"])
def test_query_equals_oracle(spark, name):
    import duckdb

    from attrloom.llm.cases import ORACLES, QUERIES
    from check import rows
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "embeddings", "pages"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    want = duck.execute(ORACLES[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in want.description], want.fetchall())


def test_pipeline_stages(spark):
    import corpus_pipeline
    from attrloom.llm import decontaminate, toxicity
    from attrloom.llm.encoder import encoder
    from attrloom.session import materialize
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, bench = docs.columns, spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, FOLDER), name)
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{FOLDER}/labels.parquet"))
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in toxicity.grade(before, model).filter("NOT rejected").collect()}
        if name == "near_duplicates":
            assert docs.select("text").distinct().count() == docs.count()
        if name == "decontamination":
            assert docs.count() == decontaminate.find_matches(before, bench).filter("n_hit = 0").count()
        if name == "personal_data":
            assert docs.count() == before.count()
        assert docs.columns == columns or name == "encoding"
    texts = {r.doc_id: r.text for r in before.collect()}
    assert {r.doc_id: list(r.ids) for r in docs.collect()} == {i: encoder().library.encode_ordinary(t) for i, t in texts.items()}


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "on the " * 3000, "en", "s", 21000)]])
def test_pipeline_takes_awkward_tables(spark, tmp_path, rows):
    import corpus_pipeline
    folder = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted({"1", "2"} if rows else set()) or len(out) == len({r[0] for r in rows})
