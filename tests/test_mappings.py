"""The kept name mapping: same results as a full run, no tier for known names, invalidated by its inputs."""

import pytest

from attrloom.operators import matching
from attrloom.plans import mappings
from attrloom.plans.mappings import MappingStore
from attrloom.plans.normalize import normalize_records
from attrloom.sources.dictionary import dictionary_from
from attrloom.streaming.incremental import normalize_stream

SCHEMA = "doc_id int, pos long, attribute string, value string"
FIRST = [(1, 0, "Order Code", "ORD-1"), (1, 1, "departmnt", "x"), (2, 0, "zzz", "q"), (2, 1, None, "n"), (2, 2, "Order Code", "5")]
SECOND = [(3, 0, "order_code", "ORD-2"), (3, 1, "qty", "5"), (3, 2, "zzz", "w"), (3, 3, "", "")]


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def counted(monkeypatch):
    calls, run = [], mappings.map_names

    def counting(names, *args, **options):
        calls.append(sorted(r.norm for r in names.collect()))
        return run(names, *args, **options)

    monkeypatch.setattr(mappings, "map_names", counting)
    return calls


def test_batches_equal_the_full_run(spark, dictionary, tmp_path, counted):
    store = MappingStore(spark, str(tmp_path / "map"), dictionary)
    first, second = (spark.createDataFrame(x, SCHEMA) for x in (FIRST, SECOND))
    for batch in (first, second, first.union(second)):
        got = normalize_records(batch, dictionary, mapping=store.extend(batch))
        assert rows(got) == rows(normalize_records(batch, dictionary))
    # The second batch matched what was new in it, the third nothing.
    assert len(counted) == 2 and counted[1] == ["order_code", "qty"] and len(store._parts()) == 2
    store.compact()
    assert len(store._parts()) == 1 and store.extend(second).count() == len({(r[2] or "").lower() for r in SECOND}) and len(counted) == 2


def test_a_changed_dictionary_or_threshold_starts_anew(spark, tmp_path, counted):
    def of(*entries):
        return dictionary_from(spark.createDataFrame([(i, *e) for i, e in enumerate(entries)], "entry_no int, canonical string, variations array<string>"))

    batch, path = spark.createDataFrame(FIRST, SCHEMA), str(tmp_path / "map")
    one = of(("Order Id", ["order code"]), ("Dept", None))
    stores = [MappingStore(spark, path, one), MappingStore(spark, path, of(("Order Id", ["order code"]), ("Dept", []), ("Zed", ["zzz"]))),
              MappingStore(spark, path, one, fuzzy_threshold=70.0), MappingStore(spark, path, of(("Dept", None), ("Order Id", ["order code"])))]
    assert len({s.folder for s in stores}) == 4
    assert MappingStore(spark, path, of(("Order Id", ["order code"]), ("Dept", None))).folder == stores[0].folder
    for store in stores[:2]:
        assert rows(normalize_records(batch, store.dictionary, mapping=store.extend(batch))) == rows(normalize_records(batch, store.dictionary))
    assert len(counted) == 2


def test_unfinished_parts_and_parts_written_twice(spark, dictionary, tmp_path):
    store = MappingStore(spark, str(tmp_path / "map"), dictionary)
    batch = spark.createDataFrame(FIRST, SCHEMA)
    want = rows(store.extend(batch))
    store._append(store.mapping())
    torn = store.mapping().limit(1).withColumn("norm", mappings.F.lit("torn"))
    torn.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{store.folder}/part-torn")
    assert rows(store.extend(batch)) == want and store.mapping().filter("norm = 'torn'").isEmpty()
    empty = spark.createDataFrame([], SCHEMA)
    assert store.extend(empty).isEmpty() and len(store._parts()) == 2


def test_stream_shares_the_store(spark, dictionary, tmp_path, counted):
    for number, batch in enumerate((FIRST, SECOND, FIRST)):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = MappingStore(spark, str(tmp_path / "map"), dictionary)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = normalize_stream(stream, dictionary, str(tmp_path / "out"), str(tmp_path / "cp"), store=store)
    assert query.awaitTermination(240) and len(counted) == 2
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert rows(got) == rows(normalize_records(spark.createDataFrame(FIRST + SECOND + FIRST, SCHEMA), dictionary))
    with pytest.raises(ValueError, match="belong to the store"):
        normalize_stream(stream, dictionary, "x", "y", store=store, fuzzy_threshold=1.0)
    assert matching.TIERS == mappings.TIERS
