"""CSV files read in splits against the reader that takes a file in one task."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrloom.sources import csvsplit, files

CELLS = ["a", "", "two\nlines", 'q"x', "a,b", "\n", '""', "x" * 70, "three\n\nlines\n", "ä€", "5", '"\n"', ",\n,"]


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "331")
    spark.conf.set("spark.sql.files.openCostInBytes", "8")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def written(rows, end="\n"):
    return end.join(",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in '",\n') else c for c in r) for r in rows) + end


def grids(spark, path):
    got = {}
    for r in files.csv_grid(spark, path).orderBy("doc_id", "row_no").collect():
        got.setdefault(r["doc_id"].rsplit("/", 1)[-1], []).append(r["cells"])
    return got


def test_splits_equal_the_written_rows(spark, tmp_path, small_splits):
    rng, want = random.Random(5), {}
    for name, end in (("a.csv", "\n"), ("b.csv", "\n"), ("c.csv", "\r\n")):
        rows = [["k" + str(i), *rng.choices(CELLS, k=rng.randint(1, 6))] for i in range(120)]
        (tmp_path / name).write_bytes(written(rows, end).encode())
        want[name] = rows
    # One record over many splits, in a file of its own and with ordinary rows around it.
    long = [["h", "v"], ["k", "line\n" * 300 + "end"], ["l", "w"]]
    (tmp_path / "d.csv").write_text(written(long), encoding="utf-8")
    want["d.csv"] = long
    assert spark.read.text(str(tmp_path / "d.csv")).rdd.getNumPartitions() > 4
    assert grids(spark, str(tmp_path)) == want
    numbers = files.csv_grid(spark, str(tmp_path)).select("doc_id", "row_no")
    assert numbers.distinct().count() == numbers.count()


def test_splits_equal_the_one_task_reader(spark, tmp_path, small_splits):
    """Stray quotes inside and behind fields, and a field that never closes: records are cut where the CSV reader cuts."""
    rows = ['a,5" pipe,c', 'x,"in 5"" pipe\nnext",z', ' "not quoted, two', 'b,"open"tail,"c\nd"', '"""",y', 'p,"q"\n', 'n,"never closed', "more,", "and 1,2"]
    text = "\n".join(rows * 1) + "\n"
    (tmp_path / "s.csv").write_text(("plain,row\n" * 30) + text, encoding="utf-8")
    path = str(tmp_path / "s.csv")
    whole = spark.read.csv(path, schema="c0 string, c1 string, c2 string, c3 string", multiLine=True, escape='"')
    firsts = [r[0] for r in whole.collect()]
    got = [r["cells"][0] for r in files.csv_grid(spark, path).orderBy("row_no").collect()]
    assert got == firsts


def test_states_follow_every_composition():
    rng = np.random.default_rng(3)
    for _ in range(200):
        out, inn, entry = rng.random(9) < 0.5, rng.random(9) < 0.5, bool(rng.integers(2))
        state, want = entry, []
        for o, i in zip(out, inn, strict=True):
            state = bool(i if state else o)
            want.append(state)
        assert csvsplit.states(out, inn, entry).tolist() == want


def test_states_are_sent_by_join_where_they_are_many(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(csvsplit, "BROADCAST_SPLITS", 0)
    rows = [[f"k{i}", 'two\n"lines"', "x" * (i % 40)] for i in range(60)]
    (tmp_path / "j.csv").write_text(written(rows), encoding="utf-8")
    assert grids(spark, str(tmp_path)) == {"j.csv": rows}


def test_empty_and_broken_files(spark, tmp_path, small_splits):
    (tmp_path / "e.csv").write_bytes(b"")
    (tmp_path / "u.csv").write_bytes(b"\xef\xbb\xbfa,b\xff\n\n\n,,\n" + b"c,d\n" * 40)
    got = grids(spark, str(tmp_path))["u.csv"]
    assert len(got) == 41 and got[0][0] == "a" and got[1:] == [["c", "d"]] * 40
    assert csvsplit.csv_records(spark, str(tmp_path / "e.csv")).filter(F.col("record") != "").isEmpty()
