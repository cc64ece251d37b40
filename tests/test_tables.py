"""Versions of stored tables."""

import pytest
from pyspark.sql import functions as F

from coinweave.sources import tables
from helpers import column


def test_versions_replace_and_read_back(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, path)
    assert tables.replace_table(spark.range(3), path) == 1
    old = tables.read_table(spark, path)
    assert tables.replace_table(old.withColumn("id", F.col("id") * 10), path) == 2  # reads what it replaces
    assert column(tables.read_table(spark, path), "id") == [0, 10, 20]
    assert column(old, "id") == column(tables.read_table(spark, path, 1), "id") == [0, 1, 2]
    assert tables.replace_table(spark.range(0), path) == 3 and tables.read_table(spark, path).count() == 0
    assert tables.drop_versions(spark, path, 1) == [1, 2] and tables.versions(spark, path) == [3]


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(5), path)
    bad = spark.range(0, 1000, 1, 8).select(F.when(F.col("id") == 999, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        tables.replace_table(bad, path)
    (tmp_path / "t" / "_draft-killed").mkdir()
    (tmp_path / "t" / "_draft-killed" / "part-0.parquet").write_bytes(b"PAR1 half")
    assert column(tables.read_table(spark, path), "id") == [0, 1, 2, 3, 4]
    assert tables.replace_table(spark.range(1), path) == 2


def test_a_writer_that_comes_second_is_told(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(2), path)
    tables.replace_table(spark.range(3), path)
    with pytest.raises(tables.ConcurrentWrite):
        tables.replace_table(spark.range(4), path, after=1)
    assert column(tables.read_table(spark, path), "id") == [0, 1, 2]


def test_upsert_keeps_the_last_row(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "tx_id string, v int, m map<string, int>").coalesce(1)
    tables.upsert_table(path, rows(("a", 9, None), ("a", 1, {"x": 1}), ("b", 2, None), (None, 5, None)), "tx_id")
    assert column(tables.read_table(spark, path).filter("tx_id = 'a'"), "v") == [1]
    tables.upsert_table(path, rows(("b", 8, None), ("b", 3, None), ("c", 4, None), (None, 6, None)), "tx_id")
    assert sorted(tables.read_table(spark, path).collect(), key=lambda r: r.tx_id or "") == [(None, 6, None), ("a", 1, {"x": 1}), ("b", 3, None), ("c", 4, None)]
    files = tmp_path / "in"
    for name, v in (("1.json", 7), ("0.json", 8)):
        files.mkdir(exist_ok=True)
        (files / name).write_text("".join(f'{{"tx_id": "z", "v": {x}}}\n' for x in (v * 10, v)))
    new = spark.read.schema("tx_id string, v int").json(str(files))
    assert column(tables.upsert(new.limit(0), new, "tx_id", tables.file_position()), "v") == [7]


def test_annotate_writes_back(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.createDataFrame([("a", "x"), ("b", "y")], "tx_id string, label string"), path)
    assert tables.annotate_table(path, spark.createDataFrame([("a", "marked", 5), ("n", "none", 6)], "tx_id string, label string, score int")) == 2
    assert column(tables.read_table(spark, path).fillna(0), "tx_id", "label", "score") == [("a", "marked", 5), ("b", "y", 0)]
