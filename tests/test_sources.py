"""Scans, catalogs and sinks over small folders."""

import pytest
from pyspark.sql import functions as F

from vicinity.functions import names, schedules
from vicinity.sources import readers


def test_catalog_of_a_folder(spark, tmp_path):
    for split, files in {"bounding_box_train": ["0005_c1s1_000001_01.jpg", "0002_c6s1_000002_01.jpg", "-1_c2s1_000003_01.jpg", "notes.txt"], "query": ["0002_c3s1_000004_01.jpg"], "bounding_box_test": ["0000_c1s1_000005_01.jpg"]}.items():
        (tmp_path / split).mkdir()
        for f in files:
            (tmp_path / split / f).write_bytes(b"x")
    got = readers.create(spark, "market1501", str(tmp_path))
    assert sorted((r.name, r.pid, r.cam) for r in got["train"].collect()) == [("0002_c6s1_000002_01.jpg", 0, 5), ("0005_c1s1_000001_01.jpg", 1, 0)]
    assert [(r.pid, r.cam) for r in got["query"].collect()] == [(2, 2)]
    with pytest.raises(KeyError):
        readers.create(spark, "unknown", str(tmp_path))
    assert "market1501" in readers.collection_names()


def test_ids_out_of_bounds_are_an_error(spark):
    files = spark.createDataFrame([("9999_c1s1_000001_01.jpg",)], "name string")
    with pytest.raises(Exception, match="out of bounds"):
        readers.catalog(files, readers.COLLECTIONS["market1501"]).collect()


def test_text_sources(spark, tmp_path):
    (tmp_path / "index.txt").write_text("a/b.bmp 3\n\nc/d.bmp 14\n")
    assert [(r.path, r.label) for r in readers.index_file(spark, str(tmp_path / "index.txt")).collect()] == [("a/b.bmp", 3), ("c/d.bmp", 14)]
    ids = readers.parse_id_list(spark.createDataFrame([("7, 12,,3",)], "value string"))
    assert sorted((r.id, r.name) for r in ids.collect()) == [(3, "0003"), (7, "0007"), (12, "0012")]


def test_json_and_feature_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "query", [1.0, 2.0]), (2, "gallery", [3.0, 4.0])], "idx long, split string, v array<double>")
    readers.write_features(df, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).where("split = 'query'").count() == 1
    readers.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_name_parsers(spark):
    df = spark.createDataFrame([("0589_c3s2_006893_03_623.jpg", "0002_c15_f0044158.jpg", "0041_c04_x.jpg")], "a string, b string, c string")
    row = df.select(*[x.alias(f"a{i}") for i, x in enumerate(names.augmented(F.col("a")))], *[x.alias(f"b{i}") for i, x in enumerate(names.underscore(F.col("b")))], *[x.alias(f"c{i}") for i, x in enumerate(names.split_fields(F.col("c")))]).first()
    assert tuple(row) == (589, 6, 3, 2, 15, 41, 4)


def test_schedules(spark):
    rows = spark.range(12).select(schedules.multi_step(F.col("id"), 1.0, [10], warmup=4).alias("m"), schedules.cosine(F.col("id"), 1.0, 10).alias("c"), schedules.curriculum(F.col("id"), [(2, 3), (5, 2)]).alias("k")).collect()
    assert rows[0].m == pytest.approx(0.01) and rows[4].m == 1.0 and rows[10].m == pytest.approx(0.1)
    assert rows[0].c == 1.0 and rows[5].c == pytest.approx(0.5) and rows[11].c == 0.0
    assert [r.k for r in rows[:7]] == [2, 2, 2, 5, 5, 5, 5]
