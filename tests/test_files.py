import pytest
from pyspark.sql import functions as F

from kinmatch.operators import records
from kinmatch.sources import files
from kinmatch.streaming import shards


def test_entities_keep_blanks_and_check_prefix(spark, tmp_path):
    p = tmp_path / "s1.tsv"
    p.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tAcme\t\tUS\n")
    r = files.read_entities(spark, str(p), "S1").first()
    assert r.business_address == ""
    with pytest.raises(ValueError):
        files.read_entities(spark, str(p), "S2")


def test_id_files(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("b\n\na\n")
    ids = files.read_ids(spark, str(tmp_path / "ids.txt"))
    files.write_ids(ids, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a", "b"]
    (tmp_path / "twice.txt").write_text("a\na\n")
    with pytest.raises(ValueError):
        files.read_ids(spark, str(tmp_path / "twice.txt"))


def test_lists_round_trip(spark, tmp_path):
    universe = spark.createDataFrame([("S1-a",), ("S1-b",)], "s1 string")
    links = spark.createDataFrame([("S1-a", "S3-2"), ("S1-a", "S2-9")], "s1 string, target string")
    files.write_lists(links, universe, str(tmp_path / "pred"))
    u, back = files.read_links(spark, str(tmp_path / "pred"))
    assert sorted(r.s1 for r in u.collect()) == ["S1-a", "S1-b"] and back.exceptAll(links).isEmpty() and links.exceptAll(back).isEmpty()


def test_upsert_and_experiment_log(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sorted(files.upsert(old, spark.createDataFrame([("b", 3)], "k string, v int"), "k").collect()) == [("a", 1), ("b", 3)]
    log = spark.createDataFrame([("x", 1.0)], "experiment_name string, f double")
    with pytest.raises(ValueError):
        files.append_experiment(log, log)


def test_selected_must_be_complete(spark):
    df = spark.createDataFrame([("S1-1", "", "", "")], records.ENTITY)
    assert files.selected(df, spark.createDataFrame([("S1-1",)], "s1 string")).count() == 1
    with pytest.raises(ValueError):
        files.selected(df, spark.createDataFrame([("S1-2",)], "s1 string"))


def test_shards_resume(spark, tmp_path):
    schema = "s1 string, target string, source string, x double"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: shards.score_shards(spark, str(tmp_path / "in"), schema, lambda df: df.select("s1", "target", "source", F.col("x").alias("score")), str(tmp_path / "out"), str(tmp_path / "cp"))
    write([("a", "S2-1", "S2", 0.95)])
    run()
    write([("b", "S2-1", "S2", 0.99)])
    run()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert [(r.s1, r.target) for r in shards.settle(spark, str(tmp_path / "out")).collect()] == [("b", "S2-1")]
