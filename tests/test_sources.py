"""File shapes, stored versions, feature alignment, streaming replays."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.score import align_features, in_holdout
from ledgerlens.sources import readers, tables
from ledgerlens.streaming import daily


def write(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_shapes(spark, tmp_path):
    records = [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]
    shapes = {
        "array.json": json.dumps(records), "lines.json": "\n".join(map(json.dumps, records)),
        "wrapped.json": json.dumps({"source": "s", "data": records}),
    }
    for name, text in shapes.items():
        df = readers.read_json(spark, write(tmp_path, name, text), lines=True if name.startswith("lines") else None)
        assert sorted((r["a"], r["b"]) for r in df.collect()) == [(1, "x"), (2, "y")], name
    assert readers.read_json(spark, write(tmp_path, "one.json", json.dumps({"a": 7, "b": "z"}))).first()["a"] == 7


def test_csv_names_and_encoding(spark, tmp_path):
    path = tmp_path / "latin.csv"
    path.write_bytes(" Order Id ,Näme\n1,é\n".encode("latin-1"))
    df = readers.load(spark, str(path), "csv", encoding="ISO-8859-1")
    assert df.columns == ["order_id", "näme"] and df.first()["näme"] == "é"
    with pytest.raises(ValueError):
        readers.load(spark, "x.xyz", "xyz")


def test_versions(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        tables.load_dataset(spark, root, "s", "d")
    tables.save_dataset(spark.range(5), root, "s", "d")
    tables.save_dataset(tables.load_dataset(spark, root, "s", "d").where("id > 1"), root, "s", "d")
    assert tables.load_dataset(spark, root, "s", "d").count() == 3
    (tmp_path / "s" / "d" / "v9").mkdir()  # a write that never finished
    assert tables.versions(spark, f"{root}/s/d") == [1, 2]
    assert tables.delete_dataset(spark, root, "s", "d") and tables.versions(spark, f"{root}/s/d") == []


def test_upsert_newest_wins(spark):
    schema = "dataset_id string, n int, updated_at int"
    old = spark.createDataFrame([("a", 1, 5), ("b", 1, 5)], schema)
    new = spark.createDataFrame([("a", 2, 5), ("b", 2, 4), ("c", 2, 1)], schema)
    assert {r["dataset_id"]: r["n"] for r in tables.upsert_records(old, new).collect()} == {"a": 2, "b": 1, "c": 2}


def test_feature_errors(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0)], "colA double, colC double, target int")
    assert align_features(df, ["colC", "colA"]) == ["colC", "colA"]
    assert align_features(df, ["f1", "f2"], target="target") == ["colA", "colC"]
    with pytest.raises(ValueError, match="Missing features: colB"):
        align_features(df.drop("colC").withColumn("x", F.lit(1.0)).withColumn("z", F.lit(1.0)), ["colA", "colB"])
    with pytest.raises(ValueError, match="Feature mismatch"):
        align_features(df, count=3, target="target")


def test_holdout_is_stable(spark):
    held = spark.range(5000).where(in_holdout(F.col("id"))).count()
    assert 850 < held < 1150 and held == spark.range(5000).repartition(7).where(in_holdout(F.col("id"))).count()


def test_stream_catches_up_and_takes_late_rows(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    folder, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")

    def arrive(rows):
        spark.createDataFrame(rows, "event_id bigint, t string, user_id bigint, event_type string, value double").select(
            "event_id", F.col("t").cast("timestamp").alias("ts"), "user_id", "event_type", "value").coalesce(1).write.mode("append").parquet(folder)
        events = daily.event_stream(spark, folder, spark.createDataFrame([], schema).schema)
        daily.run_available(daily.daily_events(events), out, mark)
        return {(str(r["metric_date"]), r["event_type"]): (r["event_count"], r["total_value"]) for r in daily.current_metrics(spark, out).collect()}

    assert arrive([(1, "2024-01-02 10:00:00", 1, "buy", 5.0), (2, "2024-01-02 11:00:00", 2, "buy", 7.0)]) == {("2024-01-02", "buy"): (2, 12.0)}
    seen = arrive([(3, "2024-01-03 09:00:00", 1, "view", 1.0), (4, "2024-01-02 12:00:00", 3, "buy", 1.0)])
    assert seen == {("2024-01-02", "buy"): (3, 13.0), ("2024-01-03", "view"): (1, 1.0)}


def test_csv_in_another_encoding(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("name,n\nCafé,1\nÉté,2\n".encode("latin-1"))
    (tmp_path / "utf.csv").write_bytes("name,n\nCafé,1\n".encode())
    assert {r["name"] for r in readers.read_csv(spark, str(tmp_path / "latin.csv")).collect()} == {"Café", "Été"}
    assert readers.read_csv(spark, str(tmp_path / "utf.csv")).first()["name"] == "Café"


def test_a_broken_version_is_stepped_over(spark, tmp_path):
    root = str(tmp_path / "sets")
    first = tables.save_dataset(spark.range(3), root, "s", "d")
    (tmp_path / "sets" / "s" / "d" / "v2").mkdir()
    assert tables.load_dataset(spark, root, "s", "d").count() == 3
    assert first.endswith("v1") and tables.save_dataset(spark.range(5), root, "s", "d").endswith("v3")
    assert tables.load_dataset(spark, root, "s", "d").count() == 5
    assert sorted(p.name for p in (tmp_path / "sets" / "s" / "d").iterdir()) == ["v1", "v2", "v3"]
