"""Readers and writers: files are written, read back and compared."""

from __future__ import annotations

import datetime as dt
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustframe import config, schemas
from gustframe.functions.text import chart_object, path_order
from gustframe.operators.relational import drop_matching, upsert
from gustframe.operators.sampling import sort_known
from gustframe.plans import ingest
from gustframe.sources import files, sinks


def _field(values):
    """One registry line from texts at their places."""
    line = [" "] * 143
    for name, text in values.items():
        start, size = files.REGISTRY_FIELDS[name]
        line[start - 1 : start - 1 + size] = f"{text:<{size}}"[:size]
    return "".join(line).rstrip()


def test_registry_of_fixed_width(spark, tmp_path):
    folder = tmp_path / "wind"
    folder.mkdir()
    rows = [
        {"id": "00044", "von": "20070401", "bis": "20240501", "height": "44", "latitude": "52.9336", "longitude": "8.2370", "name": "Großenkneten", "state": "Niedersachsen"},
        {"id": "123", "von": "19500101", "bis": "20111231", "height": "1.5", "latitude": "47.8", "longitude": "10.1", "name": "Ähren", "state": "Bayern"},
    ]
    text = "Stations_id von_datum bis_datum\n----------- --------- ---------\n" + "\n".join(map(_field, rows)) + "\n"
    (folder / "list.txt").write_bytes(text.encode("latin-1"))
    got = files.registry(spark, str(folder)).orderBy("station_id").collect()
    assert [(r["station_id"], r["name"], r["state"], r["height"], r["latitude"], r["longitude"], r["variable"]) for r in got] == [
        ("00044", "Großenkneten", "Niedersachsen", 44.0, 52.9336, 8.237, "wind"),
        ("00123", "Ähren", "Bayern", 1.5, 47.8, 10.1, "wind"),
    ]
    assert (got[0]["valid_from"], got[1]["valid_to"]) == (dt.date(2007, 4, 1), dt.date(2011, 12, 31))
    assert [f.name for f in files.registry(spark, str(folder)).schema] == schemas.REGISTRY.names
    master = ingest.master_data(files.registry(spark, str(folder)), spark.createDataFrame([("00044", 1.0, 2.0, 3.0), ("99999", 4.0, 5.0, 6.0)], schemas.MASTER)).orderBy("station_id").collect()
    assert [tuple(r) for r in master] == [("00044", 44.0, 52.9336, 8.237), ("00123", 1.5, 47.8, 10.1), ("99999", 4.0, 5.0, 6.0)]


def test_measurements(spark, tmp_path):
    (tmp_path / "produkt_x_20240101_20240102_00044.txt").write_text("STATIONS_ID;MESS_DATUM;  QN;FF_10;DD_10;eor\n         44;202401010010;    3;   4.5; 270;eor\n         44;202401010020;    3;  -999;-999;eor\n")
    got = files.measurements(spark, str(tmp_path), ["STATIONS_ID", "MESS_DATUM", "  QN", "FF_10", "DD_10", "eor"]).orderBy("timestamp").collect()
    assert [tuple(r) for r in got] == [("00044", dt.datetime(2024, 1, 1, 0, 10), 4.5, 270.0), ("00044", dt.datetime(2024, 1, 1, 0, 20), None, None)]


def test_station_series_by_file_name_and_cleaning(spark, tmp_path):
    for station, speeds in (("00044", ("1.5", "2.5")), ("77", ("", "3.5"))):
        (tmp_path / f"Station_{station}.csv").write_text("timestamp,wind_speed\n" + "".join(f"2024-01-0{i + 1} 00:00:00,{v}\n" for i, v in enumerate(speeds)))
    schema = schemas._struct("timestamp timestamp, wind_speed double")
    df = files.station_series(spark, str(tmp_path), schema)
    assert sorted(map(tuple, df.select("station_id", "wind_speed").collect()), key=str) == sorted([("00044", 1.5), ("00044", 2.5), ("00077", None), ("00077", 3.5)], key=str)
    clean = ingest.clean(df, ["wind_speed"], 0.4, first="2024-01-02")
    assert sorted(r["station_id"] for r in clean.collect()) == ["00044", "00077"]
    assert {r["station_id"] for r in ingest.clean(df, ["wind_speed"], 0.4).collect()} == {"00044"}


def test_delimited_with_decimal_commas(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name;x\none;1,5\ntwo;n/a\nthree;2.25\n")
    got = files.delimited(spark, str(tmp_path / "a.csv"), schemas._struct("name string, x double"), sep=";", comma_decimals=True, with_path=True).collect()
    assert [(r["name"], r["x"]) for r in got] == [("one", 1.5), ("two", None), ("three", 2.25)] and got[0]["path"].endswith("a.csv")


def test_curves_of_a_wide_catalogue(spark, tmp_path):
    (tmp_path / "c.csv").write_text("wind_speed;A;B\n3,0;10,5;\n3,5;20;7\n")
    got = sorted(map(tuple, files.curves(spark, str(tmp_path / "c.csv"), ["A", "B"]).collect()))
    assert got == [("A", 300, 10500.0), ("A", 350, 20000.0), ("B", 350, 7000.0)]


def test_xml_units(spark, tmp_path):
    (tmp_path / "u.xml").write_text('<?xml version="1.0" encoding="UTF-8"?><Units><Unit><Name>Nord</Name><Power>3.5</Power></Unit><Unit><Name>Süd</Name></Unit></Units>', encoding="utf-8")
    got = files.xml_units(spark, str(tmp_path / "u.xml"), "Unit", schemas._struct("Name string, Power double")).collect()
    assert [tuple(r) for r in got] == [("Nord", 3.5), ("Süd", None)]


def test_zip_members(spark, tmp_path):
    for name in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr(f"{name}.txt", f"first {name} ä\nsecond\n".encode("latin-1"))
    got = sorted((r["member"], r["line_no"], r["line"]) for r in files.zip_members(spark, str(tmp_path)).collect())
    assert got == [("a.txt", 0, "first a ä"), ("a.txt", 1, "second"), ("b.txt", 0, "first b ä"), ("b.txt", 1, "second")]


def test_ages_and_missing_files(spark, tmp_path):
    np.save(tmp_path / "ages.npy", np.array([1.5, 20.0]))
    assert [tuple(r) for r in files.ages(spark, str(tmp_path / "ages.npy")).orderBy("idx").collect()] == [(0, 1.5), (1, 20.0)]
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    assert [r["name"] for r in files.missing_files(names, names.filter("name = 'a'")).collect()] == ["b"]


def test_objects_in_pages(spark):
    page = "<script>var chart = {labels: ['1', '2'], title: 'a } b', data: {x: 1}}; var other = {};</script>"
    df = spark.createDataFrame([(page,), ("no chart",), (None,), ("chart = {open",)], "html string")
    got = [r["body"] for r in files.html_objects(df, "html", "chart").collect()]
    assert got == ["{labels: ['1', '2'], title: 'a } b', data: {x: 1}}", None, None, None]
    parsed = files.html_objects(df, "html", "chart").select(chart_object("body", "labels array<string>, title string").alias("o")).first()["o"]
    assert (parsed["labels"], parsed["title"]) == (["1", "2"], "a } b")


def test_writers_give_back_what_they_got(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.2), ("b", 1, None)], "station_id string, t int, v double")
    rows = sorted(map(str, df.collect()))
    for fmt in ("parquet", "csv"):
        out = str(tmp_path / fmt)
        sinks.by_station(df, out, fmt=fmt)
        assert sorted(p.name for p in (tmp_path / fmt).iterdir() if p.is_dir()) == ["station_id=a", "station_id=b"]
        back = spark.read.schema(df.schema).parquet(out) if fmt == "parquet" else spark.read.schema(df.schema).option("header", True).csv(out)
        assert sorted(map(str, back.select(*df.columns).collect())) == rows
    sinks.result_csv(df, str(tmp_path / "r"))
    assert sorted(map(str, spark.read.schema(df.schema).option("header", True).option("sep", ";").csv(str(tmp_path / "r")).collect())) == rows
    sinks.parameters(df, str(tmp_path / "p1"))
    old = spark.read.schema(df.schema).option("header", True).csv(str(tmp_path / "p1"))
    sinks.parameters(df.unionByName(spark.createDataFrame([("c", 3, 1.0)], df.schema)), str(tmp_path / "p2"), old)
    assert spark.read.option("header", True).csv(str(tmp_path / "p2")).count() == 4
    assert sinks.single_precision(df, ["v"]).orderBy("t", "station_id").first()["v"] == float(np.float32(0.1))


def test_tables_with_keys_and_conflict_policies(spark, tmp_path):
    spark.sql("drop table if exists measured")
    sinks.create_table(spark, "measured", {"timestamp": "int", "station_id": "string"}, ["v"])
    sinks.create_table(spark, "measured", {"timestamp": "int", "station_id": "string"}, ["v"])
    new = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0)], "timestamp int, station_id string, v float")
    sinks.merge_into(spark, "measured", new, ["timestamp", "station_id"], True, str(tmp_path / "s1"))
    more = spark.createDataFrame([(2, "a", 9.0), (3, "a", 3.0)], new.schema)
    sinks.merge_into(spark, "measured", more, ["timestamp", "station_id"], False, str(tmp_path / "s2"))
    assert sorted(map(tuple, spark.table("measured").collect())) == [(1, "a", 1.0), (2, "a", 2.0), (3, "a", 3.0)]
    sinks.merge_into(spark, "measured", more, ["timestamp", "station_id"], True, str(tmp_path / "s3"))
    assert sorted(map(tuple, spark.table("measured").collect())) == [(1, "a", 1.0), (2, "a", 9.0), (3, "a", 3.0)]
    assert upsert(new, more, ["timestamp", "station_id"], True).count() == 3
    spark.sql("drop table measured")


def test_stages_are_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sinks.resumed(spark, str(tmp_path / "stage"), make).count() == 3
    (tmp_path / "stage" / "_SUCCESS").unlink()  # a run that was cut off
    assert sinks.resumed(spark, str(tmp_path / "stage"), make).count() == 3
    assert len(made) == 2


def test_configuration(tmp_path):
    (tmp_path / "c.yaml").write_text("features:\n  wind: {old_name: FF_10, name: wind_speed, unit: m/s}\n  none: {name: other}\n")
    found = config.features(config.load(tmp_path / "c.yaml"))
    assert config.renames(found) == {"FF_10": "wind_speed"} and found["wind"].unit == "m/s"
    assert config.planes([[[30, 180], [10, 90]]]) == ((30.0, 180.0), (10.0, 90.0)) == config.planes([[30, 180], [10, 90]])
    assert config.WindParams(("A", "B"), (80.0, 100.0)).park() == [(1, "A", 80.0, None), (2, "B", 100.0, None)]
    with pytest.raises(ValueError):
        config.WindParams(("A",), (80.0, 100.0)).park()


def test_names_and_order(spark):
    df = spark.createDataFrame([("x_10.csv", 1), ("x_9.csv", 2), ("x.csv", 3)], "path string, Beschreibung_a int")
    assert [r["path"] for r in df.orderBy(path_order("path")).collect()] == ["x_9.csv", "x_10.csv", "x.csv"]
    assert drop_matching(df, "Beschreibung").columns == ["path"]
    assert [r["path"] for r in sort_known(df, "absent", "path").collect()] == ["x.csv", "x_10.csv", "x_9.csv"]
    assert df.filter(F.contains("path", F.lit("_9"))).count() == 1
