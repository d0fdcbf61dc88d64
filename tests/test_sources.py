import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loamgrid.plans import workflow as W
from loamgrid.sources import layers as Y
from loamgrid.sources import tables as X
from loamgrid.sources.layers import field_names, field_type
from loamgrid.sources.tables import EditSession, VersionedTable, checksums, read_table, station_feed, table_list, write_csv


def test_text_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id;;id\n1;x;2\n3;y;4\n", encoding="utf-8")
    df = X.read_table(spark, str(tmp_path / "a.csv"))
    assert df.count() == 2 and len(set(df.columns)) == 3
    with pytest.raises(ValueError, match="nothing"):
        X.read_table(spark, str(tmp_path / "a.csv"), ["nothing"])
    (tmp_path / "e.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        X.import_table(spark, str(tmp_path / "e.csv"), str(tmp_path / "e.parquet"))
    assert X.header_names(["a", "", "a", None, "a"]) == ["a", "column_2", "a_2", "column_4", "a_2_2"]
    assert [X.sniff_delimiter(h) for h in ("a,b", "a\tb", "a;b;c,d", "a|b")] == [",", "\t", ";", "|"]


def test_versions(spark, tmp_path):
    t = X.VersionedTable(spark, str(tmp_path / "t"), keep=2)
    for n in (1, 2, 3):
        t.write(spark.range(n))
    assert t.versions() == [2, 3] and t.read().count() == 3 and t.read(2).count() == 2
    assert t.undo().count() == 2
    assert t.derive("id >= 1", str(tmp_path / "d")).read().count() == 1
    with pytest.raises(ValueError):
        t.undo()


LAYER = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "a", "n": 2}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]], [[1, 0.2], [1.5, 0.4], [1.5, 0.2], [1, 0.2]]]}}, {"type": "Feature", "properties": {"name": "é", "n": None}, "geometry": {"type": "Polygon", "coordinates": [[[5, 5], [6, 5], [6, 6], [5, 5]]]}}]}


def test_layers_round_trip(spark, tmp_path):
    (tmp_path / "l.geojson").write_text(json.dumps(LAYER))
    first = Y.read_layer(spark, str(tmp_path / "l.geojson")).orderBy("fid").collect()
    assert [(r.properties["name"], r.kind, len(r.shape)) for r in first] == [("a", "polygon", 1), ("é", "polygon", 1)]
    rows = [{"properties": dict(r.properties), "kind": r.kind, "shape": [[[list(p) for p in ring] for ring in part] for part in r.shape]} for r in first]
    Y.write_shapefile(rows, str(tmp_path / "l.zip"))
    Y.write_kml(rows, str(tmp_path / "l.kml"))
    for name in ("l.zip", "l.kml"):
        back = Y.read_layer(spark, str(tmp_path / name)).orderBy("fid").collect()
        assert [(r.properties["name"], r.kind, [len(p) for p in r.shape]) for r in back] == [("a", "polygon", [2]), ("é", "polygon", [1])]
        assert sorted(map(tuple, back[0].shape[0][0])) == sorted(map(tuple, rows[0]["shape"][0][0]))
    Y.write_geojson(Y.read_layer(spark, str(tmp_path / "l.geojson")).select("fid", "shape"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).select(F.col("geometry.type")).distinct().collect()[0][0] == "MultiPolygon"
    bad = spark.createDataFrame([("no",), (None,), ('{"type": "Point", "coordinates": [1, 2]}',)], "g string")
    assert [(r.kind, r.shape) for r in Y.parse_geojson(bad, "g").collect()] == [(None, None), (None, None), ("point", [[[[1.0, 2.0]]]])]
    assert Y.field_names(["a long field name", "a long field other", "A", "a"]) == ["a_long_fie", "a_long_fi2", "A", "a2"]


def test_workflow_and_log(spark, tmp_path):
    steps = [{"name": "big", "use": "keep", "with": {"df": "$in.table", "least": 3}}, {"name": "n", "use": "count", "with": {"df": "$step.big"}}]
    registry = {"keep": lambda df, least: df.where(F.col("id") >= least), "count": lambda df: df.agg(F.count("*").alias("n"))}
    assert W.Workflow(steps, registry).run({"table": spark.range(10)})["n"].first().n == 7
    for bad in ([steps[1]], [{"name": "x", "use": "drop"}], [{"name": "x", "use": "keep", "with": {"df": "$in.other"}}]):
        with pytest.raises(ValueError):
            W.Workflow(bad, registry).run({"table": spark.range(1)})
    t = datetime(2026, 1, 1)
    for status, hour in (("running", 1), ("done", 2)):
        W.log_run(spark, str(tmp_path / "log"), "r1", status, {"password": "x", "polygon": {"type": "Polygon", "coordinates": [[[0, 0], [1, 2]]]}, "list": list(range(40))}, t, t.replace(hour=hour))
    last = W.latest_runs(spark.read.json(str(tmp_path / "log"))).collect()
    assert [r.status for r in last] == ["done"] and "***" in last[0].request and '"bbox": [0, 0, 1, 2]' in last[0].request and "10 more" in last[0].request
    assert W.next_run({"at": "06:30"}, datetime(2026, 1, 1, 7)) == datetime(2026, 1, 2, 6, 30)
    assert W.next_run({"at": "06:30", "weekday": 0}, datetime(2026, 1, 1, 7)) == datetime(2026, 1, 5, 6, 30)
    assert W.next_run({"every_hours": 6}, datetime(2026, 1, 1, 7)) == datetime(2026, 1, 1, 12)
    assert W.due({"every_hours": 6}, datetime(2026, 1, 1), datetime(2026, 1, 3)) and not W.exceeds(None, ">", 1)


FEED = """<AqIndex><Country id="India"><State id="Karnataka"><City id="Bengaluru"><Station id="BTM, Bengaluru - CPCB" lastupdate="24-11-2026 10:00:00" latitude="12.91" longitude="77.6">
<Pollutant_Index id="PM2.5" min="10" max="80" avg="45"/><Pollutant_Index id="CO" min="NA" max="NA" avg="NA"/></Station></City></State>
<State id="Tamil_Nadu"><City id="Chennai"><Station id="Alandur" lastupdate="24-11-2026 10:00:00" latitude="NA" longitude="80.2"/></City></State></Country></AqIndex>"""


def test_station_feed_keeps_city_and_state(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(FEED)
    rows = station_feed(spark, str(tmp_path / "feed.xml")).orderBy("station", "pollutant").collect()
    assert [(r.state, r.city, r.pollutant, r.mean, r.lat) for r in rows] == [("Tamil_Nadu", "Chennai", None, None, None), ("Karnataka", "Bengaluru", "CO", None, 12.91), ("Karnataka", "Bengaluru", "PM2.5", 45.0, 12.91)]
    assert station_feed(spark, str(tmp_path / "feed.xml"), city="bangalore", aliases={"bangalore": "Bengaluru"}).count() == 2
    assert station_feed(spark, str(tmp_path / "feed.xml"), state="tamil nadu").count() == 1


def test_edit_sessions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.write(spark.range(5).withColumn("v", F.lit(1)))
    e = EditSession(t)
    e.edit("two rows less", lambda df: df.where("id < 3"))
    e.discard()
    assert e.df.count() == 5 and e.log == []
    e.edit("two rows less", lambda df: df.where("id < 3"))
    assert e.save() == 2 and t.read().count() == 3
    e.edit("doubled", lambda df: df.withColumn("v", F.col("v") * 2))
    other = e.save_as(str(tmp_path / "u"))
    assert other.read().first().v == 2 and t.read().first().v == 1
    t.write(spark.range(1).withColumn("v", F.lit(1)))
    e.edit("late", lambda df: df)
    with pytest.raises(ValueError):
        e.save()


def test_lists_checksums_and_text(spark, tmp_path):
    import hashlib

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"abc")
    assert checksums(spark, str(tmp_path / "in")).first().sha256 == hashlib.sha256(b"abc").hexdigest()
    assert [(r.path.endswith("a.bin"), r.bytes) for r in table_list(spark, str(tmp_path / "in")).collect()] == [(True, 3)]
    write_csv(spark.createDataFrame([(1, 1 / 3)], "a int, b double"), str(tmp_path / "out"))
    assert [(r.a, r.b) for r in read_table(spark, str(tmp_path / "out")).collect()] == [(1, 0.3333333)]


def test_alerts_and_scripts(spark, tmp_path):
    from loamgrid.plans.workflow import run_script
    from loamgrid.streaming.pipelines import alerts, run_available, stream_parquet

    src = str(tmp_path / "src")
    df = spark.range(10)
    df.write.parquet(src)
    seen = []
    q = alerts(stream_parquet(spark, src, df, files=100), "id > 7", lambda rows, n: seen.extend(r.id for r in rows.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(seen) == [8, 9]
    # A second run takes only what is new.
    out, check = str(tmp_path / "o"), str(tmp_path / "k")
    assert run_available(stream_parquet(spark, src, df, files=100), out, check).count() == 10
    spark.range(10, 12).write.mode("append").parquet(src)
    assert run_available(stream_parquet(spark, src, df, files=100), out, check).count() == 12
    assert sorted(r.id for r in run_script(df, lambda p: p[p["id"] % 2 == 0]).collect()) == [0, 2, 4, 6, 8]


def test_dbase_fields():
    assert field_names(["Population", "population 2020", "Population density", "naïve", "", "Population"]) == ["Population", "populatio2", "Populatio3", "na_ve", "field", "Populatio4"]
    assert field_type([True, None]) == ("L", 1, 0) and field_type([1, None]) == ("N", 18, 0) and field_type([1, 2.5]) == ("F", 24, 10)
    assert field_type(["é", "abc"]) == ("C", 3, 0) and field_type([None]) == ("C", 1, 0) and field_type(["x" * 900]) == ("C", 254, 0)


def test_shared_folder_and_clean(spark):
    from loamgrid.storage import Staged, broadcast_upto, clean, shared_dir

    s = Staged(spark.range(4))
    assert s.path.startswith(shared_dir(spark)) and s.rows == 4 and s.bytes > 0 and broadcast_upto(s, 3) is s.df
    clean(spark)
    with pytest.raises(Exception):
        s.df.collect()
    assert Staged(spark.range(2)).rows == 2
