import gzip
import json

import pytest

from voltframe.sources import files
from voltframe.streaming import prices


def test_csv_and_text(spark, tmp_path):
    p = tmp_path / "plants.csv"
    p.write_text("name,lat,lon,naics,oper,summer,winter,units,lines\nA,44.5,-71,X,10,9,oops,2,\n")
    r = files.power_plants(spark, str(p)).first()
    assert (r["name"], r.lat, r.oper, r.winter, r.units, r.lines) == ("A", 44.5, 10.0, 0.0, 2, 0)
    (tmp_path / "w.txt").write_text('"LD.A  115","1.5"\n"LD.B","2"\n')
    assert [(x.name, x.mw) for x in files.weights(spark, str(tmp_path / "w.txt")).collect()] == [("LD.A  115", 1.5), ("LD.B", 2.0)]
    (tmp_path / "n.txt").write_text('\n"LD.A  1"\n"LD.B"\n')
    assert [x.name for x in files.names(spark, str(tmp_path / "n.txt")).collect()] == ["LD.A  1", "LD.B"]
    (tmp_path / "a.txt").write_text("x\ny\n")
    (tmp_path / "b.txt").write_text("1\n2\n")
    assert sorted(tuple(x) for x in files.zipped(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt")).collect()) == [(0, "x", "1"), (1, "y", "2")]


def test_record_typed(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text('"C","note"\n"H","Zone Id","Name"\n"D","4001","Maine"\n"D","4002","NH"\n"T","2 lines"\n')
    rows, check = files.record_typed(spark, str(p))
    assert [(r.zone_id, r.name) for r in rows.orderBy("zone_id").collect()] == [("4001", "Maine"), ("4002", "NH")]
    assert tuple(check.first()) == (2, 2)


def test_json_and_geojson(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([["N1", 40.0, -70.0], ["N2", "41", -71]]))
    assert [tuple(r) for r in files.json_rows(spark, str(tmp_path / "a.json")).collect()] == [("N1", 40.0, -70.0), ("N2", 41.0, -71.0)]
    (tmp_path / "m.json").write_text(json.dumps({"proj": "x", "f": [{"g": {"c": [1, 2]}, "p": ["A", "t", "r"]}]}))
    assert [tuple(r) for r in files.json_features(spark, str(tmp_path / "m.json")).collect()] == [("A", 1.0, 2.0)]
    g = {"features": [{"geometry": {"coordinates": [[0, 0], [1, 1]]}, "properties": {"VOLTAGE": 115}}, {"geometry": {"coordinates": [[1, 1], [2, 5]]}, "properties": {"VOLTAGE": 230}}]}
    (tmp_path / "g.json").write_text(json.dumps(g))
    got = sorted(tuple(r) for r in files.geojson_lines(spark, str(tmp_path / "g.json")).collect())
    assert got == [(0, 0, 0.0, 0.0, 115.0, 0), (0, 1, 1.0, 1.0, 115.0, 1), (1, 0, 1.0, 1.0, 230.0, 1), (1, 1, 2.0, 5.0, 230.0, 2)]
    assert files.geojson_lines(spark, str(tmp_path / "g.json"), (2.0, 0.5, 2.0, 0.5)).count() == 2


def test_xml_and_kml(spark, tmp_path):
    (tmp_path / "m.xml").write_text("<map><m><n>B</n><a>X</a><p>L</p><decimal>40.5</decimal><decimal>-120.1</decimal></m><m><n>A</n><a>X</a><p>L</p><decimal>10</decimal><decimal>-120</decimal></m></map>")
    assert [(r.node, r.lat, r.lon) for r in files.xml_places(spark, str(tmp_path / "m.xml")).collect()] == [("B", 40.5, -120.1)]
    (tmp_path / "k.kml").write_text("<kml><Placemark><name> hub one </name><description>Zone: west</description><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 2,0 2,2 0,2 0,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></kml>")
    r = files.kml_places(spark, str(tmp_path / "k.kml")).first()
    assert (r["name"], r.lon, r.lat, r.zone) == ("HUB ONE", 1.0, 1.0, "WEST")


def test_writers_and_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    assert files.create_if_missing(spark, path, files.POINTS).count() == 0
    one = spark.createDataFrame([(1, 2.0, 3.0)], files.POINTS)
    files.append(one, path)
    assert files.create_if_missing(spark, path, files.POINTS).count() == 1
    assert files.snapshot(one.limit(0), path).count() == 1
    p = spark.sql("SELECT 7L AS node, timestamp'2024-01-01 00:00:00' AS ts, 1.5D AS lmp")
    files.write_nodes(p, str(tmp_path / "n"))
    found = list((tmp_path / "n" / "node=7" / "year=2024").glob("*.csv.gz"))
    assert len(found) == 1 and "1.5" in gzip.open(found[0], "rt").read()


def test_projection_of_a_known_place(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(files.transverse_mercator(F.lit(500000.0), F.lit(4649776.22), -87.0, 500000.0, 0.9996, files.WGS84).alias("p")).first().p
    assert r.lat == pytest.approx(42.0, abs=1e-4) and r.lon == pytest.approx(-87.0)


def test_stream_of_prices(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (1L, timestamp'2024-01-01 00:01:00', 2D), (1L, timestamp'2024-01-01 00:04:00', 4D), (1L, timestamp'2024-01-01 09:00:00', 8D) AS t(node, ts, lmp)")
    rows.write.parquet(str(tmp_path / "in"))
    q = prices.binned_prices(prices.read_prices(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("bins").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.sql("SELECT node, points, mean FROM bins").collect()
    assert (1, 2, 3.0) in [tuple(r) for r in got]


def test_workbooks(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>2.5</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>in</t></is></c></row><row r="4"><c r="A4"><v>9</v></c></row>'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>head</t></si><si><r><t>no</t></r><r><t>de</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
    got = files.xlsx_rows(spark, str(tmp_path / "*.xlsx"), skip=1, foot=1).orderBy("row").collect()
    assert [tuple(r) for r in got] == [("w.xlsx", 2, ["node", None, "2.5"]), ("w.xlsx", 3, [None, "in"])]


def test_copies_leave_out_what_is_there(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    moves = spark.createDataFrame([(str(tmp_path / "a"), str(tmp_path / "d" / "b"))], "path string, target string")
    assert files.copied(spark, moves) == 1 and files.copied(spark, moves) == 0 and (tmp_path / "d" / "b").read_text() == "x"
