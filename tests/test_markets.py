"""Price files of each operator, node files by year, and places of nodes, on small files of each layout."""

import datetime as dt
import gzip

import pytest

from voltframe.sources import markets


def got(df):
    return sorted((r.node, r.ts.strftime("%m-%d %H:%M"), r.lmp) for r in df.collect())


def test_isone_labels_by_position(spark, tmp_path):
    head = "C,x\n" * 4 + '"H","Date","Hour Ending","Id","Name","Type","LMP"\n' * 2
    for day, labels in (("20161106", ["01", "02", "02X", "03"]), ("20161107", ["01", "02"])):
        lines = "".join(f'"D","d","{h}","1","{n}","T",{10 * k + int(day[-1])}.5\n' for k, h in enumerate(labels) for n in ("A", "B"))
        (tmp_path / f"WW_DALMP_ISO_{day}.csv").write_text(head + lines + '"T","8 lines"\n')
    rows = got(markets.isone(spark, str(tmp_path / "*.csv")))
    assert [r for r in rows if r[0] == "A"] == [("A", "11-06 00:00", 6.5), ("A", "11-06 01:00", 16.5), ("A", "11-06 02:00", 26.5), ("A", "11-06 03:00", 36.5), ("A", "11-06 04:00", 7.5), ("A", "11-06 05:00", 17.5)]
    assert len(rows) == 12


def test_miso_and_pjm_wide_files(spark, tmp_path):
    (tmp_path / "20160101_da.csv").write_text("head\n" * 5 + "N1,Gen,LMP," + ",".join(str(h) for h in range(24)) + "\nN1,Gen,MCC," + ",".join(["9"] * 24) + "\n")
    rows = got(markets.miso(spark, str(tmp_path / "2016*.csv")))
    assert rows == [("N1", f"01-01 {h:02d}:00", float(h)) for h in range(24)]

    def line(node, hours):
        return ",".join(["x", str(node), *["y"] * 5, *(f"{h},0,0" for h in hours)]) + "\n"

    (tmp_path / "p20160312.csv").write_text("head\n" * 8 + line(1, range(24)))
    (tmp_path / "p20160313.csv").write_text("head\n" * 8 + line(1, [0, 1, "", *range(3, 24)]))
    (tmp_path / "p20161106.csv").write_text("head\n" * 8 + line(1, range(25)))
    rows = got(markets.pjm(spark, str(tmp_path / "p*.csv"), ["20160313"], ["20161106"]))
    assert len(rows) == 24 + 23 + 25 and rows[24] == ("1", "03-13 00:00", 0.0) and rows[26] == ("1", "03-13 02:00", 3.0)
    assert rows[47] == ("1", "03-13 23:00", 0.0) and rows[71] == ("1", "03-14 23:00", 24.0)


def test_nyiso_hour_that_comes_again(spark, tmp_path):
    times = ["00:00", "01:00", "01:00", "02:00"]
    (tmp_path / "20161106damlbmp.csv").write_text("Time,Name,PTID,LBMP\n" + "".join(f"11/06/2016 {t},N{n},{n},{k}\n" for n in (7, 8) for k, t in enumerate(times)))
    rows = got(markets.nyiso(spark, str(tmp_path / "*.csv")))
    assert rows == [(str(n), f"11-06 0{k}:00", float(k)) for n in (7, 8) for k in range(4)]


def test_caiso_and_ercot(spark, tmp_path):
    (tmp_path / "c.csv").write_text("NODE,TIME,LMP\nA,2016-07-01T08:00:00-00:00,3.5\n")
    assert got(markets.caiso(spark, str(tmp_path / "c.csv"))) == [("A", "07-01 01:00", 3.5)]
    (tmp_path / "e.csv").write_text("DeliveryDate,HourEnding,BusName,LMP,DSTFlag\n11/06/2016,01:00,B,1,N\n11/06/2016,02:00,B,2,N\n11/06/2016,02:00,B,3,Y\n11/06/2016,03:00,B,4,N\n")
    assert got(markets.ercot_day_ahead(spark, str(tmp_path / "e.csv"))) == [("B", f"11-06 0{h}:00", float(h + 1)) for h in range(4)]
    for name in ("cdr.1.20160701.LMPSELECTBUSNP6787_20160701_005025_csv.csv", "cdr.1.20161201.xhr.LMPSELECTBUSNP6787_20160701_085942_csv.csv"):
        (tmp_path / name).write_text("Time,Flag,Bus,LMP\n2016,N,B,5\n")
    rows = got(markets.ercot_real_time(spark, str(tmp_path / "cdr*.csv"), "2016-03-13", "2016-11-06"))
    assert rows == [("B", "06-30 23:50", 5.0), ("B", "07-01 08:55", 5.0)]


def test_months_become_years(spark, tmp_path):
    for month, value in (("201601", 1), ("201602", 2), ("201701", 3)):
        with gzip.open(tmp_path / f"N-1-{month}.gz", "wt") as f:
            f.write(f"{month[:4]}-{month[4:]}-01 00:00:00,{value}\n")
    out = markets.merged_years(spark, str(tmp_path / "*.gz"))
    assert sorted((r.node, r.year, r.lmp) for r in out.collect()) == [("N-1", 2016, 1.0), ("N-1", 2016, 2.0), ("N-1", 2017, 3.0)]
    markets.write_years(out, str(tmp_path / "years"))
    found = list((tmp_path / "years" / "node=N-1" / "year=2016").glob("*.gz"))
    assert len(found) == 1 and [x.split(",")[1] for x in gzip.open(found[0], "rt").read().split()] == ["1.0", "2.0"]


def test_places_of_nodes(spark, tmp_path):
    nodes = spark.createDataFrame([("A", 1.0, 2.0, "Gen", "X")], "node string, latitude double, longitude double, type string, region string")
    hubs = spark.createDataFrame([("ARK_XYZ", 3.0, 4.0)], "name string, lat double, lon double")
    assert sorted(map(tuple, markets.with_hubs(nodes, hubs).collect())) == [("A", 1.0, 2.0, "Gen", "X"), ("ARK.HUB", 3.0, 4.0, "Hub", "MISO")]
    towns = spark.createDataFrame([("Troy", "Rensselaer, NY", 36), ("nan", "Erie, PA", 42), (None, "Kent, NJ", 34)], "town string, county_state string, state int")
    assert [r.location for r in markets.town_or_county(towns).collect()] == ["Troy, NY", "Erie, PA", "Kent, NJ"]
    files = spark.createDataFrame([("/a/12_40.5_-74.25_2016.csv",), ("/a/13_40.5_-74.25_2017.csv",), ("/a/readme.txt",)], "path string")
    n = spark.createDataFrame([("N1", "PJM", "40.5", "-74.25"), ("N2", "PJM", "1", "2")], "name string, iso string, nsrdblat string, nsrdblon string")
    assert [tuple(r) for r in markets.weather_of_nodes(n, files, "2016", 30).collect()] == [("N1", "PJM", "/a/12_40.5_-74.25_2016.csv", "PJM/in/NSRDB/2016/30min/N1-2016.gz")]
    (tmp_path / "n.csv").write_text("n,lat,lon\nA,1,2\n")
    assert [tuple(r) for r in markets.places(spark, "ISONE", str(tmp_path / "n.csv")).collect()] == [("A", 1.0, 2.0)]
    with pytest.raises(ValueError):
        markets.places(spark, "XX", "")


def test_time_in_a_name(spark):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([("a_20160313_030000_csv",), ("a_20161106_020000_csv",)], "f string").select(markets.ercot_time(F.col("f"), "2016-03-13", "2016-11-06").alias("t")).collect()
    assert [x.t for x in r] == [dt.datetime(2016, 3, 13, 2), dt.datetime(2016, 11, 6, 2)]
