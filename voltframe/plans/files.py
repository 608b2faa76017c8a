"""Queries of readers and writers: each writes the files it reads, from the given tables, in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voltframe.functions.sessions import checkpoint_dir
from voltframe.plans.base import query, r9
from voltframe.sources import files, markets
from voltframe.sources import tables as T


def folder(s) -> str:
    return f"{checkpoint_dir(s).rstrip('/')}/files-{uuid.uuid4().hex}"


def said(*parts) -> F:
    return F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts)).alias("value")


def text(s, lines, name: str) -> str:
    """lines (value, place) as one file of that name in a folder of its own."""
    return files.write_text_file(lines, f"{folder(s)}/{name}")


def suppliers(s, d):
    return T.read(s, d, "supplier").withColumn("place", F.col("s_suppkey"))


def string(c: str):
    return F.col(c).cast("string")


@query("src_3_csv", "SELECT s_name AS name, s_suppkey::DOUBLE AS lat, -(s_suppkey::DOUBLE) AS lon, CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE s_acctbal END AS oper, 2.5::DOUBLE AS summer, 0.0::DOUBLE AS winter, s_nationkey AS units, 0 AS lines FROM supplier")
def _(s, d):
    p = suppliers(s, d)
    oper = F.when(F.col("s_suppkey") % 7 == 0, F.lit("NOT AVAILABLE")).otherwise(string("s_acctbal"))
    rows = p.select(said(F.col("s_name"), ",", string("s_suppkey"), ",-", string("s_suppkey"), ",X,", oper, ",2.5,oops,", string("s_nationkey"), ","), "place")
    head = s.createDataFrame([("name,lat,lon,naics,oper,summer,winter,units,lines", -1)], "value string, place long")
    got = files.power_plants(s, text(s, head.unionByName(rows), "plants.csv"))
    return got.select("name", "lat", "lon", "oper", "summer", "winter", "units", "lines")


@query("src_4_json_rows", "SELECT s_name AS name, s_suppkey / 2.0::DOUBLE AS lat, -s_suppkey / 4.0::DOUBLE AS lon FROM supplier")
def _(s, d):
    one = F.concat(F.lit('["'), F.col("s_name"), F.lit('", '), (F.col("s_suppkey") / 2.0).cast("string"), F.lit(', "'), (-F.col("s_suppkey") / 4.0).cast("string"), F.lit('"]'))
    doc = suppliers(s, d).agg(said("[", F.array_join(F.collect_list(one), ", "), "]"))
    return files.json_rows(s, text(s, doc, "nodes.json"))


@query("src_5_json_features", "SELECT s_name AS name, s_suppkey / 2.0::DOUBLE AS x, s_suppkey / 8.0::DOUBLE AS y FROM supplier")
def _(s, d):
    one = F.to_json(F.struct(F.struct(F.array(F.col("s_suppkey") / 2.0, F.col("s_suppkey") / 8.0).alias("c")).alias("g"), F.array("s_name", F.lit("Gen"), F.lit("R")).alias("p")))
    doc = suppliers(s, d).agg(said('{"proj": "x", "f": [', F.array_join(F.collect_list(one), ", "), "]}"))
    return files.json_features(s, text(s, doc, "miso.json"))


@query("src_7_geojson_lines", "SELECT l AS line, seq, x, y, 115.0::DOUBLE * (1 + l % 3) AS voltage, dense_rank() OVER (ORDER BY x, y) - 1 AS vertex FROM (SELECT dense_rank() OVER (ORDER BY line) - 1 AS l, seq, x, y FROM polylines)", "polylines")
def _(s, d):
    xy = F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda v: F.array(v["x"], v["y"]))
    lines = T.polylines(s, d).groupBy("line").agg(xy.alias("coordinates"))
    doc = lines.agg(F.sort_array(F.collect_list(F.struct("line", "coordinates"))).alias("all"))
    one = lambda v, i: F.struct(F.struct(v["coordinates"].alias("coordinates")).alias("geometry"), F.struct((F.lit(115.0) * (i % 3 + 1)).alias("VOLTAGE")).alias("properties"))
    return files.geojson_lines(s, text(s, doc.select(F.to_json(F.struct(F.transform("all", one).alias("features"))).alias("value")), "lines.geojson"))


@query("src_8_overpass_ways", "SELECT line AS way, seq, line * 1000 + seq AS node, round(x, 9) AS lat, round(y, 9) AS lon FROM polylines WHERE seq % 4 <> 3", "polylines")
def _(s, d):
    p = T.polylines(s, d).withColumn("node", F.col("line") * 1000 + F.col("seq"))
    nodes = p.where("seq % 4 <> 3").select(F.to_json(F.struct(F.lit("node").alias("type"), F.col("node").alias("id"), F.col("x").alias("lat"), F.col("y").alias("lon"))).alias("j"))
    ways = p.groupBy("line").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "node"))), lambda v: v["node"]).alias("nodes"))
    ways = ways.select(F.to_json(F.struct(F.lit("way").alias("type"), F.col("line").alias("id"), "nodes")).alias("j"))
    return files.overpass_ways(s, files.write_documents(nodes.unionAll(ways), folder(s))).select("way", "seq", "node", *r9("lat", "lon"))


@query("src_9_xml_places", "SELECT s_name AS node, 'A' || s_nationkey AS area, 'GEN' AS kind, s_suppkey / 2.0::DOUBLE AS lat, -1 - s_suppkey / 4.0::DOUBLE AS lon FROM supplier WHERE s_suppkey / 2.0 > 20 AND s_suppkey / 4.0 < 179")
def _(s, d):
    rows = suppliers(s, d).select(said("<m><n>", F.col("s_name"), "</n><a>A", string("s_nationkey"), "</a><p>GEN</p><decimal>", (F.col("s_suppkey") / 2.0).cast("string"), "</decimal><decimal>", (-1 - F.col("s_suppkey") / 4.0).cast("string"), "</decimal></m>"), "place")
    ends = s.createDataFrame([("<map>", -1), ("</map>", 1 << 60)], "value string, place long")
    return files.xml_places(s, text(s, rows.unionByName(ends), "map.xml"))


@query("src_10_kml_places", "SELECT upper(s_name) AS name, s_suppkey + 1.0::DOUBLE AS lon, s_nationkey + 0.5::DOUBLE AS lat, 'ZONE ' || chr(65 + s_nationkey) AS zone FROM supplier")
def _(s, d):
    x, y = F.col("s_suppkey"), F.col("s_nationkey")
    corner = lambda a, b: F.concat((x + a).cast("string"), F.lit(","), (y + b).cast("string"))
    ring = F.concat_ws(" ", corner(0, 0), corner(2, 0), corner(2, 1), corner(0, 1), corner(0, 0))
    zone = F.concat(F.lit("Zone: zone "), F.lower(F.char(y + 65)))
    rows = suppliers(s, d).select(said("<Placemark><name> ", F.lower("s_name"), " </name><description>", zone, "</description><Polygon><outerBoundaryIs><LinearRing><coordinates>", ring, "</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"), "place")
    ends = s.createDataFrame([("<kml>", -1), ("</kml>", 1 << 60)], "value string, place long")
    return files.kml_places(s, text(s, rows.unionByName(ends), "hubs.kml"))


@query("src_12_weights", "SELECT s_name AS name, s_acctbal AS mw FROM supplier")
def _(s, d):
    return files.weights(s, text(s, suppliers(s, d).select(said('"', F.col("s_name"), '","', string("s_acctbal"), '"'), "place"), "weights.txt"))


@query("src_12_names", "SELECT 'LD.' || s_name || '  115' AS name FROM supplier")
def _(s, d):
    blank = s.createDataFrame([("", -1)], "value string, place long")
    return files.names(s, text(s, suppliers(s, d).select(said('"LD.', F.col("s_name"), '  115"'), "place").unionByName(blank), "names.txt"))


@query("src_13_record_typed", "SELECT s_suppkey::VARCHAR AS zone_id, s_name AS zone_name, (SELECT count(*) FROM supplier) AS told, (SELECT count(*) FROM supplier) AS found FROM supplier")
def _(s, d):
    n = T.read(s, d, "supplier").agg(F.count("*").alias("n")).select(said('"T","', string("n"), ' lines"'), F.lit(1 << 60).alias("place"))
    head = s.createDataFrame([('"C","report"', -2), ('"H","Zone ID","Zone Name"', -1)], "value string, place long")
    rows = suppliers(s, d).select(said('"D","', string("s_suppkey"), '","', F.col("s_name"), '"'), "place")
    got, check = files.record_typed(s, text(s, head.unionByName(rows).unionByName(n), "stats.csv"))
    return got.select("zone_id", "zone_name").join(F.broadcast(check))


@query("src_14_zipped", "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS line, s_name AS left, s_acctbal::VARCHAR AS right FROM supplier")
def _(s, d):
    left = text(s, suppliers(s, d).select(F.col("s_name").alias("value"), "place"), "ns.txt")
    right = text(s, suppliers(s, d).select(string("s_acctbal").alias("value"), "place"), "mws.txt")
    return files.zipped(s, left, right).select(F.col("line").cast("long").alias("line"), "left", "right")


@query("src_15_price_files", "SELECT p_brand AS node, p_retailprice AS lmp, 'prices-' || (p_size % 2) || '.csv' AS file FROM part")
def _(s, d):
    where = folder(s)
    head = s.createDataFrame([("node,lmp", -1)], "value string, place long")
    for k in (0, 1):
        p = T.read(s, d, "part").where(f"p_size % 2 = {k}").select(said(F.col("p_brand"), ",", string("p_retailprice")), F.col("p_partkey").alias("place"))
        files.write_text_file(head.unionByName(p), f"{where}/prices-{k}.csv")
    return files.price_files(s, f"{where}/*.csv", "node string, lmp double")


SHOWN = "date_format(ts, 'yyyy-MM-dd HH:mm')"


def shown(prices):
    return prices.select("node", F.expr(SHOWN).alias("ts"), "lmp")


def hourly(s, d, labels: list[str]):
    """(node, k, label, lmp, place): suppliers with a price for each label of a day."""
    each = F.posexplode(F.array(*map(F.lit, labels))).alias("k", "label")
    rows = suppliers(s, d).select(F.col("s_name").alias("node"), "s_suppkey", each)
    return rows.select("node", "k", "label", (F.col("s_suppkey") + F.col("k") / 4.0).alias("lmp"), (F.col("s_suppkey") * 100 + F.col("k")).alias("place"))


def hours(day: str, n: int) -> str:
    return f"SELECT s_name AS node, strftime(TIMESTAMP '{day} 00:00:00' + INTERVAL (k) HOUR, '%Y-%m-%d %H:%M') AS ts, s_suppkey + k / 4.0::DOUBLE AS lmp FROM supplier, range({n}) AS r(k)"


@query("src_16_isone", hours("2016-11-06", 25))
def _(s, d):
    rows = hourly(s, d, ["01", "02", "02X", *(f"{h:02d}" for h in range(3, 25))])
    lines = rows.select(said('"D","x","', F.col("label"), '","1","', F.col("node"), '","T",', string("lmp")), "place")
    ends = s.createDataFrame([('"H","Date","Hour","Id","Name","Type","LMP"', -1), ('"T","n lines"', 1 << 60)], "value string, place long")
    return shown(markets.isone(s, text(s, lines.unionByName(ends), "WW_DALMP_20161106.csv")))


def wide(rows, before: str, after: str):
    """A line for each node: what stands before, the node, and its prices in order."""
    one = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "lmp"))), lambda v: v["lmp"].cast("string")), after + ",")
    return rows.groupBy("node").agg(one.alias("prices"), F.min("place").alias("place")).select(said(before.split("%")[0], F.col("node"), before.split("%")[1], F.col("prices"), after), "place")


@query("src_16_miso", hours("2016-01-05", 24))
def _(s, d):
    rows = hourly(s, d, [str(h) for h in range(24)])
    lines = wide(rows, "%,Gen,LMP,", "").unionByName(wide(rows, "%,Gen,MLC,", ""))
    return shown(markets.miso(s, text(s, lines.unionByName(s.createDataFrame([("head", -1)], "value string, place long")), "20160105_da_lmp.csv")))


@query("src_16_pjm", hours("2016-11-06", 25))
def _(s, d):
    lines = wide(hourly(s, d, [str(h) for h in range(25)]), "x,%,a,b,c,d,e,", ",0,0")
    return shown(markets.pjm(s, text(s, lines.unionByName(s.createDataFrame([("head", -1)], "value string, place long")), "20161106-da.csv"), ["20160313"], ["20161106"]))


@query("src_16_nyiso", hours("2016-11-06", 25))
def _(s, d):
    rows = hourly(s, d, ["00", "01", "01", *(f"{h:02d}" for h in range(2, 24))])
    lines = rows.select(said("11/06/2016 ", F.col("label"), ":00,zone,", F.col("node"), ",", string("lmp")), "place")
    return shown(markets.nyiso(s, text(s, lines, "20161106damlbmp_gen.csv")))


@query("src_16_caiso", hours("2016-07-01", 24))
def _(s, d):
    rows = hourly(s, d, [f"2016-07-0{1 + (h + 7) // 24}T{(h + 7) % 24:02d}:00:00-00:00" for h in range(24)])
    return shown(markets.caiso(s, text(s, rows.select(said(F.col("node"), ",", F.col("label"), ",", string("lmp")), "place"), "20160701_PRC_LMP.csv")))


@query("src_16_ercot_day_ahead", hours("2016-11-06", 25))
def _(s, d):
    rows = hourly(s, d, ["01:00,N", "02:00,N", "02:00,Y", *(f"{h:02d}:00,N" for h in range(3, 25))])
    label = F.split("label", ",")
    lines = rows.select(said("11/06/2016,", label[0], ",", F.col("node"), ",", string("lmp"), ",", label[1]), "place")
    return shown(markets.ercot_day_ahead(s, text(s, lines, "cdr.DAMLMPHRLY.20161106.csv")))


@query("src_16_ercot_real_time", "SELECT s_name AS node, '2016-07-01 10:35' AS ts, s_acctbal AS lmp FROM supplier")
def _(s, d):
    lines = suppliers(s, d).select(said("t,N,", F.col("s_name"), ",", string("s_acctbal")), "place")
    return shown(markets.ercot_real_time(s, text(s, lines, "cdr.LMPSELECTBUSNP6787_20160701_113942_csv.csv"), "2016-03-13", "2016-11-06"))


@query("snk_1_inserted", "SELECT id, round(x, 9) AS lat, round(y, 9) AS lon FROM points", "points")
def _(s, d):
    where = folder(s)
    files.create_if_missing(s, where, files.POINTS)
    p = T.points(s, d).select("id", F.col("x").alias("lat"), F.col("y").alias("lon"))
    for half in ("id % 2 = 0", "id % 2 = 1"):
        files.append(p.where(half), where)
    return files.create_if_missing(s, where, files.POINTS).select("id", *r9("lat", "lon"))


@query("snk_3_node_files", "SELECT node, count(*) AS n, round(sum(lmp), 6) AS total FROM prices GROUP BY node", "prices")
def _(s, d):
    where = folder(s)
    files.write_nodes(T.prices(s, d), where)
    got = s.read.schema("ts string, lmp double, node long, year int").csv(where)
    return got.groupBy("node").agg(F.count("*").alias("n"), F.round(F.sum("lmp"), 6).alias("total"))


@query("snk_4_snapshot", "SELECT id, max_peak_load FROM loads", "loads")
def _(s, d):
    where, rows = folder(s), T.loads(s, d).select("id", "max_peak_load")
    files.snapshot(rows, where)
    return files.snapshot(rows.limit(0), where)


@query("snk_7_merged_years", "SELECT 'N' || user_id AS node, 2024 AS year, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value AS lmp FROM events WHERE user_id < 3")
def _(s, d):
    where = folder(s)
    p = T.prices(s, d).where("node < 3").withColumn("place", F.unix_micros(F.col("ts").cast("timestamp")))
    for node in range(3):
        for half, month in (("day(ts) <= 15", "202401"), ("day(ts) > 15", "202402")):
            files.write_text_file(p.where(f"node = {node} and {half}").select(said(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), ",", string("lmp")), "place"), f"{where}/N{node}-{month}.csv")
    return markets.merged_years(s, f"{where}/*.csv").select("node", "year", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "lmp")


@query("msc_14_with_hubs", "SELECT s_name AS node, s_suppkey / 2.0::DOUBLE AS latitude, s_suppkey / 4.0::DOUBLE AS longitude, 'Gen' AS type, 'R' AS region FROM supplier UNION ALL SELECT r_name || '.HUB', r_regionkey, r_regionkey, 'Hub', 'MISO' FROM region")
def _(s, d):
    n = T.read(s, d, "supplier").select(F.col("s_name").alias("node"), (F.col("s_suppkey") / 2.0).alias("latitude"), (F.col("s_suppkey") / 4.0).alias("longitude"), F.lit("Gen").alias("type"), F.lit("R").alias("region"))
    place = F.col("r_regionkey").cast("double")
    return markets.with_hubs(n, T.read(s, d, "region").select(F.concat("r_name", F.lit("_HUB")).alias("name"), place.alias("lat"), place.alias("lon")))


@query("msc_15_town_or_county", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'county ' || s_nationkey ELSE 'town ' || s_nationkey || ', ' || CASE s_suppkey % 4 WHEN 0 THEN 'NY' WHEN 1 THEN 'PA' WHEN 2 THEN 'MA' ELSE 'NJ' END END AS location FROM supplier")
def _(s, d):
    k, n = F.col("s_suppkey"), string("s_nationkey")
    state = F.element_at(F.array(*map(F.lit, markets.STATES)), (k % 4 + 1).cast("int"))
    t = T.read(s, d, "supplier").select(k.alias("id"), F.when(k % 3 == 0, "nan").otherwise(F.concat(F.lit("town "), n)).alias("town"), F.concat(F.lit("county "), n).alias("county_state"), state.alias("state"))
    return markets.town_or_county(t).select("id", "location")


@query("msc_18_weather_files", "SELECT s_name AS name, 'PJM' AS iso, '/in/' || s_suppkey || '_' || (s_suppkey / 2.0::DOUBLE) || '_-' || (s_suppkey / 4.0::DOUBLE) || '_2016.csv' AS path, 'PJM/in/NSRDB/2016/30min/' || s_name || '-2016.gz' AS target FROM supplier")
def _(s, d):
    k = F.col("s_suppkey")
    lat, lon = (k / 2.0).cast("string"), F.concat(F.lit("-"), (k / 4.0).cast("string"))
    n = T.read(s, d, "supplier").select(F.col("s_name").alias("name"), F.lit("PJM").alias("iso"), lat.alias("nsrdblat"), lon.alias("nsrdblon"))
    f = T.read(s, d, "supplier").select(F.explode(F.array(*(F.concat(F.lit("/in/"), k.cast("string"), F.lit("_"), lat, F.lit("_"), lon, F.lit(f"_{y}.csv")) for y in (2016, 2017)))).alias("path"))
    return markets.weather_of_nodes(n, f, "2016", 30)
