"""Readers and writers for the files of the field: CSV, JSON, GeoJSON, XML, KML, record-typed CSV, snapshots."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltframe.functions.exprs import number_or_zero

POINTS, LOADS = "id long, lat double, lon double", "id long, name string, region string, max_peak_load double, point_id long"
LINES, SOURCES = "id long, left_id long, right_id long, length double, voltage double", "id long, point_id long, name string, naics_desc string, oper_cap double, winter_cap double, summer_cap double, gen_units int, lines int"


def write_text_file(lines: DataFrame, path: str) -> str:
    """lines (value) in order of the rows' place (place), if there is such a column, as one text file of that name; its path."""
    spark = lines.sparkSession
    rows = lines.repartition(1).sortWithinPartitions("place").select("value") if "place" in lines.columns else lines.select("value").repartition(1)
    rows.write.mode("overwrite").text(path + ".tmp")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(hadoop.Path(path + ".tmp")) if f.getPath().getName().startswith("part-"))
    fs.delete(hadoop.Path(path), True)
    fs.rename(part, hadoop.Path(path))
    fs.delete(hadoop.Path(path + ".tmp"), True)
    return path


def create_if_missing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, made empty where there is none yet."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def snapshot(rows: DataFrame, path: str) -> DataFrame:
    """rows, kept at path: read from there if it exists already."""
    rows.write.mode("ignore").parquet(path)
    return rows.sparkSession.read.parquet(path)


def relocated(items: DataFrame, moves: DataFrame) -> DataFrame:
    """items with point_id replaced where moves (id, new_point) has one."""
    m = moves.select("id", F.col("new_point").alias("_p"))
    return items.join(m, "id", "left").withColumn("point_id", F.coalesce("_p", "point_id")).select(items.columns)


def power_plants(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header and columns by position; text that is no number counts as 0."""
    names = ["name", "lat", "lon", "naics", "oper", "summer", "winter", "units", "lines"]
    raw = spark.read.csv(path, header=True, schema=", ".join(f"{n} string" for n in names), enforceSchema=True)
    n = lambda c: number_or_zero(F.col(c)).alias(c)
    return raw.select("name", n("lat"), n("lon"), "naics", n("oper"), n("summer"), n("winter"), number_or_zero(F.col("units")).cast("int").alias("units"), number_or_zero(F.col("lines")).cast("int").alias("lines"))


def node_places(spark: SparkSession, path: str) -> DataFrame:
    """(name, lat, lon) of a CSV with a header."""
    raw = spark.read.csv(path, header=True, schema="name string, lat string, lon string", enforceSchema=True)
    return raw.select("name", number_or_zero(F.col("lat")).alias("lat"), number_or_zero(F.col("lon")).alias("lon"))


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    """(name, lat, lon) of a JSON file [[name, lat, lon], …]."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("r"))
    return rows.select(F.col("r")[0].alias("name"), F.col("r")[1].cast("double").alias("lat"), F.col("r")[2].cast("double").alias("lon"))


def json_features(spark: SparkSession, path: str) -> DataFrame:
    """(name, x, y) of a JSON file {f: [{g: {c: [x, y]}, p: [name, …]}]}."""
    schema = "f array<struct<g: struct<c: array<double>>, p: array<string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("f").alias("f"))
    return rows.select(F.col("f.p")[0].alias("name"), F.col("f.g.c")[0].alias("x"), F.col("f.g.c")[1].alias("y"))


def geojson_lines(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(line, seq, x, y, voltage, vertex) of LineString features; vertices have dense numbers by place, so equal ones are one.

    With a box (n, s, e, w) only vertices strictly within it.
    """
    schema = "features array<struct<geometry: struct<coordinates: array<array<double>>>, properties: struct<VOLTAGE: double>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("line", "f"))
    v = f.select("line", F.col("f.properties.VOLTAGE").alias("voltage"), F.posexplode("f.geometry.coordinates").alias("seq", "c"))
    v = v.select(F.col("line").cast("long"), F.col("seq").cast("long"), F.col("c")[0].alias("x"), F.col("c")[1].alias("y"), "voltage")
    if box:
        from voltframe.functions.exprs import strictly_within

        v = v.where(strictly_within(F.col("x"), F.col("y"), *box))
    from voltframe.operators.components import numbered

    return v.join(numbered(v.select("x", "y").distinct(), ["x", "y"], "vertex"), ["x", "y"]).select("line", "seq", "x", "y", "voltage", "vertex")


#: Elements that one document of write_documents() holds about.
IN_DOCUMENT = 100_000


def write_documents(elements: DataFrame, path: str) -> str:
    """elements (j, JSON texts) as a folder of JSON documents {"elements": […]} of bounded size; its path."""
    n = max(1, -(-elements.count() // IN_DOCUMENT))
    dealt = elements.groupBy(F.pmod(F.xxhash64("j"), F.lit(n)).alias("part")).agg(F.concat(F.lit('{"elements": ['), F.array_join(F.collect_list("j"), ", "), F.lit("]}")).alias("value"))
    dealt.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


def overpass_ways(spark: SparkSession, path: str) -> DataFrame:
    """(way, seq, node, lat, lon) of a JSON file {elements: [{type, id, lat, lon | nodes}, …]}, or of a folder of such files, with ways and nodes in any of them: the nodes of each way in order; unknown ones are left out."""
    schema = "elements array<struct<type: string, id: long, lat: double, lon: double, nodes: array<long>>>"
    e = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*")
    ways = e.where("type = 'way'").select(F.col("id").alias("way"), F.posexplode("nodes").alias("seq", "node"))
    return ways.join(e.where("type = 'node'").select(F.col("id").alias("node"), "lat", "lon"), "node").select("way", F.col("seq").cast("long").alias("seq"), "node", "lat", "lon")


def xml_places(spark: SparkSession, path: str) -> DataFrame:
    """(node, area, kind, lat, lon) of an XML price map: a row for each tag m with n, a, p and two decimals; sane places by node."""
    raw = spark.read.format("xml").option("rowTag", "m").schema("n string, a string, p string, decimal array<double>").load(path)
    return raw.select(F.col("n").alias("node"), F.col("a").alias("area"), F.col("p").alias("kind"), F.col("decimal")[0].alias("lat"), F.col("decimal")[1].alias("lon")).where("lon > -180 and lon < 0 and lat > 20").orderBy("node")


def kml_places(spark: SparkSession, path: str) -> DataFrame:
    """(name, lon, lat, zone) of KML placemarks: the mean of a polygon's distinct corners, the zone from its description."""
    raw = spark.read.format("xml").option("rowTag", "Placemark").schema("name string, description string, Polygon struct<outerBoundaryIs: struct<LinearRing: struct<coordinates: string>>>").load(path)
    corners = F.array_distinct(F.filter(F.split(F.trim("Polygon.outerBoundaryIs.LinearRing.coordinates"), r"\s+"), lambda c: c != ""))
    mean = lambda k: F.expr(f"aggregate(corners, cast(0 as double), (s, c) -> s + cast(split(c, ',')[{k}] as double)) / size(corners)")
    r = raw.withColumn("corners", corners)
    return r.select(F.upper(F.trim("name")).alias("name"), mean(0).alias("lon"), mean(1).alias("lat"), F.upper(F.trim(F.regexp_extract("description", r"Zone:?\s*(?:<[^>]*>\s*)*([A-Za-z_ ]+)", 1))).alias("zone"))


def xlsx_rows(spark: SparkSession, path: str, sheet: int = 1, skip: int = 0, foot: int = 0) -> DataFrame:
    """(file, row, cells) of a sheet (counted from 1) of .xlsx workbooks: cells as text, null where there is none.

    The first rows (skip) and the last ones (foot) that the sheet has are left out. A workbook has to fit in a row.
    """

    def rows_of(content: bytes) -> list[tuple[int, list[str | None]]]:
        import io
        import zipfile
        from xml.etree import ElementTree

        space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                shared = ["".join(t.text or "" for t in x.iter(f"{space}t")) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{space}si")]
            root = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml"))
        out = []
        for n, row in enumerate(root.iter(f"{space}row")):
            cells: list[str | None] = []
            for c in row.iter(f"{space}c"):
                letters = "".join(x for x in c.get("r", "") if x.isalpha())
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                cells += [None] * (max(at, len(cells) + 1) - len(cells))
                value = c.find(f"{space}v")
                text = "".join(t.text or "" for t in c.iter(f"{space}t")) if c.get("t") == "inlineStr" else value.text if value is not None else None
                cells[-1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            out.append((int(row.get("r", n + 1)), cells))
        return out[skip : len(out) - foot]

    def run(batches):
        import pandas as pd

        for b in batches:
            found = [(re.sub(r".*/", "", p), n, cells) for p, content in zip(b["path"], b["content"], strict=True) for n, cells in rows_of(content)]
            yield pd.DataFrame(found, columns=["file", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row long, cells array<string>")


def copied(spark: SparkSession, moves: DataFrame) -> int:
    """Copies files (path, target), making folders as needed, and leaves out those whose target is there; how many it copied."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    done = 0
    for r in moves.select("path", "target").toLocalIterator():
        a, b = hadoop.Path(r.path), hadoop.Path(r.target)
        if not b.getFileSystem(conf).exists(b):
            b.getFileSystem(conf).mkdirs(b.getParent())
            done += bool(hadoop.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf))
    return done


def weights(spark: SparkSession, path: str) -> DataFrame:
    """(name, mw) of a quoted CSV without header."""
    return spark.read.csv(path, schema="name string, mw double", quote='"')


def names(spark: SparkSession, path: str) -> DataFrame:
    """(name) of a text file with a name a line, quoted or not; blank lines are passed over; inner spaces stay."""
    return spark.read.text(path).select(F.regexp_replace("value", '^"|"$', "").alias("name")).where("length(trim(name)) > 0")


def record_typed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Data rows, and (told, found): the trailer's count of lines beside the number of rows, of a C/H/D/T file.

    Columns are named by the header line, in lower case with underscores.
    """
    lines = spark.read.text(path)
    heads = lines.where(F.col("value").startswith('"H"')).limit(1).collect()
    if not heads:
        raise ValueError("no header line")
    import csv

    cols = [re.sub(r"[^a-z0-9]+", "_", c.lower()).strip("_") or f"c{i}" for i, c in enumerate(next(csv.reader([heads[0].value])))]
    data = lines.where(F.col("value").startswith('"D"'))
    rows = data.select(F.from_csv("value", ", ".join(f"`{c}` string" for c in cols)).alias("r")).select("r.*")
    told = lines.where(F.col("value").startswith('"T"')).select(F.regexp_extract("value", r"(\d+)", 1).cast("long").alias("told"))
    return rows, told.join(data.agg(F.count("*").alias("found")))


def zipped(spark: SparkSession, left: str, right: str) -> DataFrame:
    """(line, left, right): two text files side by side by an explicit line number, never by row order."""

    def numbered_lines(path: str, name: str) -> DataFrame:
        whole = spark.read.text(path, wholetext=True)
        return whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("line", name))

    return numbered_lines(left, "left").join(numbered_lines(right, "right"), "line")


def price_files(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All files of a pattern with the name each row came from (file)."""
    return spark.read.csv(pattern, header=True, schema=schema, enforceSchema=True).withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))


#: Rows of a node and year that one task writes.
IN_NODE_FILE = 2_000_000


def write_nodes(prices: DataFrame, path: str) -> None:
    """A folder for each node and year of compressed CSV, with one file unless it is large: rows of a node come together first.

    Opening files takes longer than filling them, so tasks are as many as folders ask for, not as bytes do.
    """
    p = prices.withColumn("year", F.year("ts"))
    n = p.groupBy("node", "year").agg(F.count("*").alias("n"))
    folders = n.count()
    large = n.where(F.col("n") > IN_NODE_FILE).select("node", "year", F.ceil(F.col("n") / IN_NODE_FILE).alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("ts"), F.col("parts")), F.lit(0))
    dealt = p.join(F.broadcast(large), ["node", "year"], "left").withColumn("part", part).repartition(max(1, min(5000, -(-folders // 100))), "node", "year", "part")
    dealt.select(*p.columns).write.partitionBy("node", "year").option("compression", "gzip").mode("overwrite").csv(path)


def todo(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """One row of wanted (latlonindex, …, file) for each place whose file is not done yet."""
    w = Window.partitionBy("latlonindex").orderBy("file")
    return wanted.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").join(done.select("file"), "file", "left_anti").select(wanted.columns)


def affine(x: Column, y: Column, a: tuple[float, float, float], b: tuple[float, float, float]) -> Column:
    """Coordinates in another reference system by a linear form: the pluggable default where no projection library is there."""
    return F.struct((x * a[0] + y * a[1] + a[2]).alias("x"), (x * b[0] + y * b[1] + b[2]).alias("y"))


#: Semi-major axis and flattening of two ellipsoids (fixed values).
BESSEL, WGS84 = (6377397.155, 1 / 299.1528128), (6378137.0, 1 / 298.257223563)


def transverse_mercator(x: Column, y: Column, central: float, east: float, scale: float = 1.0, ellipsoid: tuple[float, float] = BESSEL) -> Column:
    """(lat, lon) in degrees on the same ellipsoid of a transverse Mercator grid, by the usual series; no datum shift."""
    a, f = ellipsoid
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    m = y / F.lit(scale)
    mu = m / F.lit(a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    e1 = (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    p = mu + F.sin(mu * 2) * (3 * e1 / 2 - 27 * e1**3 / 32) + F.sin(mu * 4) * (21 * e1**2 / 16 - 55 * e1**4 / 32) + F.sin(mu * 6) * (151 * e1**3 / 96)
    s, c, t = F.sin(p), F.cos(p), F.tan(p)
    c1, t1 = c * c * ep2, t * t
    n1 = F.lit(a) / F.sqrt(F.lit(1.0) - s * s * e2)
    r1 = F.lit(a * (1 - e2)) / F.pow(F.lit(1.0) - s * s * e2, F.lit(1.5))
    d = (x - east) / (n1 * scale)
    lat = p - (n1 * t / r1) * (d * d / 2 - (t1 * 3 + c1 * 10 - c1 * c1 * 4 - 9 * ep2 + 5) * F.pow(d, F.lit(4)) / 24)
    lon = (d - (t1 * 2 + c1 + 1) * F.pow(d, F.lit(3)) / 6 + (F.lit(5.0) - c1 * 2 + t1 * 28) * F.pow(d, F.lit(5)) / 120) / c
    return F.struct(F.degrees(lat).alias("lat"), (F.degrees(lon) + central).alias("lon"))


#: Shift from the Bessel ellipsoid's German datum to WGS 84 (fixed values): metres, seconds of arc, parts per million.
DHDN = ((598.1, 73.7, 418.2), (0.202, 0.045, -2.455), 6.7)


def shifted(place: Column, shift: tuple = DHDN, ellipsoid: tuple[float, float] = BESSEL, to: tuple[float, float] = WGS84) -> Column:
    """(lat, lon) in degrees on another datum of a place (lat, lon) at height 0: seven parameters (position vector form)."""
    (dx, dy, dz), turns, ppm = shift
    rx, ry, rz = (t * math.pi / 180 / 3600 for t in turns)
    a, f = ellipsoid
    e2 = f * (2 - f)
    lat, lon = F.radians(place["lat"]), F.radians(place["lon"])
    n = F.lit(a) / F.sqrt(F.lit(1.0) - F.sin(lat) * F.sin(lat) * e2)
    x, y, z = n * F.cos(lat) * F.cos(lon), n * F.cos(lat) * F.sin(lon), n * (1 - e2) * F.sin(lat)
    m = 1 + ppm * 1e-6
    x, y, z = (x - y * rz + z * ry) * m + dx, (x * rz + y - z * rx) * m + dy, (y * rx - x * ry + z) * m + dz
    b, g = to
    k2 = g * (2 - g)
    flat = F.sqrt(x * x + y * y)
    u = F.atan2(z, flat * (1 - g))  # Bowring's formula; its error is far below a millimetre on the ground
    polar = b * (1 - g)
    out = F.atan2(z + F.pow(F.sin(u), F.lit(3.0)) * (k2 / (1 - k2) * polar), flat - F.pow(F.cos(u), F.lit(3.0)) * (k2 * b))
    return F.struct(F.degrees(out).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"))


def gauss_kruger(x: Column, y: Column, zone: int = 3) -> Column:
    """(lat, lon) in degrees on WGS 84 of a German grid place: zone 3 is the one with central meridian 9."""
    return shifted(transverse_mercator(x, y, 3.0 * zone, 500_000.0 + 1_000_000.0 * zone))
