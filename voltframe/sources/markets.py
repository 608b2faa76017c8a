"""Daily price files of six market operators as rows (node, ts, lmp), and what is done to node files after that.

A file is read as lines of cells, told apart by their position. Head and foot lines have no number where the price
is and fall out, so files can be split. The day comes from the file's name or the line. Times are placed by position:
the n-th hour that occurs in all files is n hours after the first day's midnight, so days of 23 and 25 hours leave
neither gaps nor clashes, and all times are of the first day's offset from UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltframe.operators import timeseries
from voltframe.operators.components import numbered

#: Cells by position (fixed values): a line's node, its hour label or time, its price; or of wide files the first hour's
#: price and the cells from one hour to the next.
ISONE, NYISO = {"label": 2, "node": 4, "lmp": 6}, {"label": 0, "node": 2, "lmp": 3}
MISO, PJM = {"node": 0, "kind": 2, "first": 3, "step": 1}, {"node": 1, "first": 7, "step": 3}
_STAMP, _MINUTE = "yyyyMMdd", "MM/dd/yyyy HH:mm"
#: Letters of states by their number (fixed values).
STATES = {36: "NY", 42: "PA", 25: "MA", 34: "NJ"}


def cells(spark: SparkSession, pattern: str, n: int) -> DataFrame:
    """(file, place, c0 … c{n-1}): the lines of all files, place a number that grows along each file; missing cells are null."""
    lines = spark.read.text(pattern).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), F.monotonically_increasing_id().alias("place"), "value")
    row = F.from_csv("value", ", ".join(f"c{i} string" for i in range(n))).alias("c")
    return lines.select("file", "place", row).select("file", "place", "c.*")


def number(c: str) -> Column:
    return F.expr(f"try_cast(trim({c}) as double)")


def day_of(file: str = "file") -> Column:
    """The first eight digits that stand together in a file's name, as a date."""
    return F.expr(f"to_timestamp(nullif(regexp_extract({file}, '([0-9]{{8}})', 1), ''), '{_STAMP}')")


def placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (node, lmp, keys, the first of which is day) as (node, ts, lmp): the n-th of the distinct keys is n hours after the first day began."""
    hours = numbered(rows.select(*keys).distinct(), keys, "n")
    first = rows.agg(F.unix_seconds(F.min(keys[0])).alias("first"))
    at = hours.join(F.broadcast(first)).select(*keys, F.timestamp_seconds(F.col("first") + F.col("n") * 3600).alias("ts"))
    return rows.join(at, keys).select("node", "ts", "lmp")


def isone(spark: SparkSession, pattern: str) -> DataFrame:
    """(node, ts, lmp): an hour label per line (01 to 24, and 02X where the second hour comes again)."""
    c = cells(spark, pattern, 7).select(day_of().alias("day"), F.col(f"c{ISONE['label']}").alias("label"), F.col(f"c{ISONE['node']}").alias("node"), number(f"c{ISONE['lmp']}").alias("lmp")).where("lmp is not null and label is not null")
    return placed(c, ["day", "label"])


def _wide(c: DataFrame, node: str, first: int, step: int, most: int) -> DataFrame:
    """(node, day, h, lmp): a row for each of the prices that stand in a line at equal distances."""
    price = F.array(*(number(f"c{first + step * h}") for h in range(most)))
    return c.select(F.col(node).alias("node"), "day", F.posexplode(price).alias("h", "lmp"))


def miso(spark: SparkSession, pattern: str) -> DataFrame:
    """(node, ts, lmp): a line for each node and kind of price with 24 hours in it; kind LMP counts. An hour without a price is null."""
    c = cells(spark, pattern, MISO["first"] + 24).withColumn("day", day_of()).where(F.col(f"c{MISO['kind']}") == "LMP")
    return placed(_wide(c, f"c{MISO['node']}", MISO["first"], MISO["step"], 24), ["day", "h"])


def pjm(spark: SparkSession, pattern: str, spring: list[str] | None = None, fall: list[str] | None = None) -> DataFrame:
    """(node, ts, lmp): a line for each node with 24 hours, three cells each.

    On days of spring (yyyymmdd) the third hour's cells are left out and the day has 23 hours; on days of fall there is
    a 25th hour.
    """
    c = cells(spark, pattern, PJM["first"] + 3 * 25).withColumn("day", day_of()).where(F.col(f"c{PJM['node']}").isNotNull() & number(f"c{PJM['first']}").isNotNull())
    stamp = F.date_format("day", _STAMP)
    long = _wide(c, f"c{PJM['node']}", PJM["first"], PJM["step"], 25)
    return placed(long.where(~(stamp.isin(spring or []) & (F.col("h") == 2)) & (stamp.isin(fall or []) | (F.col("h") < 24))), ["day", "h"])


def nyiso(spark: SparkSession, pattern: str) -> DataFrame:
    """(node, ts, lmp): a time and a node per line. A time that a node has twice in a file is the hour that comes again."""
    c = cells(spark, pattern, 4).select("file", "place", F.expr(f"try_to_timestamp(c{NYISO['label']}, '{_MINUTE}')").alias("at"), F.col(f"c{NYISO['node']}").alias("node"), number(f"c{NYISO['lmp']}").alias("lmp")).where("lmp is not null and at is not null")
    again = c.withColumn("turn", F.row_number().over(Window.partitionBy("file", "node", "at").orderBy("place")))
    return placed(again.withColumn("day", F.date_trunc("day", "at")), ["day", "at", "turn"])


def caiso(spark: SparkSession, pattern: str, zone: str = "America/Los_Angeles", node_first: bool = True) -> DataFrame:
    """(node, ts, lmp): node, time in UTC and price (or time, node and price) per line; the times become local ones."""
    node, at = ("c0", "c1") if node_first else ("c1", "c0")
    c = cells(spark, pattern, 3).select(F.col(node).alias("node"), F.regexp_replace(F.substring(F.col(at), 1, 19), "T", " ").alias("at"), number("c2").alias("lmp")).where("lmp is not null")
    return c.select("node", timeseries.to_local(F.expr("try_to_timestamp(at, 'yyyy-MM-dd HH:mm:ss')"), zone).alias("ts"), "lmp").where("ts is not null")


def ercot_day_ahead(spark: SparkSession, pattern: str) -> DataFrame:
    """(node, ts, lmp): day, hour ending, node, price and a flag of the hour that comes again (none: N) per line."""
    c = cells(spark, pattern, 5).select(F.expr("try_to_timestamp(c0, 'MM/dd/yyyy')").alias("day"), F.concat(F.trim("c1"), F.coalesce(F.trim("c4"), F.lit("N"))).alias("label"), F.col("c2").alias("node"), number("c3").alias("lmp")).where("lmp is not null and day is not null")
    return placed(c, ["day", "label"])


def ercot_time(file: Column, spring: str, fall: str) -> Column:
    """The time in a name like …20101201_005025…: an hour back from spring (03:00 of that day) to fall (02:00), unless the name says xhr."""
    at = F.to_timestamp(F.regexp_extract(file, r"(\d{8}_\d{6})", 1), "yyyyMMdd_HHmmss")
    usual = timeseries.shifted_in_dst(at, f"{spring} 03:00:00", f"{fall} 02:00:00")
    return F.when(F.contains(file, F.lit("xhr")), at).otherwise(usual)


def ercot_real_time(spark: SparkSession, pattern: str, spring: str, fall: str, minutes: int = 5) -> DataFrame:
    """(node, ts, lmp): a file for each run of the market, its time in the name, cut to bins of so many minutes; spring and fall as yyyy-mm-dd."""
    c = cells(spark, pattern, 4).select("file", F.col("c2").alias("node"), number("c3").alias("lmp")).where("lmp is not null")
    at = F.unix_seconds(ercot_time(F.col("file"), spring, fall))
    return c.select("node", F.timestamp_seconds(at - F.pmod(at, F.lit(60 * minutes))).alias("ts"), "lmp")


def merged_years(spark: SparkSession, pattern: str) -> DataFrame:
    """(node, year, ts, lmp) of monthly node files NODE-yyyymm.gz (time, price; no head): one place for each node and year."""
    c = cells(spark, pattern, 2)
    node, month = (F.regexp_extract("file", r"^(.*)-(\d{6})\.[^.]*$", k) for k in (1, 2))
    return c.select(node.alias("node"), F.substring(month, 1, 4).cast("int").alias("year"), F.to_timestamp("c0").alias("ts"), number("c1").alias("lmp")).where("ts is not null")


def write_years(prices: DataFrame, path: str) -> None:
    """merged_years() as compressed CSV in a folder for each node and year, in order of time."""
    prices.repartition("node", "year").sortWithinPartitions("node", "year", "ts").write.partitionBy("node", "year").option("compression", "gzip").mode("overwrite").csv(path)


# --- places of nodes ---


def with_hubs(nodes: DataFrame, hubs: DataFrame) -> DataFrame:
    """(node, latitude, longitude, type, region) of nodes and hubs (name, lat, lon); a hub NAME.xxx is NAME.HUB, of type Hub and region MISO."""
    hub = hubs.select(F.concat(F.expr("substring(name, 1, length(name) - 4)"), F.lit(".HUB")).alias("node"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.lit("Hub").alias("type"), F.lit("MISO").alias("region"))
    return nodes.select("node", "latitude", "longitude", "type", "region").unionByName(hub)


def town_or_county(nodes: DataFrame) -> DataFrame:
    """nodes (…, town, county_state, state) with location: the town and the letters of its state's number if there is a town, else the county."""
    code = F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv))
    known = F.col("town").isNotNull() & (F.lower(F.trim("town")) != "nan")
    return nodes.withColumn("location", F.when(known, F.concat_ws(", ", "town", code[F.col("state").cast("int")])).otherwise(F.col("county_state")))


def weather_files(files: DataFrame) -> DataFrame:
    """(path, nsrdbid, lat, lon, year) of files (path) that are named id_lat_lon_year.csv; coordinates as they are written."""
    part = lambda k: F.regexp_extract("path", r"([^/_]+)_(-?[0-9.]+)_(-?[0-9.]+)_([A-Za-z0-9]{4})\.[^/]*$", k)
    return files.select("path", part(1).alias("nsrdbid"), part(2).alias("lat"), part(3).alias("lon"), part(4).alias("year")).where("nsrdbid <> ''")


def weather_of_nodes(nodes: DataFrame, files: DataFrame, year: str, minutes: int, ending: str = ".gz") -> DataFrame:
    """(name, iso, path, target): the weather file at each node's place (nsrdblat, nsrdblon) and where it goes under the node's name."""
    f = weather_files(files).where(F.col("year") == year).select("path", F.col("lat").alias("nsrdblat"), F.col("lon").alias("nsrdblon"))
    n = nodes.select("name", "iso", F.col("nsrdblat").cast("string").alias("nsrdblat"), F.col("nsrdblon").cast("string").alias("nsrdblon"))
    target = F.concat(F.col("iso"), F.lit(f"/in/NSRDB/{year}/{minutes}min/"), F.col("name"), F.lit(f"-{year}{ending}"))
    return n.join(f, ["nsrdblat", "nsrdblon"]).select("name", "iso", "path", target.alias("target"))


#: What reads the places of each operator's nodes, by its name.
PLACES = {"CAISO": "xml_places", "ERCOT": "kml_places", "ISONE": "node_places", "MISO": "json_features"}


def places(spark: SparkSession, operator: str, path: str) -> DataFrame:
    """The places of an operator's nodes by the reader of its files."""
    from voltframe.sources import files

    if operator not in PLACES:
        raise ValueError(f"no reader of places for {operator}; there are {', '.join(sorted(PLACES))}")
    return getattr(files, PLACES[operator])(spark, path)
