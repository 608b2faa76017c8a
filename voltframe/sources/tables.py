"""Grid tables derived from the given star schema, by integer arithmetic only: the same rows in any engine.

points: customers, and suppliers from SUPPLIERS on. loads: customers. sources: suppliers. Edges of the tree: each
customer k from 1 on with (k - 1) div 2, each supplier with customer s_suppkey mod n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltframe.functions.exprs import FUELS, distance

SUPPLIERS = 1_000_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def x_of(node: Column) -> Column:
    return ((node * 7919) % 10007) / F.lit(1000.0)


def y_of(node: Column) -> Column:
    return ((node * 104729) % 10009) / F.lit(1000.0)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y)"""
    ids = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).unionAll(read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + SUPPLIERS).alias("id")))
    return ids.select("id", x_of(F.col("id")).alias("x"), y_of(F.col("id")).alias("y"))


def loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, region, max_peak_load, point_id); accounts in the red have no load on record (null)."""
    c = read(spark, sf_dir, "customer")
    place = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("r_name").alias("region"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 100000.0).alias("max_peak_load"), F.col("c_custkey").alias("point_id"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, point_id, name, naics_desc, oper_cap)"""
    kinds = F.array(*[F.lit(k) for k in list(FUELS)[:6]])
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") + SUPPLIERS).alias("point_id"), F.col("s_name").alias("name"), kinds[(F.col("s_suppkey") % 6).cast("int")].alias("naics_desc"), (F.abs("s_acctbal") / 1000.0).alias("oper_cap"))


def _measured(pairs: DataFrame) -> DataFrame:
    s, d = F.col("src"), F.col("dst")
    return pairs.select("id", "src", "dst", distance(x_of(s), y_of(s), x_of(d), y_of(d)).alias("length"), ((F.col("src") % 3 + 1) * 115.0).alias("voltage"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (id, src, dst, length, voltage) of a tree over all points."""
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    n = c.agg(F.count("*").alias("n"))
    k = F.col("c_custkey")
    lower = c.where("c_custkey >= 1").select(k.alias("id"), k.alias("src"), F.expr("(c_custkey - 1) div 2").alias("dst"))
    upper = s.join(F.broadcast(n)).select((F.col("n") + F.col("s_suppkey")).alias("id"), (F.col("s_suppkey") + SUPPLIERS).alias("src"), (F.col("s_suppkey") % F.col("n")).alias("dst"))
    return _measured(lower.unionAll(upper))


def mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree with tie lines from urgent orders; ids from 2,000,000,000 + o_orderkey; no self loops."""
    n = read(spark, sf_dir, "customer").agg(F.count("*").alias("n"))
    o = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").join(F.broadcast(n))
    ties = o.select((F.col("o_orderkey") + 2_000_000_000).alias("id"), F.col("o_custkey").alias("src"), F.expr("(o_custkey * 31 + 7) % n").alias("dst")).where("src <> dst")
    return tree(spark, sf_dir).unionByName(_measured(ties))


def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree without edges of customers that 97 divides."""
    return tree(spark, sf_dir).where("not (src < 1000000000 and src % 97 = 0)")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, ts, lmp) from events: a price series for each user."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("node"), "ts", F.col("value").alias("lmp"))


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, seq, x, y): the orders of a customer by date, with a place for each: of every fifth order one of 221, so that lines meet there."""
    o = read(spark, sf_dir, "orders")
    from pyspark.sql import Window

    k, shared = F.col("o_orderkey"), F.col("o_orderkey") % 5 == 0
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    x = F.when(shared, (k * 37 % 13) / F.lit(2.0)).otherwise((k * 7919 % 9973) / F.lit(1000.0))
    y = F.when(shared, (k * 53 % 17) / F.lit(2.0)).otherwise((k * 6271 % 9967) / F.lit(1000.0))
    return o.select(F.col("o_custkey").alias("line"), seq.cast("long").alias("seq"), x.alias("x"), y.alias("y"))


#: The same tables in SQL, as common table expressions.
SQL = {
    "points": "points AS (SELECT id, ((id * 7919) % 10007) / 1000.0::DOUBLE AS x, ((id * 104729) % 10009) / 1000.0::DOUBLE AS y FROM (SELECT c_custkey AS id FROM customer UNION ALL SELECT s_suppkey + 1000000000 FROM supplier))",
    "loads": "loads AS (SELECT c_custkey AS id, c_name AS name, r_name AS region, CASE WHEN c_acctbal > 0 THEN c_acctbal / 100000.0::DOUBLE END AS max_peak_load, c_custkey AS point_id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
    "sources": "sources AS (SELECT s_suppkey AS id, s_suppkey + 1000000000 AS point_id, s_name AS name, [" + ", ".join(f"'{k}'" for k in list(FUELS)[:6]) + "][1 + s_suppkey % 6] AS naics_desc, abs(s_acctbal) / 1000.0::DOUBLE AS oper_cap FROM supplier)",
    "tree": "tree AS (SELECT e.id, src, dst, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS length, (src % 3 + 1) * 115.0::DOUBLE AS voltage FROM (SELECT c_custkey AS id, c_custkey AS src, (c_custkey - 1) // 2 AS dst FROM customer WHERE c_custkey >= 1 UNION ALL SELECT n + s_suppkey, s_suppkey + 1000000000, s_suppkey % n FROM supplier, (SELECT count(*) AS n FROM customer)) e JOIN points p ON p.id = src JOIN points q ON q.id = dst)",
    "mesh": "mesh AS (SELECT * FROM tree UNION ALL SELECT e.id, src, dst, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)), (src % 3 + 1) * 115.0::DOUBLE FROM (SELECT o_orderkey + 2000000000 AS id, o_custkey AS src, (o_custkey * 31 + 7) % n AS dst FROM orders, (SELECT count(*) AS n FROM customer) WHERE o_orderpriority = '1-URGENT') e JOIN points p ON p.id = src JOIN points q ON q.id = dst WHERE src <> dst)",
    "islands": "islands AS (SELECT * FROM tree WHERE NOT (src < 1000000000 AND src % 97 = 0))",
    "prices": "prices AS (SELECT user_id AS node, ts, value AS lmp FROM events)",
    "polylines": "polylines AS (SELECT o_custkey AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS seq, CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey * 37 % 13) / 2.0::DOUBLE ELSE (o_orderkey * 7919 % 9973) / 1000.0::DOUBLE END AS x, CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey * 53 % 17) / 2.0::DOUBLE ELSE (o_orderkey * 6271 % 9967) / 1000.0::DOUBLE END AS y FROM orders)",
}
_NEEDS = {"tree": ["points"], "mesh": ["points", "tree"], "islands": ["points", "tree"]}


def with_tables(query: str, *names: str, recursive: bool = False) -> str:
    """query after the common table expressions it names."""
    all_names = list(dict.fromkeys(x for n in names for x in [*_NEEDS.get(n, []), n]))
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(SQL[n] for n in all_names)}{', ' if query.lstrip().startswith('+') else ' '}{query.lstrip().lstrip('+')}"
