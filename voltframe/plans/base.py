"""Registration of queries, and what several of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltframe.sources import tables as T
from voltframe.sources.tables import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: A box for queries: north, south, east, west in the units of the derived coordinates.
BOX = (6.0, 2.0, 7.0, 3.0)
IN_BOX = "x BETWEEN 3.0 AND 7.0 AND y BETWEEN 2.0 AND 6.0"
STRICT = "x > 3.0 AND x < 7.0 AND y > 2.0 AND y < 6.0"


def query(name: str, sql: str | None = None, *needs: str, recursive: bool = False):
    """Registers a function (spark, sf_dir) under a name, with the SQL of its rows over the named derived tables."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = with_tables(sql, *needs, recursive=recursive) if needs or recursive else sql
        return f

    return add


def r9(*columns: str):
    return [F.round(c, 9).alias(c) for c in columns]


def generators(s: SparkSession, d: str) -> DataFrame:
    """(node, power): the three suppliers with the greatest capacity."""
    return T.sources(s, d).orderBy(F.desc("oper_cap"), "id").limit(3).select(F.col("point_id").alias("node"), F.col("oper_cap").alias("power"))


def demand(s: SparkSession, d: str) -> DataFrame:
    """(node, load): customers with a load."""
    return T.loads(s, d).where("max_peak_load > 0").select(F.col("point_id").alias("node"), F.col("max_peak_load").alias("load"))


def customers(s: SparkSession, d: str, modulus: int, rest: int = 0) -> DataFrame:
    return T.read(s, d, "customer").where(f"c_custkey % {modulus} = {rest}").select(F.col("c_custkey").alias("node"))


#: The generators, both directions of the tree, and walks from generators, as common table expressions.
GENS = "gens AS (SELECT point_id AS node, oper_cap AS power FROM sources ORDER BY oper_cap DESC, id LIMIT 3)"
ADJ = "adj AS (SELECT id, src AS node, dst AS other, length FROM tree UNION ALL SELECT id, dst, src, length FROM tree)"
LOAD = "demand AS (SELECT c_custkey AS node, c_acctbal / 100000.0::DOUBLE AS load FROM customer WHERE c_acctbal > 0)"


def walk(roots: str, paths: bool = False) -> str:
    """Walks over the tree from roots (a query of node)."""
    more, step = (", []::BIGINT[] AS path", ", list_append(w.path, a.id)") if paths else ("", "")
    return f"walk AS (SELECT node AS root, node, 0.0::DOUBLE AS dist, 0::BIGINT AS hops, NULL::BIGINT AS parent, NULL::BIGINT AS edge{more} FROM ({roots}) UNION ALL SELECT w.root, a.other, w.dist + a.length, w.hops + 1, w.node, a.id{step} FROM walk w JOIN adj a ON a.node = w.node WHERE w.parent IS NULL OR a.other <> w.parent)"


FLOW = f"+{GENS}, {ADJ}, {LOAD}, {walk('SELECT node FROM gens', True)}, shares AS (SELECT root, w.node, load, path, (1 / (dist * 0.4247::DOUBLE)) / sum(1 / (dist * 0.4247::DOUBLE)) OVER (PARTITION BY w.node) AS share FROM walk w JOIN demand d ON d.node = w.node), ratios AS (SELECT root, least(power / sum(share * load), 1.0::DOUBLE) AS ratio FROM shares JOIN gens g ON g.node = root GROUP BY root, power), flows AS (SELECT edge, flow, flow * flow * 0.4247::DOUBLE * length * 0.001::DOUBLE AS loss FROM (SELECT edge, sum(supply) AS flow FROM (SELECT unnest(path) AS edge, share * load * ratio AS supply FROM shares JOIN ratios USING (root)) GROUP BY edge) JOIN tree t ON t.id = edge)"
