"""Queries that once read a part of their tables, over whole tables of the next size against their SQL in DuckDB."""

import duckdb
import pytest

from tests.test_queries import TABLES, rows
from voltframe.plans import registry

SF = "/root/testdata/sf0.01"
NAMES = ["res_1_walks", "res_2_paths3", "res_3_4_paths_from", "res_5_paths_total", "res_6_triangles", "res_7_sigma", "cmp_9_line_colours", "msc_9_line_details", "grf_11_13_paths", "agg_16_popularity", "srt_1_by_length"]


@pytest.mark.parametrize("name", NAMES)
def test_whole_tables(spark, name):
    duck, sql = duckdb.connect(), registry.ORACLE[name]
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(sql).df())
