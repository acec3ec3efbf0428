"""One query per family beside its SQL at the smallest scale; all of them with ALL_QUERIES=1 (or tools/check.py)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PICKED = [
    "displace_rk4", "trilinear_sample_nan", "grid_series_sample", "interp_time_zero", "point_in_element", "radius_join_cloud",
    "sph_varying_h", "kde_grid_3d", "trajectory_stats", "step_report", "mixed", "continuous_inlet_grid", "choose_with",
    "stratified_points", "percentile_clip", "lines_layout_spaced", "natural_order", "running_path_length", "box_intersects",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def sorted_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else PICKED)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cur = duck.execute(entry.oracle_sql()[name])
    want = cur.fetchall()
    assert sorted_rows(df.columns, [tuple(r) for r in df.collect()]) == sorted_rows([d[0] for d in cur.description], want)


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "x", "y", "z"]
