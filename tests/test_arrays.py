"""NumPy functions as Columns, fields, densities and distances."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftfield.functions import analytic
from driftfield.functions.arrays import ArrayFunction, array_function
from driftfield.model import Box
from driftfield.operators import move, points as gen, rules

XYZ = "id bigint, x double, y double, z double"


@pytest.fixture(scope="module")
def odd_points(spark):
    nan = float("nan")
    return spark.createDataFrame([(1, 1.0, 2.0, 0.5), (2, None, 1.0, 0.1), (3, nan, 1.0, 0.2), (4, -1.0, 0.3, 0.9), (5, None, None, None)], XYZ)


def test_null_and_nan_stay_apart(odd_points):
    got = {r["id"]: r["f"] for r in odd_points.select("id", ArrayFunction(lambda x, y, z: x * y + z).column().alias("f")).collect()}
    assert got[1] == 2.5 and got[4] == pytest.approx(0.6)
    assert got[2] is None and got[5] is None and math.isnan(got[3])


def test_outputs_are_checked(odd_points):
    for bad in (lambda x: (x, x), lambda x: x[:0]):
        with pytest.raises(Exception, match="outputs|shapes"):
            odd_points.select(array_function(bad, 1)("x")).collect()
    constant = array_function(lambda x: (1.0, x), 1, ("a", "b"))("x")
    assert odd_points.filter("id = 1").select(constant.alias("s")).first()["s"].asDict() == {"a": 1.0, "b": 1.0}


def vortex():
    def at(x, y, z, t):
        r2 = np.maximum(x * x + y * y, 1e-10)
        return -y / r2, x / r2, 0.0

    return at  # workers cannot import this module: a function made here travels as it is


@pytest.mark.parametrize("method", move.METHODS)
@pytest.mark.parametrize("plan", [None, "joins"])
def test_field_equals_its_column_twin(spark, method, plan):
    pts = spark.createDataFrame([(i, math.cos(i), math.sin(2 * i), 0.1 * i) for i in range(25)] + [(30, None, None, None)], XYZ).repartition(3)
    rule = rules.reflect(Box((-1.0, -1.0, 0.0), (1.0, 1.0, 2.0)))
    rows = lambda f, p=None: sorted((r["particle_id"], r["t_idx"], r["x"], r["y"], r["z"]) for r in move.advect(pts, f, 0.1, 4, method, rule, record_every=2, plan=p).filter("x IS NOT NULL").collect())
    got, want = rows(move.ArrayField(vortex()), plan), rows(move.AnalyticField(analytic.vortex()))
    assert len(got) == len(want) == 75
    assert np.allclose(np.array(got), np.array(want))


def test_extra_inputs_go_with_the_points(spark):
    pts = spark.createDataFrame([(i, 0.0, 0.0, 0.0, float(i) if i else None) for i in range(4)], XYZ + ", speed double")
    field = move.ArrayField(lambda x, s: (s + 0 * x, 0.0, 0.0), ("x", "speed"))
    for plan in (None, "joins"):
        end = {r["particle_id"]: r["x"] for r in move.advect(pts, field, 0.5, 2, plan=plan).filter("t_idx = 2").collect()}
        assert end[0] is None and [end[i] for i in (1, 2, 3)] == pytest.approx([1.0, 2.0, 3.0])


def test_no_shuffle(spark, odd_points):
    plan = move.advect(odd_points, move.ArrayField(vortex()), 0.1, 50)._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_missing_density_accepts_nothing(spark):
    pdf = ArrayFunction(lambda x: np.where(x < 0.5, np.where(x < 0.25, np.nan, -1.0), 2.0), ("x",))
    got = gen.density_sampled_points(spark, 50, Box((0.0, 0.0, 0.0), (1.0, 1.0, 1.0)), pdf.with_pdf, 3)
    assert got.count() == 50 and got.agg(F.min("x")).first()[0] >= 0.5


def test_points_of_one_file_are_walked_by_many_tasks(spark, tmp_path):
    """a small file is read by one task, which walked all its points."""
    spark.range(40).selectExpr("id", "id * 0.1D AS x", "1D AS y", "2D AS z").coalesce(1).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    walked = move.advect(df, move.ArrayField(vortex()), 0.1, 3)
    tasks = walked.select(F.spark_partition_id().alias("task"), "particle_id").groupBy("particle_id").agg(F.countDistinct("task").alias("n"), F.min("task").alias("task")).collect()
    assert len(tasks) == 40 and all(r["n"] == 1 for r in tasks) and len({r["task"] for r in tasks}) > 4
    plain = move.advect(spark.createDataFrame(df.collect(), df.schema), move.ArrayField(vortex()), 0.1, 3)
    assert sorted(map(tuple, walked.collect())) == sorted(map(tuple, plain.collect()))
