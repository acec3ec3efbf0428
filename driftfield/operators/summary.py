"""Aggregates over samples, times, keys and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from driftfield.functions.vector import is_finite, magnitude
from driftfield.model import AXES
from driftfield.operators.ranks import number_rows

UVW = ("u", "v", "w")


def segment_sum(df: DataFrame, key: str, value: str, n_segments: int | None = None) -> DataFrame:
    """(segment, total, n). With ``n_segments`` the result is dense: segments 0 to n - 1 without rows have 0, others stay as they are."""
    agg = df.groupBy(F.col(key).cast("bigint").alias("segment")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    if n_segments is None:
        return agg
    every = df.sparkSession.range(n_segments).withColumnRenamed("id", "segment")
    return every.join(agg, "segment", "full").select("segment", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("n", F.lit(0)).alias("n"))


def dense_ids(df: DataFrame, key: str, name: str = "dense_id", rows_per_range: int = 1_000_000) -> DataFrame:
    """(key, dense_id): distinct keys numbered from 0 in key order, range by range."""
    keys = df.select(key).distinct()
    return number_rows(keys, key, name, rows_per_range).withColumn(name, F.col(name) - 1)


def bounds(df: DataFrame) -> DataFrame:
    """One row: min and max of x, y, z."""
    return df.agg(*[f(a).alias(f"{a}_{n}") for a in AXES for n, f in (("min", F.min), ("max", F.max))])


def snapshot_stats(samples: DataFrame) -> DataFrame:
    """Per step: mean, std and range of each component, and mean, max, min of the speed."""
    speed = magnitude(*[F.col(c) for c in UVW])
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(speed).alias("speed_mean"), F.max(speed).alias("speed_max"), F.min(speed).alias("speed_min")]
    for c in UVW:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return samples.groupBy("t_idx").agg(*aggs)


def series_check(samples: DataFrame) -> DataFrame:
    """One row: steps, smallest and largest node count of a step, consistent."""
    sizes = samples.groupBy("t_idx").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_steps"), F.min("n").alias("n_min"), F.max("n").alias("n_max")).withColumn(
        "consistent", F.col("n_min") == F.col("n_max")
    )


def step_interval_stats(times: DataFrame) -> DataFrame:
    """One row: mean, population std, min and max of the time steps; uniform if the std is at most 1e-6."""
    dt = times.select((F.col("t") - F.lag("t").over(W.orderBy("t_idx"))).alias("dt")).filter(F.col("dt").isNotNull())
    return dt.agg(F.avg("dt").alias("dt_mean"), F.stddev_pop("dt").alias("dt_std"), F.min("dt").alias("dt_min"), F.max("dt").alias("dt_max")).withColumn(
        "uniform", F.col("dt_std") <= 1e-6
    )


def time_bounds(times: DataFrame) -> DataFrame:
    return times.agg(F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.count(F.lit(1)).alias("n_steps"))


def valid_times(at: DataFrame, times: DataFrame) -> DataFrame:
    """Rows of ``at`` with ``valid``: does t lie within the range of the snapshots."""
    ends = times.agg(F.struct(F.min("t").alias("lo"), F.max("t").alias("hi")).alias("e"))
    return at.withColumn("_e", ends.scalar()).withColumn("valid", F.col("t").between(F.col("_e.lo"), F.col("_e.hi"))).drop("_e")


def grid_info(grid: DataFrame) -> DataFrame:
    """One row: nodes per axis and in all."""
    return grid.agg(*[(F.max(c) - F.min(c) + 1).alias(f"n_{c}") for c in "ijk"], F.count(F.lit(1)).alias("n_nodes"))


def field_check(samples: DataFrame, times: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: values, times and positions that are not finite, and times that run backwards."""

    def bad(df: DataFrame, cols) -> DataFrame:
        ok = F.lit(True)
        for c in cols:
            ok = ok & is_finite(F.col(c).cast("double"))
        return df.agg(F.count_if(~ok).alias("n"))

    back = times.select((F.col("t") < F.lag("t").over(W.orderBy("t_idx"))).alias("b")).agg(F.count_if("b"))
    return bad(samples, UVW).withColumnRenamed("n", "bad_values").withColumns(
        {"bad_times": bad(times, ["t"]).scalar(), "bad_positions": bad(nodes, AXES).scalar(), "backward_times": back.scalar()}
    )


def size_estimate(samples: DataFrame, row_bytes: int = 24, chunk_bytes: int = 500 * 1024 * 1024) -> DataFrame:
    """One row: steps, rows per step, bytes per step and in all, and how many steps fill a chunk."""
    sizes = samples.groupBy("t_idx").agg(F.count(F.lit(1)).alias("n"))
    out = sizes.agg(F.count(F.lit(1)).alias("n_steps"), F.max("n").alias("rows_per_step"), (F.sum("n") * row_bytes).alias("total_bytes"))
    per = F.col("rows_per_step") * row_bytes
    return out.withColumns({"step_bytes": per, "steps_per_chunk": F.greatest(F.floor(F.lit(chunk_bytes) / per), F.lit(1))})
