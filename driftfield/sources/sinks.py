"""Sinks: trajectory tables, per-point and per-path layouts, snapshots and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from driftfield.functions.vector import magnitude
from driftfield.model import AXES, check
from driftfield.operators.paths import PID, SPAN_ROWS, ends, steps
from driftfield.operators.ranks import join_per_key, number_rows
from driftfield.sources.scan import evenly_spaced

STEPS_PER_FILE = 64
POINTS_PER_CHUNK = 65_536
ROWS_PER_FILE = 1_000_000


def _bucketed(traj: DataFrame) -> DataFrame:
    return traj.withColumn("t_bucket", F.floor(F.col("t_idx") / STEPS_PER_FILE).cast("int"))


def write_trajectory(traj: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet by runs of 64 steps and, inside, runs of 65,536 particles: a time slice reads only its folders."""
    check(traj, "traj")
    chunk = F.floor(F.col(PID) / POINTS_PER_CHUNK)
    _bucketed(traj).repartition("t_bucket", chunk).sortWithinPartitions("t_idx", PID).write.mode(mode).partitionBy("t_bucket").parquet(path)


def append_trajectory(new: DataFrame, path: str) -> None:
    """Append later steps of the same particles; other particles or overlapping steps raise before anything is written."""
    old = new.sparkSession.read.parquet(path)
    ids_old, ids_new = old.select(PID).distinct(), new.select(PID).distinct()
    odd = ids_old.join(ids_new, PID, "left_anti").union(ids_new.join(ids_old, PID, "left_anti"))
    if not odd.isEmpty():
        raise ValueError("appended rows must hold the same particles as the table")
    top, low = old.agg(F.max("t_idx")).first()[0], new.agg(F.min("t_idx")).first()[0]
    if top is not None and low is not None and low <= top:
        raise ValueError(f"appended steps start at {low}, the table already reaches {top}")
    write_trajectory(new, path, "append")


def points_layout(traj: DataFrame, per_particle: DataFrame | None = None, per_row: DataFrame | None = None) -> DataFrame:
    """One row per (step, particle) with extra columns per particle or per (step, particle)."""
    df = traj.select(F.col("t").alias("time"), F.col("t_idx").alias("time_step"), F.col(PID), *AXES)
    if per_particle is not None:
        df = join_per_key(df, per_particle, PID, "left")
    if per_row is not None:
        df = df.join(per_row.withColumnRenamed("t_idx", "time_step"), ["time_step", PID], "left")
    return df


def lines_layout(traj: DataFrame, max_particles: int | None = None, points_per_line: int = SPAN_ROWS) -> DataFrame:
    """(particle_id, part, n, path_length, path): ordered paths.

    A path is cut into parts of ``points_per_line`` steps, so no row and no task ever holds an unbounded
    path; up to that length a particle is one row. ``path_length`` is that of the whole particle. With
    ``max_particles`` that many, evenly spaced by id, are taken.
    """
    if max_particles is not None:
        ids = traj.select(PID).distinct()
        n = ids.count()
        if n > max_particles:
            pos = F.col("_pos") - 1
            # position p is wanted if it is floor(i * (n-1) / (k-1)) for some i
            i = F.ceil(pos * (max_particles - 1) / F.lit(n - 1)) if max_particles > 1 else F.lit(0)
            hit = F.floor(i * F.lit(n - 1) / F.lit(max(max_particles - 1, 1))) == pos
            ids = number_rows(ids, PID, "_pos").filter(hit).select(PID)
            traj = traj.join(ids, PID, "left_semi")
    stepped = steps(traj, points_per_line).withColumn("part", F.floor(F.col("t_idx") / points_per_line))
    parts = stepped.groupBy(PID, "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("step_len").alias("_len"), F.sort_array(F.collect_list(F.struct("t_idx", *AXES))).alias("path")
    )
    whole = parts.groupBy(PID).agg(F.coalesce(F.sum("_len"), F.lit(0.0)).alias("path_length"))
    return parts.join(whole, PID).select(PID, "part", "n", "path_length", "path")


def series_layout(traj: DataFrame) -> DataFrame:
    """Rows of per-step files: position, step time and the particle's initial position."""
    first = ends(traj).select(PID, *[F.col(f"a{a}").alias(f"initial_{a}") for a in AXES])
    return join_per_key(traj, first, PID).select("t_idx", "t", PID, *AXES, *[f"initial_{a}" for a in AXES])


def write_series(traj: DataFrame, path: str) -> None:
    """One folder per step, in files of about ``ROWS_PER_FILE`` rows."""
    largest = traj.groupBy("t_idx").count().agg(F.max("count")).first()[0] or 0
    share = F.pmod(F.xxhash64(PID), F.lit(max(1, -(-largest // ROWS_PER_FILE))))
    series_layout(traj).withColumn("_share", share).repartition("t_idx", "_share").drop("_share").write.partitionBy("t_idx").parquet(path)


def field_snapshot(samples: DataFrame) -> DataFrame:
    """One snapshot from one or many: time average per node, plus its magnitude."""
    mean = samples.groupBy("node_id").agg(*[F.avg(c).alias(c) for c in "uvw"])
    return mean.withColumn("magnitude", magnitude(F.col("u"), F.col("v"), F.col("w")))


def cell_code(width: Column) -> Column:
    """Cell type by number of nodes. 3 nodes = 5, 4 nodes = 10, 8 nodes = 12."""
    return F.when(width == 3, F.lit(5)).when(width == 4, F.lit(10)).when(width == 8, F.lit(12))


def series_catalog(times: DataFrame, base: str, k: int | None = None) -> DataFrame:
    """(t, file): which step file holds which time, at most k evenly spaced steps."""
    kept = times if k is None else evenly_spaced(times, "t_idx", k)
    return kept.select("t_idx", "t", F.concat(F.lit(base + "_"), F.lpad(F.col("t_idx").cast("string"), 6, "0")).alias("file"))


def structured_plane(rows: DataFrame, shape) -> DataFrame:
    """One row: origin and spacing = range / (n - 1) per axis of a regular grid's points."""
    aggs = []
    for a, n in zip(AXES, shape):
        span = (F.max(a) - F.min(a)) / F.lit(max(n - 1, 1))
        aggs += [F.min(a).alias(f"origin_{a}"), (span if n > 1 else F.lit(1.0)).alias(f"spacing_{a}")]
    return rows.agg(*aggs, F.count(F.lit(1)).alias("n_points"))
