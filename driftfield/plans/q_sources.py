"""Queries: scans, layouts and sinks (S), streams (X), sorts and set operations (L, U)."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from driftfield.operators import paths
from driftfield.plans.registry import query
from driftfield.sources import clustered
from driftfield.session import cut_lineage, scratch_path, stamp_files
from driftfield.sources import scan, sinks
from driftfield.streaming import stream

ROW = "particle_id t_idx"


def q(name, sql, fn, uses="", dbl="", ints="", digits=6):
    query(name, sql, uses, dbl, ints, digits)(fn)


def _stored(t):
    """Samples written by step and read back: the table a user scans."""
    path = scratch_path(t.spark, "samples")
    t.samples().repartition("t_idx").write.partitionBy("t_idx").parquet(path)
    return t.spark.read.parquet(path)


SAMPLES = "SELECT t_idx, t, node_id, u, v, w FROM series"
q("scan_samples", SAMPLES + " WHERE t_idx BETWEEN 2 AND 4", lambda t: scan.scan_samples(_stored(t), 2, 4), "series", "t u v w", "t_idx node_id")
q("scan_snapshot", SAMPLES + " WHERE t_idx = 3", lambda t: scan.scan_snapshot(_stored(t), 3), "series", "t u v w", "t_idx node_id")
q("scan_grid_series", "SELECT t_idx, i, j, k, u, v, w FROM series WHERE t_idx >= 5", lambda t: scan.scan_grid_series(t.series(), 5).select("t_idx", "i", "j", "k", "u", "v", "w"), "series", "u v w", "t_idx i j k")
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
q("file_manifest", " UNION ALL ".join(f"SELECT '{n}.parquet' AS name, 'parquet' ext" for n in _TABLES), lambda t: scan.file_manifest(t.spark, t.dir, "*.parquet").select("name", "ext"))
NAT = "SELECT name, row_number() OVER (ORDER BY list_transform(regexp_extract_all(name,'\\d+'), lambda x: x::BIGINT), name)-1 t_idx FROM file_names"
q("natural_order", NAT, lambda t: scan.natural_order(t.file_names()), "file_names", "", "t_idx")
q("prefer_parallel", "SELECT name FROM file_names WHERE name LIKE '%.pvtu'", lambda t: scan.prefer_parallel(t.file_names()), "file_names")
q("last_steps", "SELECT t_idx, t FROM times ORDER BY t_idx DESC LIMIT 3", lambda t: scan.last_steps(t.times(), 3), "times", "t", "t_idx")
# one "time" per order day: a longer list of snapshots
DAYS = "(SELECT row_number() OVER (ORDER BY d)-1 t_idx, epoch_us(d)/86400000000.0::DOUBLE t FROM (SELECT DISTINCT o_orderdate d FROM orders))"


def _days(t):
    from pyspark.sql import Window as W

    days = t.raw("orders").select(F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("_u")).distinct()
    return days.select((F.row_number().over(W.orderBy("_u")) - 1).cast("bigint").alias("t_idx"), (F.col("_u") / 86400000000.0).alias("t"))


q("select_timesteps", f"SELECT t_idx, t FROM (SELECT *, row_number() OVER (ORDER BY t)-1 n, count(*) OVER () c FROM {DAYS} WHERE t BETWEEN 9000 AND 10000) WHERE n IN (SELECT CAST(floor(i*(c-1)/16) AS BIGINT) FROM range(17) r(i))",
  lambda t: scan.select_timesteps(_days(t), 17, (9000.0, 10000.0)), "", "t", "t_idx")
q("stride_steps", f"SELECT t_idx, t FROM (SELECT *, row_number() OVER (ORDER BY t_idx)-1-5 n, (SELECT greatest(1,(count(*)-5)//20) FROM {DAYS}) s FROM {DAYS}) WHERE n >= 0 AND n%s=0 AND n < s*20",
  lambda t: scan.stride_steps(_days(t), 5, 20), "", "t", "t_idx")
q("stable_mesh_start", "WITH c AS (SELECT t_idx, count(*) n FROM traj GROUP BY 1), m AS (SELECT n FROM (SELECT n, count(*) k, min(t_idx) f FROM (SELECT * FROM c ORDER BY t_idx LIMIT 10) GROUP BY 1) ORDER BY k DESC, f LIMIT 1) SELECT min(t_idx) t_idx, (SELECT n FROM m) n FROM c WHERE n=(SELECT n FROM m)",
  lambda t: scan.stable_mesh_start(t.traj().select("t_idx")), "traj", "", "t_idx n")
q("time_from_name", f"SELECT name, t_idx, CASE WHEN name LIKE '%.pvtu' THEN regexp_extract(name,'_(\\d+)\\.pvtu$',1)::DOUBLE ELSE t_idx::DOUBLE END t FROM ({NAT})",
  lambda t: scan.time_from_name(scan.natural_order(t.file_names())), "file_names", "t", "t_idx")
q("detect_vector_column", "SELECT node_id, u FROM node_values", lambda t: (lambda df: df.select("node_id", F.col(scan.detect_vector_column(df)).alias("u")))(t.node_values()), "node_values", "u", "node_id")
q("tetra_cells", "SELECT elem_id FROM tets WHERE elem_id%3 <> 0", lambda t: scan_cells(t), "tets", "", "elem_id")


def scan_cells(t):
    from driftfield.operators.sample import tetra_cells

    typed = t.tets().withColumn("cell_type", F.when(F.col("elem_id") % 3 == 0, F.lit(5)).otherwise(F.lit(10)))
    return tetra_cells(typed).select("elem_id")


q("open_table", "SELECT count(*) n FROM events", lambda t: scan.open_table(t.spark, f"{t.dir}/events.parquet").agg(F.count(F.lit(1)).alias("n")), "", "", "n")


def _written(t):
    path = scratch_path(t.spark, "traj")
    sinks.write_trajectory(t.traj(), path)
    return t.spark.read.parquet(path).drop("t_bucket")


q("write_trajectory", "SELECT * FROM traj", _written, "traj", "t x y z", ROW)


def _appended(t):
    path = scratch_path(t.spark, "traj")
    traj = t.traj()
    sinks.write_trajectory(traj.filter("t_idx < 30"), path)
    sinks.append_trajectory(traj.filter("t_idx >= 30"), path)
    return t.spark.read.parquet(path).drop("t_bucket")


q("append_trajectory", "SELECT * FROM traj", _appended, "traj", "t x y z", ROW)
q("points_layout", "SELECT t AS time, t_idx time_step, particle_id, x, y, z, m tag, x*2 twice FROM traj JOIN (SELECT particle_id, max(t_idx) m FROM traj GROUP BY 1) USING (particle_id)",
  lambda t: sinks.points_layout(t.traj(), t.traj().groupBy("particle_id").agg(F.max("t_idx").alias("tag")), t.traj().select("particle_id", "t_idx", (F.col("x") * 2).alias("twice"))),
  "traj", "time x y z twice", "time_step particle_id tag")
LINE = "SELECT particle_id, sum(sqrt((x-px)*(x-px)+(y-py)*(y-py)+(z-pz)*(z-pz))) path_length, count(*) n, min_by(x,t_idx) first_x, max_by(y,t_idx) last_y FROM (SELECT *, lag(x) OVER w px, lag(y) OVER w py, lag(z) OVER w pz FROM traj WINDOW w AS (PARTITION BY particle_id ORDER BY t_idx)) GROUP BY 1"


def _lines(df):
    return df.select("particle_id", "path_length", "n", F.get("path", F.lit(0))["x"].alias("first_x"), F.element_at("path", -1)["y"].alias("last_y"))


q("lines_layout", LINE, lambda t: _lines(sinks.lines_layout(t.traj())), "traj", "path_length first_x last_y", "particle_id n")
q("lines_layout_spaced", f"WITH p AS (SELECT DISTINCT particle_id FROM traj), o AS (SELECT particle_id, row_number() OVER (ORDER BY particle_id)-1 n FROM p) SELECT l.* FROM ({LINE}) l JOIN o USING (particle_id) WHERE o.n IN (SELECT CAST(floor(i*((SELECT count(*) FROM p)-1)/9) AS BIGINT) FROM range(10) r(i))",
  lambda t: _lines(sinks.lines_layout(t.traj(), 10)), "traj", "path_length first_x last_y", "particle_id n")
q("series_layout", "SELECT t_idx, t, particle_id, x, y, z, a.x initial_x, a.y initial_y, a.z initial_z FROM traj b JOIN (SELECT particle_id, x, y, z FROM traj WHERE t_idx=0) a USING (particle_id)".replace("t_idx, t, particle_id, x, y, z, a.x", "b.t_idx, b.t, b.particle_id, b.x, b.y, b.z, a.x"),
  lambda t: sinks.series_layout(t.traj()), "traj", "t x y z initial_x initial_y initial_z", "t_idx particle_id")


def _series(t):
    path = scratch_path(t.spark, "series")
    sinks.write_series(t.traj(), path)
    return t.spark.read.parquet(path).select("particle_id", "t_idx", "x", "initial_x")


q("write_series", "SELECT b.particle_id, b.t_idx, b.x, a.x initial_x FROM traj b JOIN (SELECT particle_id, x FROM traj WHERE t_idx=0) a USING (particle_id)", _series, "traj", "x initial_x", ROW)
q("field_snapshot_out", "SELECT *, sqrt(u*u+v*v+w*w) magnitude FROM (SELECT node_id, avg(u) u, avg(v) v, avg(w) w FROM series GROUP BY 1)", lambda t: sinks.field_snapshot(t.samples()), "series", "u v w magnitude", "node_id")
q("series_catalog", f"SELECT t_idx, t, 'case_'||lpad(t_idx::VARCHAR,6,'0') AS file FROM (SELECT *, row_number() OVER (ORDER BY t_idx)-1 n, count(*) OVER () c FROM {DAYS}) WHERE n IN (SELECT CAST(floor(i*(c-1)/11) AS BIGINT) FROM range(12) r(i))",
  lambda t: sinks.series_catalog(_days(t), "case", 12), "", "t", "t_idx")
q("structured_plane_out", "SELECT " + ", ".join(f"min({a}) origin_{a}, (max({a})-min({a}))/{n - 1} spacing_{a}" for a, n in zip("xyz", (10, 11, 9))) + ", count(*) n_points FROM nodes",
  lambda t: sinks.structured_plane(t.node_values(), (10, 11, 9)), "nodes", " ".join(f"{p}_{a}" for p in ("origin", "spacing") for a in "xyz"), "n_points")
q("element_order", "SELECT 10 code, count(*) n FROM tets GROUP BY 1", lambda t: t.tets().groupBy(sinks.cell_code(F.size("nodes")).alias("code")).agg(F.count(F.lit(1)).alias("n")), "tets", "", "code n")

# ---------------------------------------------------------------------------------------------------
# streams: trajectory rows arrive as files, cut by day


def _arrivals(t, rows=None, part="least(floor(t / 3), 9)"):
    """Files that arrive part after part in time order; a particle's rows of a part share a file.

    A file source takes files by their modification times, which are those of the writers' clocks: they are set, a second for each part.
    """
    folder = scratch_path(t.spark, "arrive")
    df = cut_lineage((t.traj() if rows is None else rows).withColumn("_part", F.expr(part).cast("int")))
    start, there = time.time_ns() // 1_000_000, set()
    for k, n in enumerate(r[0] for r in df.select("_part").distinct().orderBy("_part").collect()):  # about ten
        df.filter(F.col("_part") == n).drop("_part").repartition(2, "particle_id").write.mode("append").parquet(folder)
        there |= stamp_files(t.spark, folder, start + 1000 * k, there)
    return folder


def _append_stream(t):
    out, ckpt = scratch_path(t.spark, "out"), scratch_path(t.spark, "ckpt")
    stream.append_trajectory_stream(stream.read_rows(t.spark, _arrivals(t)), out, ckpt).awaitTermination()
    return t.spark.read.parquet(out).drop("t_bucket")


q("append_trajectory_stream", "SELECT * FROM traj", _append_stream, "traj", "t x y z", ROW)


def _checked_stream(t):
    """Late rows, rows sent twice and rows of particles that no early part has: what stays, and how many were refused."""
    out, ckpt = scratch_path(t.spark, "checked"), scratch_path(t.spark, "ckpt")
    own = t.traj().select("particle_id", "t_idx", "t", "x", "y", "z")
    twice = own.filter("t_idx % 9 = 4")
    strange = own.filter("particle_id % 7 = 3").withColumn("particle_id", -1 - F.col("particle_id"))
    known = own.select("particle_id").distinct()
    rows = stream.read_rows(t.spark, _arrivals(t, own.unionByName(twice).unionByName(strange), _PART))
    stream.append_checked_stream(rows, out, ckpt, known).awaitTermination()
    kept = stream.read_checked(t.spark, out).groupBy("particle_id").agg(F.count(F.lit(1)).alias("n"), F.sum("t_idx").alias("steps"))
    refused = stream.read_refused(t.spark, out).select(F.lit(None).cast("bigint").alias("particle_id"), "n", F.lit(None).cast("bigint").alias("steps"), "reason")
    return kept.withColumn("reason", F.lit("kept")).unionByName(refused)


#: Every twentieth step arrives one part late.
_PART = "least(floor(t / 3), 9) + CASE WHEN t_idx % 20 = 7 THEN 1 ELSE 0 END"


def _running(t):
    state, ckpt = scratch_path(t.spark, "state"), scratch_path(t.spark, "ckpt")
    stream.running_path_length(stream.read_rows(t.spark, _arrivals(t, part=_PART)), state, ckpt).awaitTermination()
    return stream.read_running(t.spark, state).select("particle_id", "path_length", "n_late")


q("running_path_length", f"""WITH a AS (SELECT *, {_PART} part FROM traj),
 m AS (SELECT *, max(t_idx) OVER (PARTITION BY particle_id ORDER BY part RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) seen FROM a),
 k AS (SELECT *, coalesce(t_idx <= seen, false) late FROM m),
 d AS (SELECT particle_id, sqrt((x-lag(x) OVER w)*(x-lag(x) OVER w)+(y-lag(y) OVER w)*(y-lag(y) OVER w)+(z-lag(z) OVER w)*(z-lag(z) OVER w)) s
  FROM k WHERE NOT late WINDOW w AS (PARTITION BY particle_id ORDER BY t_idx))
SELECT particle_id, coalesce(path_length, 0) path_length, n_late FROM (SELECT particle_id, sum(s) path_length FROM d GROUP BY 1)
 JOIN (SELECT particle_id, count(*) FILTER (late) n_late FROM k GROUP BY 1) USING (particle_id)""",
  _running, "traj", "path_length", "particle_id n_late")


q("append_checked_stream", f"""WITH known AS (SELECT *, {_PART} part FROM traj), a AS (SELECT * FROM known UNION ALL SELECT * FROM known WHERE t_idx % 9 = 4),
 m AS (SELECT *, max(t_idx) OVER (PARTITION BY particle_id ORDER BY part RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) seen,
  row_number() OVER (PARTITION BY particle_id, part, t_idx) nth FROM a),
 k AS (SELECT *, CASE WHEN t_idx <= seen THEN 'overlapping step' WHEN nth > 1 THEN 'repeated row' ELSE 'kept' END reason FROM m)
SELECT particle_id, count(*) n, sum(t_idx) steps, 'kept' reason FROM k WHERE reason = 'kept' GROUP BY 1
UNION ALL SELECT NULL, count(*), NULL, reason FROM k WHERE reason <> 'kept' GROUP BY reason
UNION ALL SELECT NULL, count(*), NULL, 'unknown particle' FROM traj WHERE particle_id % 7 = 3""",
  _checked_stream, "traj", "", "particle_id n steps")


def _windows(t):
    out, ckpt = scratch_path(t.spark, "win"), scratch_path(t.spark, "ckpt")
    columns = ["particle_id", "ts", "t", "x", "y", "z"]
    own = t.event_rows().select(*columns)
    # a last row far ahead closes every window of the data; its own stays open
    ahead = own.agg(F.max("ts").alias("ts"), F.max("t").alias("t")).select(
        F.lit(-1).cast("bigint").alias("particle_id"), (F.col("ts") + F.expr("interval 60 days")).alias("ts"), (F.col("t") + 60).alias("t"), *[F.lit(0.0).alias(a) for a in "xyz"]
    )
    folder = _arrivals(t, own.unionByName(ahead), "CASE WHEN particle_id < 0 THEN 10 ELSE least(floor(t / 3), 9) END")
    rows = stream.read_rows(t.spark, folder, schema="particle_id bigint, ts timestamp_ntz, t double, x double, y double, z double")
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    stream.drain_to_table(stream.windowed_cell_counts(timed, "ts", 50.0, "1 day", "2 days"), out, ckpt).awaitTermination()
    return t.spark.read.parquet(out).select(F.datediff("window_start", F.lit("2024-01-01")).alias("day"), "cx", "cy", "cz", "n")


q("windowed_cell_counts", "SELECT CAST(floor(t) AS BIGINT) AS day, CAST(floor(x/50) AS BIGINT) cx, CAST(floor(y/50) AS BIGINT) cy, CAST(floor(z/50) AS BIGINT) cz, count(*) n FROM event_rows GROUP BY ALL",
  _windows, "event_rows", "", "day cx cy cz n")

# ---------------------------------------------------------------------------------------------------
# sorts, limits and sets


q("distinct_positions", "SELECT DISTINCT x, y, z FROM event_points", lambda t: t.event_points().select("x", "y", "z").distinct(), "event_points", "x y z")
q("union_rows", "SELECT id, x FROM points UNION ALL SELECT id, x FROM event_points", lambda t: t.points().select("id", "x").unionByName(t.event_points().select("id", "x")), "points event_points", "x", "id")
q("anti_rows", "SELECT name FROM file_names WHERE regexp_replace(name,'\\.[a-z]+$','') NOT IN (SELECT regexp_replace(name,'\\.[a-z]+$','') FROM file_names WHERE name LIKE '%.vtu')",
  lambda t: (lambda f: f.withColumn("b", F.regexp_replace("name", r"\.[a-z]+$", "")).join(f.filter(F.col("name").endswith(".vtu")).select(F.regexp_replace("name", r"\.[a-z]+$", "").alias("b")), "b", "left_anti").select("name"))(t.file_names()), "file_names")
q("farthest_particles", "SELECT particle_id, d FROM (SELECT a.particle_id, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z)) d FROM (SELECT * FROM traj WHERE t_idx=0) a JOIN (SELECT * FROM traj QUALIFY row_number() OVER (PARTITION BY particle_id ORDER BY t_idx DESC)=1) b USING (particle_id)) ORDER BY d DESC, particle_id LIMIT 10",
  lambda t: paths.displacement(t.traj()).orderBy(F.desc("displacement"), "particle_id").limit(10).withColumnRenamed("displacement", "d"), "traj", "d", "particle_id")


def _clustered(t, by, ranges):
    """The trajectories written along the curve in 24 files, and read back by ranges."""
    path = scratch_path(t.spark, "clustered")
    clustered.write_clustered(t.traj().select("particle_id", "t_idx", "t", "x", "y", "z"), path, 24, by)
    return clustered.read_ranges(t.spark, path, ranges)


query("clustered_box_scan", "SELECT particle_id, t_idx, t, x, y, z FROM traj WHERE x BETWEEN 20 AND 60 AND y BETWEEN 10 AND 40", "traj", "t x y z", "particle_id t_idx")(
    lambda t: _clustered(t, ("x", "y", "z"), {"x": (20.0, 60.0), "y": (10.0, 40.0)})
)
query("clustered_time_scan", "SELECT particle_id, t_idx, t, x, y, z FROM traj WHERE t >= 5 AND t <= 7.5 AND x <= 30", "traj", "t x y z", "particle_id t_idx")(
    lambda t: _clustered(t, ("t", "x"), {"t": (5.0, 7.5), "x": (None, 30.0)})
)
