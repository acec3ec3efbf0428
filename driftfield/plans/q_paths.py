"""Queries: trajectory analysis (T), aggregates (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftfield.operators import cells, density, paths, ranks, sample, summary
from driftfield.plans.registry import query


def q(name, sql, fn, uses="traj", dbl="", ints="", digits=6):
    query(name, sql, uses, dbl, ints, digits)(fn)


D = "sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z))"
FIRST = "(SELECT * FROM traj WHERE t_idx=0)"
LAST = "(SELECT * FROM traj QUALIFY row_number() OVER (PARTITION BY particle_id ORDER BY t_idx DESC)=1)"
STEP = f"SELECT b.particle_id, b.t_idx, {D} AS step_len, b.t-a.t AS step_dt FROM traj b JOIN traj a ON a.particle_id=b.particle_id AND a.t_idx=b.t_idx-1"
ENDS = f"SELECT a.particle_id, a.x ax, a.y ay, a.z az, a.t ta, b.x bx, b.y b_y, b.z bz, b.t tb, {D} moved FROM {FIRST} a JOIN {LAST} b USING (particle_id)"
# velocities: forward differences, the last row repeats the one before (fixture for operators that need u, v, w)
VEL_SQL = """SELECT particle_id, t_idx, t, x, y, z, x*0.5 u, y-z v, z*z w FROM traj"""


def _vel(t):
    return t.traj().withColumns({"u": F.col("x") * 0.5, "v": F.col("y") - F.col("z"), "w": F.col("z") * F.col("z")})


ROW = "particle_id t_idx"
q("trajectory_rows", "SELECT * FROM traj", lambda t: t.traj(), dbl="t x y z", ints=ROW)
q("slice_time", "SELECT * FROM traj WHERE t_idx BETWEEN 5 AND 9", lambda t: paths.slice_time(t.traj(), 5, 9), dbl="t x y z", ints=ROW)
q("slice_particles", "SELECT * FROM traj WHERE particle_id BETWEEN 3 AND 40", lambda t: paths.slice_particles(t.traj(), 3, 40), dbl="t x y z", ints=ROW)
q("at_time", "SELECT * FROM traj WHERE t_idx = 7", lambda t: paths.at_time(t.traj(), 7), dbl="t x y z", ints=ROW)
q("of_particle", "SELECT * FROM traj WHERE particle_id = 4", lambda t: paths.of_particle(t.traj(), 4), dbl="t x y z", ints=ROW)
q("every_kth_step", "SELECT * FROM traj WHERE t_idx % 3 = 0", lambda t: paths.every_kth_step(t.traj(), 3), dbl="t x y z", ints=ROW)
q("displacement", f"SELECT particle_id, moved displacement FROM ({ENDS})", lambda t: paths.displacement(t.traj()), dbl="displacement", ints="particle_id")
q("steps", f"SELECT t.particle_id, t.t_idx, s.step_len, s.step_dt FROM traj t LEFT JOIN ({STEP}) s USING (particle_id, t_idx)",
  lambda t: paths.steps(t.traj(), 16).select("particle_id", "t_idx", "step_len", "step_dt"), dbl="step_len step_dt", ints=ROW)
q("path_length", f"SELECT particle_id, sum(step_len) path_length FROM ({STEP}) GROUP BY 1", lambda t: paths.path_length(t.traj()), dbl="path_length", ints="particle_id")
q("speeds", f"SELECT particle_id, t_idx, step_len/greatest(step_dt,1e-12) speed FROM ({STEP})", lambda t: paths.speeds(t.traj()), dbl="speed", ints=ROW, digits=4)
q("speeds_recorded", f"SELECT particle_id, t_idx, sqrt(u*u+v*v+w*w) speed FROM ({VEL_SQL}) WHERE (particle_id, t_idx) NOT IN (SELECT (particle_id, max(t_idx)) FROM traj GROUP BY particle_id)",
  lambda t: paths.speeds(_vel(t)), dbl="speed", ints=ROW)
q("accelerations", f"""SELECT b.particle_id, b.t_idx, sqrt((b.u-a.u)*(b.u-a.u)+(b.v-a.v)*(b.v-a.v)+(b.w-a.w)*(b.w-a.w))/m.dt acceleration
FROM ({VEL_SQL}) b JOIN ({VEL_SQL}) a ON a.particle_id=b.particle_id AND a.t_idx=b.t_idx-1 JOIN (SELECT particle_id, (max(t)-min(t))/(count(*)-1) dt FROM traj GROUP BY 1) m ON m.particle_id=b.particle_id""",
  lambda t: paths.accelerations(_vel(t)), dbl="acceleration", ints=ROW)
q("time_step_mean", "SELECT *, duration/(n_steps-1) dt_mean FROM (SELECT max(t)-min(t) duration, count(DISTINCT t_idx) n_steps, count(DISTINCT particle_id) n_particles, count(*) n_rows FROM traj)",
  lambda t: paths.time_step_mean(t.traj()), dbl="duration dt_mean", ints="n_steps n_particles n_rows")
MOVED = f"SELECT b.*, {D} moved FROM traj b JOIN {FIRST} a USING (particle_id)"
q("from_start", f"SELECT b.particle_id, b.t_idx, {D} moved FROM traj b JOIN {FIRST} a USING (particle_id)", lambda t: paths.from_start(t.traj()).select("particle_id", "t_idx", "moved"), dbl="moved", ints=ROW)
q("convergence", f"""SELECT 'success' status, (SELECT count(DISTINCT t_idx) FROM traj) n_steps, count(*) n_particles, avg(final) mean_final, max(final) max_final, avg(top) mean_max
FROM (SELECT particle_id, arg_max(moved, t_idx) final, max(moved) top FROM ({MOVED}) GROUP BY 1)""",
  lambda t: paths.convergence(t.traj(), at_least=10), dbl="mean_final max_final mean_max", ints="n_steps n_particles")


def _four(c: str, n: str) -> str:
    return f"avg({c}) {n}_mean, stddev_pop({c}) {n}_std, min({c}) {n}_min, max({c}) {n}_max"


STATS = f"""SELECT * FROM (SELECT count(*) n_particles, {_four('moved', 'displacement')} FROM ({ENDS})),
 (SELECT {_four('p', 'path_length')} FROM (SELECT particle_id, sum(step_len) p FROM ({STEP}) GROUP BY 1)),
 (SELECT {_four('step_len/greatest(step_dt,1e-12)', 'speed')} FROM ({STEP})),
 (SELECT count(*) n_rows, {', '.join(f'min({a}) {a}_min, max({a}) {a}_max' for a in 'xyz')} FROM traj)"""
STAT_COLS = " ".join(f"{n}_{m}" for n in ("displacement", "path_length") for m in ("mean", "std", "min", "max")) + " " + " ".join(f"{a}_{m}" for a in "xyz" for m in ("min", "max"))
q("trajectory_stats", STATS, lambda t: paths.trajectory_stats(t.traj()), dbl=STAT_COLS + " speed_mean speed_std speed_min speed_max", ints="n_particles n_rows")
q("trajectory_check", f"""SELECT *, n_not_finite=0 AND n_backward=0 AND n_uneven_steps=0 AND n_tiny_dt=0 AS valid FROM
 (SELECT 0 n_not_finite, count(*) FILTER (step_dt<0) n_backward, count(*) FILTER (step_dt<1e-10) n_tiny_dt, min(step_dt) min_dt FROM ({STEP})),
 (SELECT count(*) FILTER (n <> n0) n_uneven_steps FROM (SELECT t_idx, count(*) n, (SELECT count(*) FROM traj WHERE t_idx=0) n0 FROM traj GROUP BY 1))""",
  lambda t: paths.trajectory_check(t.traj()), dbl="min_dt", ints="n_not_finite n_backward n_tiny_dt n_uneven_steps")


def _later(t):
    return t.traj().withColumns({"t": F.col("t") + 100.0, "x": -F.col("x")})


q("merge_time", "SELECT * FROM traj UNION ALL SELECT particle_id, t_idx+(SELECT max(t_idx)+1 FROM traj), t+100, -x, y, z FROM traj",
  lambda t: paths.merge_time(t.traj(), _later(t)), dbl="t x y z", ints=ROW)
q("merge_particles", "SELECT * FROM traj UNION ALL SELECT particle_id+(SELECT max(particle_id)+1 FROM traj), t_idx, t, -x, y, z FROM traj",
  lambda t: paths.merge_particles(t.traj(), t.traj().withColumn("x", -F.col("x"))), dbl="t x y z", ints=ROW)
q("trajectory_from_points", "SELECT 0 particle_id, event_id t_idx, event_id::DOUBLE t, x, y, 0.0::DOUBLE z FROM event_rows",
  lambda t: paths.trajectory_from_points(t.event_rows().drop("z", "t"), step="event_id"), "event_rows", "t x y z", ROW)
q("number_steps", "SELECT particle_id, t_idx, t FROM traj", lambda t: ranks.number_steps(t.event_rows().withColumn("_day", F.floor("t")), "particle_id", ["ts", "event_id"], "_day").select("particle_id", "t_idx", "t"), dbl="t", ints=ROW)
q("spread", "SELECT start_x, start_y, start_z, end_x, end_y, end_z, " + ", ".join(f"(end_{a}/start_{a}-1)*100 change_{a}" for a in "xyz") + f""", s/(d*n) mixing_efficiency FROM
 (SELECT stddev_pop(ax) start_x, stddev_pop(ay) start_y, stddev_pop(az) start_z, stddev_pop(bx) end_x, stddev_pop(b_y) end_y, stddev_pop(bz) end_z, sum(moved) s, count(*) n, max(tb)-min(ta) d FROM ({ENDS}))""",
  lambda t: paths.spread(t.traj()), dbl=" ".join(f"{n}_{a}" for n in ("start", "end", "change") for a in "xyz") + " mixing_efficiency")
q("step_variance", "SELECT t_idx, var_pop(x)+var_pop(y)+var_pop(z) variance FROM traj GROUP BY 1", lambda t: paths.step_variance(t.traj()), dbl="variance", ints="t_idx")
# pairs within 8 at the start, by brute force
MIX = f"""WITH e AS ({ENDS}), s AS (SELECT var_pop(ax)+var_pop(ay)+var_pop(az) v0, var_pop(bx)+var_pop(b_y)+var_pop(bz) v1, (stddev_pop(ax)+stddev_pop(ay)+stddev_pop(az))/3 s0, count(*) n, max(tb)-min(ta) d FROM e),
 p AS (SELECT sqrt((p.ax-q.ax)*(p.ax-q.ax)+(p.ay-q.ay)*(p.ay-q.ay)+(p.az-q.az)*(p.az-q.az)) d0, sqrt((p.bx-q.bx)*(p.bx-q.bx)+(p.b_y-q.b_y)*(p.b_y-q.b_y)+(p.bz-q.bz)*(p.bz-q.bz)) d1 FROM e p, e q WHERE p.particle_id < q.particle_id)
SELECT (v1-v0)/d variance_growth_rate, v1 final_variance, (SELECT count(*) FROM e, s WHERE moved < 0.1::DOUBLE*s0)/n return_ratio,
 coalesce((SELECT avg(ln(d1/d0)) FROM p WHERE d0 > 0 AND d0 < 8 AND d1 > 0)/d,0) separation_rate, (v1-v0)/d/(n*d) mixing_efficiency FROM s"""
q("mixing", MIX, lambda t: paths.mixing(t.traj(), 8.0), dbl="variance_growth_rate final_variance return_ratio separation_rate mixing_efficiency")


def _clusters_sql(k: int, rounds: int) -> str:
    """Farthest-first start and Lloyd's rounds for the three steps at once; centres are matched pair by pair."""
    gap = "((p.x-c.x)*(p.x-c.x)+(p.y-c.y)*(p.y-c.y)+(p.z-c.z)*(p.z-c.z))"
    ctes = [
        """tops AS (SELECT particle_id, max(t_idx) top FROM traj GROUP BY 1)""",
        """pts AS (SELECT s.step, t.particle_id, t.x, t.y, t.z FROM traj t JOIN tops USING (particle_id), (VALUES ('initial'), ('middle'), ('final')) s(step)
 WHERE t.t_idx = CASE s.step WHEN 'initial' THEN 0 WHEN 'middle' THEN (top+1)//2 ELSE top END)""",
        """f0 AS (SELECT step, 0 AS c, m.x x, m.y y, m.z z FROM (SELECT step, arg_min({'x': x, 'y': y, 'z': z}, particle_id) m FROM pts GROUP BY step))""",
    ]
    for i in range(1, k):
        far = f"(SELECT p.step, p.particle_id, p.x, p.y, p.z, min({gap}) d FROM pts p JOIN f{i - 1} c ON c.step=p.step GROUP BY ALL)"
        ctes.append(f"f{i} AS (SELECT * FROM f{i - 1} UNION ALL SELECT step, {i}, m.x, m.y, m.z FROM (SELECT step, arg_max({{'x': x, 'y': y, 'z': z}}, (d, -particle_id)) m FROM {far} GROUP BY step))")
    ctes[-1] = ctes[-1].replace(f"f{k - 1} AS (", "l0 AS (")
    for i in range(rounds + 1):
        ctes.append(f"a{i} AS (SELECT p.step, p.particle_id, p.x, p.y, p.z, arg_min(c.c, ({gap}, c.c)) c, sqrt(min({gap})) d FROM pts p JOIN l{i} c ON c.step=p.step GROUP BY ALL)")
        ctes.append(f"l{i + 1} AS (SELECT l.step, l.c, coalesce(m.x, l.x) x, coalesce(m.y, l.y) y, coalesce(m.z, l.z) z FROM l{i} l LEFT JOIN (SELECT step, c, avg(x) x, avg(y) y, avg(z) z FROM a{i} GROUP BY ALL) m USING (step, c))")
    # l{rounds} are the fitted centres, a{rounds} their points
    ctes.append(f"gaps AS (SELECT p.step, p.c i, c.c j, {gap} g FROM l{rounds} p, (SELECT * FROM l{rounds} WHERE step='initial') c WHERE p.step <> 'initial')")
    for n in range(k):
        free = "".join(f" AND NOT EXISTS (SELECT 1 FROM m{q} WHERE m{q}.step=gaps.step AND (m{q}.i=gaps.i OR m{q}.j=gaps.j))" for q in range(n))
        ctes.append(f"m{n} AS (SELECT step, b.i i, b.j j FROM (SELECT step, arg_min({{'i': i, 'j': j}}, (g, i, j)) b FROM gaps WHERE true{free} GROUP BY step))")
    ctes.append("same AS (" + " UNION ALL ".join(f"SELECT * FROM m{n}" for n in range(k)) + f" UNION ALL SELECT step, c, c FROM l{rounds} WHERE step='initial')")
    ctes.append(f"named AS (SELECT a.step, a.particle_id, s.j AS c, a.d FROM a{rounds} a JOIN same s ON s.step=a.step AND s.i=a.c)")
    ctes.append("sizes AS (SELECT step, c, count(*) n, avg(d) mean_distance FROM named GROUP BY ALL)")
    return f"""WITH {", ".join(ctes)} SELECT step, c AS "cluster", n, mean_distance, var_pop(n) OVER (PARTITION BY step) size_variance,
 (SELECT avg((a.c=b.c)::INT) FROM named a JOIN named b ON a.particle_id=b.particle_id WHERE a.step='initial' AND b.step='final') kept_share FROM sizes"""


q("clusters", _clusters_sql(4, 6), lambda t: paths.clusters(t.traj(), 4, 6), dbl="mean_distance size_variance kept_share", ints='"cluster" n')
q("frames", "SELECT CAST(floor(t_idx/4) AS BIGINT) frame, particle_id, x p, y q FROM traj WHERE t_idx%4=0 AND particle_id%2=0 AND particle_id IN (SELECT particle_id FROM (SELECT DISTINCT particle_id FROM traj WHERE particle_id%2=0) ORDER BY 1 LIMIT 20)",
  lambda t: paths.frames(t.traj(), "xy", 4, 2, 20).select("frame", "particle_id", "p", "q"), dbl="p q", ints="frame particle_id")
q("slice_plane", "SELECT particle_id, t_idx, t, x, 0.0::DOUBLE y, z FROM traj", lambda t: paths.slice_plane(t.traj(), "xz"), dbl="t x y z", ints=ROW)
q("step_report", f"""SELECT s.particle_id, s.t_idx, grouping(s.particle_id, s.t_idx) AS level, count(step_len) n, coalesce(sum(step_len),0) AS length
FROM (SELECT t.particle_id, t.t_idx, x.step_len FROM traj t LEFT JOIN ({STEP}) x USING (particle_id, t_idx)) s GROUP BY GROUPING SETS ((s.particle_id),(s.t_idx),())""",
  lambda t: paths.step_report(t.traj()), dbl="length", ints="particle_id t_idx level n", digits=4)


def _report_sql() -> str:
    names = ["duration", "n_steps", "n_particles", "n_rows", "dt_mean"]
    one = "SELECT *, duration/(n_steps-1) dt_mean FROM (SELECT max(t)-min(t) duration, count(DISTINCT t_idx) n_steps, count(DISTINCT particle_id) n_particles, count(*) n_rows FROM traj)"
    parts = [f"SELECT 'tracking' section, '{c}' metric, {c}::DOUBLE AS value FROM r1" for c in names]
    cols = STAT_COLS.split() + ["speed_mean", "speed_std", "speed_min", "speed_max"]
    parts += [f"SELECT 'statistics', '{c}', {c} FROM r2" for c in cols]
    spread = "SELECT " + ", ".join(f"stddev_pop({p}) {n}" for p, n in zip(("ax", "ay", "az", "bx", "b_y", "bz"), ("start_x", "start_y", "start_z", "end_x", "end_y", "end_z"))) + f", sum(moved)/((max(tb)-min(ta))*count(*)) mixing_efficiency FROM ({ENDS})"
    parts += [f"SELECT 'spread', '{n}_{a}', {n}_{a} FROM r3" for n in ("start", "end") for a in "xyz"]
    parts += [f"SELECT 'spread', 'change_{a}', (end_{a}/start_{a}-1)*100 FROM r3" for a in "xyz"] + ["SELECT 'spread', 'mixing_efficiency', mixing_efficiency FROM r3"]
    return f"WITH r1 AS ({one}), r2 AS ({STATS}), r3 AS ({spread}) " + " UNION ALL ".join(parts)


q("summary_report", _report_sql(), lambda t: paths.summary_report(t.traj()), dbl="value")

q("summary_report_sections", _report_sql() + """ UNION ALL SELECT 'field', 'n', count(*)::DOUBLE FROM series UNION ALL SELECT 'field', 'speed_max', max(sqrt(u*u+v*v+w*w)) FROM series
UNION ALL SELECT 'density', 'n', count(*)::DOUBLE FROM traj WHERE t_idx=0""",
  lambda t: paths.summary_report(
      t.traj(), field=sample.sampling_profile(t.samples()).select("n", "speed_max"), density=density.bandwidths(t.traj().filter("t_idx = 0")).select("n")
  ), "traj series", "value")
q("empty_trajectory", "SELECT p.particle_id, CAST(d.n AS BIGINT) t_idx, d.t, 0.0::DOUBLE x, 0.0::DOUBLE y, 0.0::DOUBLE z FROM (SELECT DISTINCT particle_id FROM traj) p, (SELECT t, row_number() OVER (ORDER BY t)-1 n FROM (SELECT DISTINCT floor(t)::DOUBLE t FROM traj)) d",
  lambda t: paths.empty_trajectory(t.spark, t.traj().select("particle_id"), t.traj().select(F.floor("t").alias("t"))), dbl="t x y z", ints=ROW)

# ---------------------------------------------------------------------------------------------------
# aggregates

q("segment_sum", "SELECT user_id segment, sum(value) total, count(*) n FROM events GROUP BY 1", lambda t: summary.segment_sum(t.raw("events"), "user_id", "value"), "", "total", "segment n")
q("segment_sum_dense", "SELECT s segment, coalesce(total,0) total, coalesce(n,0) n FROM (SELECT unnest(range((SELECT count(*) FROM part))) s) LEFT JOIN (SELECT user_id, sum(value) total, count(*) n FROM events GROUP BY 1) ON user_id=s",
  lambda t: summary.segment_sum(t.raw("events"), "user_id", "value", t.n_points()), "", "total", "segment n")
q("dense_ids", "SELECT o_custkey, dense_rank() OVER (ORDER BY o_custkey)-1 dense_id FROM (SELECT DISTINCT o_custkey FROM orders)",
  lambda t: summary.dense_ids(t.raw("orders"), "o_custkey", rows_per_range=200), "", "", "o_custkey dense_id")
q("cell_counts", "SELECT CAST(floor(x/20) AS BIGINT) cx, CAST(floor(y/20) AS BIGINT) cy, CAST(floor(z/2) AS BIGINT) cz, count(*) n FROM event_points GROUP BY 1,2,3",
  lambda t: cells.cell_counts(t.event_points().withColumn("z", F.col("z") * 10), (0.0, 0.0, 0.0), 20.0), "event_points", "", "cx cy cz n")
q("bounds", "SELECT " + ", ".join(f"min({a}) {a}_min, max({a}) {a}_max" for a in "xyz") + " FROM traj", lambda t: summary.bounds(t.traj()), dbl=" ".join(f"{a}_{m}" for a in "xyz" for m in ("min", "max")))
SNAP = "SELECT t_idx, count(*) n, avg(s) speed_mean, max(s) speed_max, min(s) speed_min, " + ", ".join(_four(c, c) for c in "uvw") + " FROM (SELECT *, sqrt(u*u+v*v+w*w) s FROM series) GROUP BY 1"
q("snapshot_stats", SNAP, lambda t: summary.snapshot_stats(t.samples()), "series", "speed_mean speed_max speed_min " + " ".join(f"{c}_{m}" for c in "uvw" for m in ("mean", "std", "min", "max")), "t_idx n")
q("series_check", "SELECT count(*) n_steps, min(n) n_min, max(n) n_max, min(n)=max(n) consistent FROM (SELECT t_idx, count(*) n FROM traj GROUP BY 1)", lambda t: summary.series_check(t.traj()), ints="n_steps n_min n_max")
DT = "SELECT t-lag(t) OVER (ORDER BY t_idx) dt FROM times"
q("step_interval_stats", f"SELECT avg(dt) dt_mean, stddev_pop(dt) dt_std, min(dt) dt_min, max(dt) dt_max, stddev_pop(dt) <= 1e-6 uniform FROM ({DT}) WHERE dt IS NOT NULL", lambda t: summary.step_interval_stats(t.times()), "times", "dt_mean dt_std dt_min dt_max")
q("time_bounds", "SELECT min(t) t_min, max(t) t_max, count(*) n_steps FROM times", lambda t: summary.time_bounds(t.times()), "times", "t_min t_max", "n_steps")
q("valid_times", "SELECT event_id, t BETWEEN (SELECT min(t) FROM times) AND (SELECT max(t) FROM times) valid FROM event_rows", lambda t: summary.valid_times(t.event_rows().select("event_id", "t"), t.times()).drop("t"), "event_rows times", "", "event_id")
q("grid_info", "SELECT max(i)-min(i)+1 n_i, max(j)-min(j)+1 n_j, max(k)-min(k)+1 n_k, count(*) n_nodes FROM grid", lambda t: summary.grid_info(t.grid()), "grid", "", "n_i n_j n_k n_nodes")


def _spoilt(t):
    """Some values that are no numbers, a time that runs back and one that is missing, nodes without a place."""
    samples = t.samples().withColumn("u", F.when(F.col("node_id") % 50 == 3, F.lit(float("nan"))).when(F.col("node_id") % 50 == 4, F.lit(None)).otherwise(F.col("u")))
    times = t.times().withColumn("t", F.when(F.col("t_idx") == 2, F.lit(None)).when(F.col("t_idx") == 4, F.lit(0.5)).otherwise(F.col("t")))
    nodes = t.nodes().withColumn("y", F.when(F.col("node_id") % 97 == 1, F.lit(float("inf"))).otherwise(F.col("y")))
    return samples, times, nodes


q("field_check", """SELECT (SELECT count(*) FROM series WHERE node_id%50 IN (3,4)) bad_values, (SELECT count(*) FROM times WHERE t_idx=2) bad_times,
 (SELECT count(*) FROM nodes WHERE node_id%97=1) bad_positions, (SELECT count(*) FROM (SELECT CASE WHEN t_idx=2 THEN NULL WHEN t_idx=4 THEN 0.5 ELSE t END < lag(CASE WHEN t_idx=2 THEN NULL WHEN t_idx=4 THEN 0.5 ELSE t END) OVER (ORDER BY t_idx) b FROM times) WHERE b) backward_times""",
  lambda t: summary.field_check(*_spoilt(t)), "series times nodes", "", "bad_values bad_times bad_positions backward_times")
q("size_estimate", "SELECT count(*) n_steps, max(n) rows_per_step, sum(n)*24 total_bytes, max(n)*24 step_bytes, greatest(floor(524288000/(max(n)*24)),1) steps_per_chunk FROM (SELECT t_idx, count(*) n FROM traj GROUP BY 1)",
  lambda t: summary.size_estimate(t.traj()), ints="n_steps rows_per_step total_bytes step_bytes steps_per_chunk")
