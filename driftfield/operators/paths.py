"""Trajectory analysis on traj(particle_id, t_idx, t, x, y, z[, u, v, w]).

First and last rows come from aggregates (one shuffle with partial results), steps from ``with_previous``,
which also splits a particle that owns a large share of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from driftfield.functions.vector import distance, flatten_axis, is_finite, magnitude, plane_project
from driftfield.model import AXES, check
from driftfield.operators.cells import Frame, _finite
from driftfield.operators.density import BLOCK, met_in_groups, squared_gaps
from driftfield.operators.ranks import first_rows, join_per_key, with_previous
from driftfield.session import cut_lineage

PID = "particle_id"
SPAN_ROWS = 65_536


def slice_time(traj: DataFrame, first: int, last: int) -> DataFrame:
    """Rows with first <= t_idx <= last (pruned by partition when the table is stored by t_idx)."""
    return traj.filter(F.col("t_idx").between(first, last))


def at_time(traj: DataFrame, t_idx: int) -> DataFrame:
    return traj.filter(F.col("t_idx") == t_idx)


def of_particle(traj: DataFrame, particle_id: int) -> DataFrame:
    return traj.filter(F.col(PID) == particle_id)


def slice_particles(traj: DataFrame, first: int, last: int) -> DataFrame:
    return traj.filter(F.col(PID).between(first, last))


def every_kth_step(traj: DataFrame, k: int) -> DataFrame:
    return traj.filter(F.col("t_idx") % k == 0)


def ends(traj: DataFrame) -> DataFrame:
    """First and last position and time per particle: (particle_id, ax..az, ta, bx..bz, tb, n)."""
    pack = F.struct("t", *AXES)
    agg = traj.groupBy(PID).agg(
        F.min_by(pack, "t_idx").alias("a"), F.max_by(pack, "t_idx").alias("b"), F.count(F.lit(1)).alias("n")
    )
    return agg.select(
        PID, *[F.col(f"a.{a}").alias(f"a{a}") for a in AXES], F.col("a.t").alias("ta"),
        *[F.col(f"b.{a}").alias(f"b{a}") for a in AXES], F.col("b.t").alias("tb"), "n",
    )


def _shift(p: str = "a", q: str = "b") -> Column:
    return distance(*[F.col(f"{q}{a}") for a in AXES], *[F.col(f"{p}{a}") for a in AXES])


def displacement(traj: DataFrame) -> DataFrame:
    """(particle_id, displacement) from first to last row."""
    return ends(traj).select(PID, _shift().alias("displacement"))


def steps(traj: DataFrame, span_rows: int = SPAN_ROWS) -> DataFrame:
    """Every row with its step from the row before: step_len and step_dt (NULL on first rows)."""
    df = with_previous(traj, PID, "t_idx", ["t", *AXES], span_rows)
    d = distance(*[F.col(a) for a in AXES], *[F.col(f"prev.{a}") for a in AXES])
    return df.withColumns({"step_len": d, "step_dt": F.col("t") - F.col("prev.t")}).drop("prev")


def path_length(traj: DataFrame, span_rows: int = SPAN_ROWS) -> DataFrame:
    """(particle_id, path_length): sum of the step lengths."""
    return steps(traj, span_rows).groupBy(PID).agg(F.coalesce(F.sum("step_len"), F.lit(0.0)).alias("path_length"))


def speeds(traj: DataFrame, span_rows: int = SPAN_ROWS) -> DataFrame:
    """(particle_id, t_idx, speed). With u, v, w columns: their length, last row left out; else step length / step time.

    Without velocities the speed of a step is listed at the step's end row.
    """
    if set("uvw") <= set(traj.columns):
        last = traj.groupBy(PID).agg(F.max("t_idx").alias("_last"))
        speed = magnitude(F.col("u"), F.col("v"), F.col("w"))
        return join_per_key(traj, last, PID).filter(F.col("t_idx") < F.col("_last")).select(PID, "t_idx", speed.alias("speed"))
    moved = steps(traj, span_rows).filter(F.col("step_len").isNotNull())
    return moved.select(PID, "t_idx", (F.col("step_len") / F.greatest(F.col("step_dt"), F.lit(1e-12))).alias("speed"))


def time_step_mean(traj: DataFrame) -> DataFrame:
    """One row: duration, mean step, number of particles, steps and rows."""
    return traj.agg(
        (F.max("t") - F.min("t")).alias("duration"),
        F.count_distinct("t_idx").alias("n_steps"),
        F.count_distinct(PID).alias("n_particles"),
        F.count(F.lit(1)).alias("n_rows"),
    ).withColumn("dt_mean", F.when(F.col("n_steps") > 1, F.col("duration") / (F.col("n_steps") - 1)).otherwise(F.lit(0.0)))


def accelerations(traj: DataFrame, span_rows: int = SPAN_ROWS) -> DataFrame:
    """(particle_id, t_idx, acceleration): length of the velocity change over the particle's mean time step."""
    mean_dt = ends(traj).select(PID, F.when(F.col("n") > 1, (F.col("tb") - F.col("ta")) / (F.col("n") - 1)).alias("_dt"))
    df = with_previous(traj, PID, "t_idx", list("uvw"), span_rows)
    change = magnitude(*[F.col(c) - F.col(f"prev.{c}") for c in "uvw"])
    return (
        join_per_key(df.filter(F.col("prev").isNotNull()), mean_dt, PID)
        .select(PID, "t_idx", (change / F.greatest(F.col("_dt"), F.lit(1e-12))).alias("acceleration"))
    )


def from_start(traj: DataFrame) -> DataFrame:
    """Every row with its distance ``moved`` from the particle's first position."""
    first = ends(traj).select(PID, *[f"a{a}" for a in AXES])
    d = distance(*[F.col(a) for a in AXES], *[F.col(f"a{a}") for a in AXES])
    return join_per_key(traj, first, PID).withColumn("moved", d).drop(*[f"a{a}" for a in AXES])


def convergence(traj: DataFrame, at_least: int = 0) -> DataFrame:
    """One row: mean and max final displacement and the mean of each particle's largest one. Fewer than ``at_least`` steps: status only."""
    per = from_start(traj).groupBy(PID).agg(F.max_by("moved", "t_idx").alias("final"), F.max("moved").alias("top"))
    out = per.agg(
        F.count(F.lit(1)).alias("n_particles"), F.avg("final").alias("mean_final"), F.max("final").alias("max_final"), F.avg("top").alias("mean_max"),
    ).withColumn("n_steps", traj.agg(F.count_distinct("t_idx")).scalar())
    enough = F.col("n_steps") >= at_least
    return out.select(
        F.when(enough, F.lit("success")).otherwise(F.lit("insufficient_data")).alias("status"), "n_steps", "n_particles",
        *[F.when(enough, F.col(c)).alias(c) for c in ("mean_final", "max_final", "mean_max")],
    )


def _four(c: str, name: str) -> list[Column]:
    return [F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std"), F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max")]


def trajectory_stats(traj: DataFrame, span_rows: int = SPAN_ROWS) -> DataFrame:
    """One row: displacement, path length and speed {mean, std, min, max}, and the bounds.

    Steps are summed per particle first. The spread of all speeds is the mean of the particles' own variances plus that of their means
    about the common one, so nothing is lost to cancellation.
    """
    pack = F.struct("t", *AXES)
    stepped = steps(traj, span_rows).withColumn("_v", F.col("step_len") / F.greatest(F.col("step_dt"), F.lit(1e-12)))
    per = stepped.groupBy(PID).agg(
        F.min_by(pack, "t_idx").alias("a"), F.max_by(pack, "t_idx").alias("b"),
        F.coalesce(F.sum("step_len"), F.lit(0.0)).alias("path"),
        F.count("_v").alias("vn"), F.avg("_v").alias("vm"), F.var_pop("_v").alias("vv"),
        F.min("_v").alias("vlo"), F.max("_v").alias("vhi"), F.count(F.lit(1)).alias("n"),
        *[f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))],
    )
    moved = distance(*[F.col(f"b.{a}") for a in AXES], *[F.col(f"a.{a}") for a in AXES])
    per = cut_lineage(per)  # one row per particle, read for the common mean and again
    total = per.agg(F.sum("vn").alias("n"), F.sum(F.col("vn") * F.col("vm")).alias("s")).first()
    mean = F.lit(total["s"] / total["n"] if total["n"] else None).cast("double")
    spread = F.sum(F.col("vn") * (F.col("vv") + (F.col("vm") - mean) * (F.col("vm") - mean))) / F.sum("vn")
    return per.withColumn("moved", moved).agg(
        F.count(F.lit(1)).alias("n_particles"), F.sum("n").alias("n_rows"),
        *_four("moved", "displacement"), *_four("path", "path_length"),
        F.max(mean).alias("speed_mean"),
        F.sqrt(spread).alias("speed_std"),
        F.min("vlo").alias("speed_min"), F.max("vhi").alias("speed_max"),
        *[f(f"{n}{a}").alias(f"{a}_{m}") for a in AXES for n, m, f in (("lo", "min", F.min), ("hi", "max", F.max))],
    )


def trajectory_check(traj: DataFrame, span_rows: int = SPAN_ROWS) -> DataFrame:
    """One row: rows that are not finite, steps whose particle count differs from step 0, backward steps, smallest dt, valid."""
    check(traj, "traj")
    finite = F.lit(True)
    for a in AXES:
        finite = finite & is_finite(F.col(a))
    base = steps(traj, span_rows).agg(
        F.count_if(~finite).alias("n_not_finite"), F.count_if(F.col("step_dt") < 0).alias("n_backward"),
        F.count_if(F.col("step_dt") < 1e-10).alias("n_tiny_dt"), F.min("step_dt").alias("min_dt"),
    )
    sizes = traj.groupBy("t_idx").agg(F.count(F.lit(1)).alias("n"))
    uneven = sizes.withColumn("_n0", sizes.agg(F.min_by("n", "t_idx")).scalar()).agg(F.count_if(F.col("n") != F.col("_n0")))
    return base.withColumn("n_uneven_steps", uneven.scalar()).withColumn(
        "valid", (F.col("n_not_finite") == 0) & (F.col("n_backward") == 0) & (F.col("n_uneven_steps") == 0) & (F.col("n_tiny_dt") == 0)
    )


def merge_time(a: DataFrame, b: DataFrame) -> DataFrame:
    """Append b after a in time; both must hold the same particles (else ValueError)."""
    ids_a, ids_b = a.select(PID).distinct(), b.select(PID).distinct()
    odd = ids_a.join(ids_b, PID, "left_anti").union(ids_b.join(ids_a, PID, "left_anti"))
    if not odd.isEmpty():
        raise ValueError("the tables hold different particles")
    shift = a.agg((F.max("t_idx") + 1).alias("s")).first()["s"] or 0
    first = b.agg(F.min("t_idx").alias("m")).first()["m"] or 0
    cols = [c for c in a.columns if c in b.columns]
    return a.select(*cols).unionByName(b.withColumn("t_idx", F.col("t_idx") - first + shift).select(*cols))


def merge_particles(a: DataFrame, b: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Put b's particles beside a's with new ids; step times must agree within tol (else ValueError)."""
    ta = a.groupBy("t_idx").agg(F.min("t").alias("ta"))
    tb = b.groupBy("t_idx").agg(F.min("t").alias("tb"))
    bad = ta.join(tb, "t_idx", "full").filter(F.col("ta").isNull() | F.col("tb").isNull() | (F.abs(F.col("ta") - F.col("tb")) > tol))
    if not bad.isEmpty():
        raise ValueError("the tables hold different times")
    shift = a.agg((F.max(PID) + 1).alias("s")).first()["s"] or 0
    cols = [c for c in a.columns if c in b.columns]
    return a.select(*cols).unionByName(b.withColumn(PID, F.col(PID) + shift).select(*cols))


def empty_trajectory(spark, particles: "int | DataFrame", stamps: "list[float] | DataFrame") -> DataFrame:
    """Zero positions for every particle at every time: particles 0 to n - 1 or a table's distinct ``particle_id``; times listed or a table's
    distinct ``t`` in order (one number per step, kept in one array)."""
    if isinstance(particles, int):
        particles = spark.range(particles).select(F.col("id").alias(PID))
    listed = F.lit([float(t) for t in stamps]) if isinstance(stamps, list) else stamps.agg(F.array_sort(F.collect_set(F.col("t").cast("double"))).alias("s")).scalar()
    df = particles.select(F.col(PID).cast("bigint").alias(PID)).distinct().withColumn("_t", listed)
    df = df.select(PID, F.posexplode("_t").alias("t_idx", "t"))
    return df.select(PID, F.col("t_idx").cast("bigint"), "t", *[F.lit(0.0).alias(a) for a in AXES])


def trajectory_from_points(rows: DataFrame, particle: str | None = None, step: str = "t_idx", time: str | None = None) -> DataFrame:
    """Rows that carry their step (and particle) as a trajectory; no particle column means one particle, no time the step."""
    pid = F.col(particle).cast("bigint") if particle else F.lit(0).cast("bigint")
    t = F.col(time).cast("double") if time else F.col(step).cast("double")
    z = F.col("z").cast("double") if "z" in rows.columns else F.lit(0.0)
    return rows.select(pid.alias(PID), F.col(step).cast("bigint").alias("t_idx"), t.alias("t"), F.col("x").cast("double"), F.col("y").cast("double"), z.alias("z"))


def spread(traj: DataFrame) -> DataFrame:
    """One row: std per axis at start and end, change in percent, mixing = sum of displacements / (duration * particles)."""
    e = ends(traj).withColumn("moved", _shift())
    out = e.agg(
        *[F.stddev_pop(f"{p}{a}").alias(f"{n}_{a}") for p, n in (("a", "start"), ("b", "end")) for a in AXES],
        F.sum("moved").alias("_sum"), F.count(F.lit(1)).alias("_n"), (F.max("tb") - F.min("ta")).alias("_d"),
    )
    change = [
        F.when(F.col(f"start_{a}") > 0, (F.col(f"end_{a}") / F.col(f"start_{a}") - 1) * 100).alias(f"change_{a}") for a in AXES
    ]
    mixing = F.when(F.col("_d") > 0, F.col("_sum") / (F.col("_d") * F.col("_n"))).otherwise(F.lit(0.0))
    return out.select(*[f"{n}_{a}" for n in ("start", "end") for a in AXES], *change, mixing.alias("mixing_efficiency"))


def step_variance(traj: DataFrame) -> DataFrame:
    """(t_idx, variance): population variance of positions over the particles, summed over the axes."""
    v = sum((F.var_pop(a) for a in AXES[1:]), F.var_pop("x"))
    return traj.groupBy("t_idx").agg(v.alias("variance"))


def _separations(e: DataFrame, close: float, rows: int = BLOCK) -> DataFrame:
    """(s, n) per group: sum of ln(d1 / d0) and number of the ordered pairs with 0 < d0 < close at the start and d1 > 0 at the end.

    Particles with equal start and end are one row with their number. Particles released at one point (d0 = 0) never meet each other.
    """
    known = e.filter(F.col(PID).isNotNull()).select(*[F.col(f"a{a}").alias(a) for a in AXES], *[F.col(f"b{a}").alias(f"e{a}") for a in AXES]).na.drop()
    ours = (*AXES, "ex", "ey", "ez", "n")
    same = cut_lineage(_finite(known).groupBy(*ours[:-1]).agg(F.count(F.lit(1)).cast("double").alias("n")))
    theirs = ("bx", "by", "bz", "fx", "fy", "fz", "m")
    balls = same.select(*[F.col(c).alias(o) for c, o in zip(ours, theirs)]).withColumns({"_radius": F.lit(float(close)), "level": F.lit(0)})
    frame = Frame((0.0, 0.0, 0.0), close * (1.0 + 2e-9) + 2e-12)

    def separations(left, right):
        import numpy as np
        import pyarrow as pa

        cols = lambda t, names: np.stack([t.column(c).to_numpy() for c in names])
        q, qe, p, pe = cols(left, AXES), cols(left, ours[3:6]), cols(right, theirs[:3]), cols(right, theirs[3:6])
        qn, pn = left.column("n").to_numpy(), right.column("m").to_numpy()
        s = n = 0.0
        for lo in range(0, q.shape[1], 32):
            for first in range(0, p.shape[1], 2048):
                at, by = slice(lo, lo + 32), slice(first, first + 2048)
                d0 = np.sqrt(squared_gaps(q[:, at, None], p[:, None, by]))
                i, j = ((d0 > 0.0) & (d0 < close)).nonzero()
                d1 = np.sqrt(squared_gaps(qe[:, lo + i], pe[:, first + j]))
                # as in SQL, NaN is not dropped
                apart = ~(d1 <= 0.0)
                i, j, d1 = i[apart], j[apart], d1[apart]
                weight = qn[lo + i] * pn[first + j]
                s += float((weight * np.log(d1 / d0[i, j])).sum())
                n += float(weight.sum())
        return pa.table({"s": [s], "n": [n]}, pa.schema([("s", pa.float64()), ("n", pa.float64())]))

    return met_in_groups(balls, same, frame, [0], rows, ours, theirs, separations, "s double, n double")


def mixing(traj: DataFrame, close: float = 0.1, return_share: float = 0.1) -> DataFrame:
    """One row: variance growth rate, final variance, return ratio, close-pair separation rate, efficiency.

    Close pairs (0 < d0 < close at the start) meet in cells as arrays; no row is made for a pair. Start and
    end are each particle's own first and last row.
    """
    e = cut_lineage(ends(traj).withColumn("moved", _shift()))
    stats = e.agg(
        sum((F.var_pop(f"a{a}") for a in AXES[1:]), F.var_pop("ax")).alias("v0"),
        sum((F.var_pop(f"b{a}") for a in AXES[1:]), F.var_pop("bx")).alias("v1"),
        (sum((F.stddev_pop(f"a{a}") for a in AXES[1:]), F.stddev_pop("ax")) / 3).alias("s0"),
        F.count(F.lit(1)).alias("n"), (F.max("tb") - F.min("ta")).alias("d"),
    )
    near = F.lit(return_share) * F.col("_s0")
    returned = e.withColumn("_s0", stats.select("s0").scalar()).agg(F.count_if(F.col("moved") < near))
    sums = cut_lineage(_separations(e, close)).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    rate = sums.select(F.when(F.col("n") > 0, F.col("s") / F.col("n")))
    growth = F.when(F.col("d") > 0, (F.col("v1") - F.col("v0")) / F.col("d")).otherwise(F.lit(0.0))
    both = stats.withColumns({"_r": returned.scalar(), "_l": rate.scalar()})
    return both.select(
        growth.alias("variance_growth_rate"), F.col("v1").alias("final_variance"), (F.col("_r") / F.col("n")).alias("return_ratio"),
        F.coalesce(F.col("_l") / F.col("d"), F.lit(0.0)).alias("separation_rate"),
        (growth / (F.col("n") * F.col("d"))).alias("mixing_efficiency"),
    )


def kmeans_centers(points: DataFrame, k: int, id_col: str, rounds: int = 50) -> list[list[float]]:
    """Centres of at most k clusters of ``points(id, x, y, z)``, deterministic: only the centres come to the driver.

    The first centre is the point with the lowest id, each further one the point farthest from those before (ties: lowest id). Then points go to
    their nearest centre (ties: the earlier one) and centres to their mean, until no centre moves or ``rounds`` are over. A centre that loses
    all points stays. Points without coordinates take no part.
    """
    points = points.filter(_has_place())
    at = F.struct(*AXES)
    first = points.agg(F.min_by(at, id_col)).first()[0]
    if first is None:
        return []
    centers = [[first[a] for a in AXES]]
    while len(centers) < k:
        far = points.withColumn("_d", F.array_min(_gaps(centers))).filter("_d > 0").agg(F.max_by(at, F.struct("_d", -F.col(id_col)))).first()[0]
        if far is None:
            break
        centers.append([far[a] for a in AXES])
    for _ in range(rounds):
        sums = points.groupBy(_nearest_center(centers).alias("c")).agg(*[F.avg(a).alias(a) for a in AXES]).collect()  # k rows
        moved = {r["c"]: [r[a] for a in AXES] for r in sums}
        new = [moved.get(i, c) for i, c in enumerate(centers)]
        if new == centers:
            break
        centers = new
    return centers


def _has_place() -> Column:
    return reduce(lambda a, b: a & b, [is_finite(F.col(a)) for a in AXES])


def _gaps(centers: list[list[float]]) -> Column:
    """Squared distances to the centres."""
    return F.array(*[sum(((F.col(a) - F.lit(float(v))) * (F.col(a) - F.lit(float(v))) for a, v in zip(AXES, c)), F.lit(0.0)) for c in centers])


def _nearest_center(centers: list[list[float]]) -> Column:
    """Number of the nearest centre, the earlier one on ties."""
    gaps = _gaps(centers)
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")


def clusters(traj: DataFrame, k: int = 5, rounds: int = 50) -> DataFrame:
    """(step, cluster, n, mean_distance, size_variance, kept_share): k-means at the first, middle and last step.

    Steps are each particle's own first, middle and last row. Centres of later fits are matched to those
    of the first fit greedily by distance, so ``kept_share`` compares like with like. For the fit see ``kmeans_centers``.
    """
    per = traj.groupBy(PID).agg(F.max("t_idx").alias("_top"))
    tagged = join_per_key(traj, per, PID)
    picks = {"initial": F.col("t_idx") == 0, "middle": F.col("t_idx") == F.floor((F.col("_top") + 1) / 2), "final": F.col("t_idx") == F.col("_top")}
    labelled, first_centers = {}, None
    for step, cond in picks.items():
        # every round of the fit reads the points again: they are written once
        pts = cut_lineage(tagged.filter(cond & _has_place()).select(PID, *[F.col(a).cast("double").alias(a) for a in AXES]))
        centers = kmeans_centers(pts, k, PID, rounds)
        if not centers:
            labelled[step] = pts.select(PID, F.lit(0).alias("cluster"), F.lit(0.0).alias("d")).limit(0)
            continue
        if first_centers is None:
            first_centers, match = centers, list(range(len(centers)))
        else:
            match = _match(centers, first_centers)
        d = F.sqrt(F.array_min(_gaps(centers)))
        labelled[step] = pts.select(PID, F.element_at(F.lit(match), _nearest_center(centers) + 1).alias("cluster"), d.alias("d"))
    kept = labelled["initial"].join(labelled["final"].select(PID, F.col("cluster").alias("_end")), PID)
    share = kept.agg(F.avg((F.col("cluster") == F.col("_end")).cast("double"))).scalar()
    out = None
    for step, df in labelled.items():
        rows = df.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_distance"))
        rows = rows.withColumn("size_variance", rows.agg(F.var_pop("n")).scalar()).withColumn("step", F.lit(step))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("kept_share", share).select("step", "cluster", "n", "mean_distance", "size_variance", "kept_share")


def _match(centers, base) -> list[int]:
    """Number of the base centre each centre is closest to, every base centre used once."""
    gaps = sorted((sum((p - q) ** 2 for p, q in zip(c, b)), i, j) for i, c in enumerate(centers) for j, b in enumerate(base))
    out, used = {}, set()
    for _, i, j in gaps:
        if i not in out and j not in used:
            out[i] = j
            used.add(j)
    return [out.get(i, i) for i in range(len(centers))]


def frames(traj: DataFrame, plane: str | None = None, every: int = 1, particle_step: int = 1, cap: int | None = None) -> DataFrame:
    """(frame, particle) rows for plotting: every k-th step, every k-th particle, at most ``cap`` particles."""
    df = every_kth_step(traj, every).filter(F.col(PID) % particle_step == 0)
    if cap is not None:
        ids = first_rows(df.select(PID).distinct(), PID, cap)
        df = df.join(ids, PID, "left_semi")
    df = df.withColumn("frame", F.floor(F.col("t_idx") / every))
    return plane_project(df, plane) if plane else df


def slice_plane(traj: DataFrame, plane: str = "xy") -> DataFrame:
    """Trajectory with the coordinate outside the plane set to 0."""
    return flatten_axis(traj, plane)


def summary_report(traj: DataFrame, span_rows: int = SPAN_ROWS, **sections: DataFrame) -> DataFrame:
    """(section, metric, value): tracking, statistics and spread as one long table.

    ``sections`` are further tables of one row, e.g. ``field=sample.sampling_profile(samples)`` or ``density=density.bandwidths(points)``.
    """

    def long(df: DataFrame, section: str) -> DataFrame:
        cols = df.columns
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])
        return df.select(F.lit(section).alias("section"), F.inline(pairs))

    one = long(time_step_mean(traj), "tracking")
    two = long(trajectory_stats(traj, span_rows).drop("n_particles", "n_rows"), "statistics")
    three = long(spread(traj), "spread")
    parts = [one, two, three, *[long(df, name) for name, df in sections.items()]]
    return reduce(DataFrame.unionByName, parts)


def step_report(traj: DataFrame, span_rows: int = SPAN_ROWS) -> DataFrame:
    """Step length sums per particle, per step and overall in one pass: (particle_id, t_idx, level, n, length)."""
    s = steps(traj, span_rows)
    return s.groupingSets([["particle_id"], ["t_idx"], []], "particle_id", "t_idx").agg(
        F.grouping_id().alias("level"), F.count("step_len").alias("n"), F.coalesce(F.sum("step_len"), F.lit(0.0)).alias("length")
    )
