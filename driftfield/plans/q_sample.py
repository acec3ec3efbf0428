"""Queries: field sampling in time and space (J), displacement and movement (I)."""

from __future__ import annotations



from pyspark.sql import functions as F

from driftfield.functions import analytic, shape as sh
from driftfield.functions.vector import magnitude
from driftfield.model import Box
from driftfield.operators import cells, move, rules, sample as smp
from driftfield.plans.fixtures import BOX, META
from driftfield.plans.registry import query

# ---------------------------------------------------------------------------------------------------
# time


def _event_times(t):
    """Query times from every event: some fall before, between, on and after the snapshots."""
    return t.event_rows().select(F.col("event_id").alias("id"), (F.floor(F.col("t") * 2) / 7 - 1.0).alias("t"))


TIMES_SQL = "SELECT event_id id, floor(t*2)/7-1 t FROM event_rows"

BRACKET_SQL = f"""
SELECT q.id, q.t, l.t_idx AS "left", l.r AS "right",
       CASE {{low}} {{high}} ELSE 1-(q.t-l.t)/(l.t1-l.t) END w_left,
       CASE {{low2}} {{high2}} ELSE (q.t-l.t)/(l.t1-l.t) END w_right
FROM (SELECT *, least(greatest(t,(SELECT min(t) FROM times)),(SELECT max(t) FROM times)-1e-7) tc FROM ({TIMES_SQL})) q
ASOF JOIN (SELECT * FROM (SELECT t_idx, t, lead(t_idx) OVER (ORDER BY t) r, lead(t) OVER (ORDER BY t) t1 FROM times) WHERE t1 IS NOT NULL) l ON q.tc >= l.t"""

LO, HI = "WHEN q.t < (SELECT min(t) FROM times) THEN", "WHEN q.t > (SELECT max(t) FROM times) THEN"


def _bracket_sql(mode: str) -> str:
    if mode == "linear":
        return BRACKET_SQL.format(low="WHEN false THEN 0", high="", low2="WHEN false THEN 0", high2="")
    a, b, c, d = {"constant": ("1", "0", "0", "1"), "zero": ("0",) * 4, "nan": ("NULL",) * 4}[mode]
    return BRACKET_SQL.format(low=f"{LO} {a}", high=f"{HI} {b}", low2=f"{LO} {c}", high2=f"{HI} {d}")


for _mode in smp.EXTRAPOLATE:
    query(f"time_bracket_{_mode}", _bracket_sql(_mode), "event_rows times", "t w_left w_right", "id left right".replace("left right", '"left" "right"'))(
        lambda t, m=_mode: smp.time_bracket(_event_times(t), t.times(), m)
    )


def _grid_times(t):
    """Distinct query times of the events."""
    return _event_times(t).select("t").distinct()


def _interp_sql(mode: str) -> str:
    """Hat functions over the snapshots: an independent form of linear interpolation."""
    inner = f"""
SELECT q.t, s.node_id, sum(greatest(0, 1-abs(q.tc-s.t))*s.u) u, sum(greatest(0, 1-abs(q.tc-s.t))*s.v) v, sum(greatest(0, 1-abs(q.tc-s.t))*s.w) w
FROM (SELECT DISTINCT t, {"t" if mode != "constant" else "least(greatest(t,0),(SELECT max(t) FROM times))"} tc FROM ({TIMES_SQL})) q
JOIN series s ON abs(q.tc-s.t) < 1 GROUP BY 1,2"""
    if mode == "constant":
        return inner
    gone = {"zero": "0", "nan": "NULL"}[mode]
    outside = "(t < 0 OR t > (SELECT max(t) FROM times))"
    return f"""
SELECT q.t, n.node_id, {", ".join(f"CASE WHEN {outside.replace('t <', 'q.t <').replace('t >', 'q.t >')} THEN {gone} ELSE i.{c} END {c}" for c in "uvw")}
FROM (SELECT DISTINCT t FROM ({TIMES_SQL})) q CROSS JOIN nodes n LEFT JOIN ({inner}) i ON i.t=q.t AND i.node_id=n.node_id"""


for _mode in ("constant", "zero", "nan"):
    query(f"interp_time_{_mode}", _interp_sql(_mode), "event_rows times series nodes", "t u v w", "node_id")(
        lambda t, m=_mode: smp.interp_time(t.samples(), t.times(), _grid_times(t), outside=m)
    )

query(
    "interp_time_linear_extrapolation",
    f"""SELECT q.t, a.node_id, a.u+(q.t-a.t)*(b.u-a.u) u, a.v+(q.t-a.t)*(b.v-a.v) v, a.w+(q.t-a.t)*(b.w-a.w) w
FROM (SELECT DISTINCT t, CAST(least(greatest(floor(t),0),(SELECT max(t_idx) FROM times)-1) AS BIGINT) n FROM ({TIMES_SQL})) q
JOIN series a ON a.t_idx=q.n JOIN series b ON b.t_idx=q.n+1 AND b.node_id=a.node_id""",
    "event_rows times series", "t u v w", "node_id",
)(lambda t: smp.interp_time(t.samples(), t.times(), _grid_times(t), outside="linear"))

query(
    "interp_time_nearest",
    f"""SELECT q.t, s.node_id, s.u, s.v, s.w FROM
(SELECT t, t_idx FROM (SELECT q.t, x.t_idx, row_number() OVER (PARTITION BY q.t ORDER BY abs(x.t-q.t), x.t_idx) n
 FROM (SELECT DISTINCT t FROM ({TIMES_SQL})) q, times x) WHERE n=1) q JOIN series s USING (t_idx)""",
    "event_rows times series", "t u v w", "node_id",
)(lambda t: smp.interp_time(t.samples(), t.times(), _grid_times(t), method="nearest"))

query(
    "time_derivative",
    """SELECT a.node_id, (b.u-a.u)/1 u, (b.v-a.v)/1 v, (b.w-a.w)/1 w FROM series a JOIN series b USING (node_id) WHERE a.t_idx=2 AND b.t_idx=3""",
    "series", "u v w", "node_id",
)(lambda t: smp.time_derivative(t.samples(), t.times(), 2.5, 0.25))

def _spline_basis_weights(at: list[float]) -> str:
    """VALUES (t, t_idx, weight) of the not-a-knot spline over 0..6, by its truncated powers: the first and last inner times are no knots."""
    import numpy as np

    basis = lambda x: np.array([1.0, x, x * x, x**3, *[max(x - k, 0.0) ** 3 for k in (2, 3, 4)]])
    solve = np.linalg.inv(np.array([basis(float(x)) for x in range(7)]))
    return ", ".join(f"({t}::DOUBLE, {i}, {w!r}::DOUBLE)" for t in at for i, w in enumerate((basis(min(max(t, 0.0), 6.0)) @ solve).tolist()))


_AT = [0.0, 0.1317, 0.5739, 2.0, 2.2913, 5.9371, 6.0, 7.5]
query(
    "interp_time_cubic",
    f"SELECT q.t, s.node_id, sum(wt*u) u, sum(wt*v) v, sum(wt*s.w) w FROM series s JOIN (VALUES {_spline_basis_weights(_AT)}) q(t, t_idx, wt) ON q.t_idx=s.t_idx GROUP BY 1, 2",
    "series", "t u v w", "node_id", digits=9,  # some values end at half of the sixth digit
)(lambda t: smp.interp_time_cubic(t.samples(), t.times(), _AT))


def _spline_values(at: str) -> str:
    """The same spline at any table (id, node_id, t), its truncated powers and their solution as tables."""
    import numpy as np

    basis = lambda x: np.array([1.0, x, x * x, x**3, *[max(x - k, 0.0) ** 3 for k in (2, 3, 4)]])
    solve = np.linalg.inv(np.array([basis(float(x)) for x in range(7)]))
    held = "least(greatest(t, 0), 6)"
    powers = ["1.0::DOUBLE", held, f"{held}*{held}", f"{held}*{held}*{held}", *[f"pow(greatest({held}-{k}, 0), 3)" for k in (2, 3, 4)]]
    factors = ", ".join(f"({b}, {i}, {solve[b, i]!r}::DOUBLE)" for b in range(7) for i in range(7)).replace("np.float64(", "").replace(")::DOUBLE", "::DOUBLE")
    return f"""SELECT q.id, q.node_id, sum(q.p*f.v*s.u) u, sum(q.p*f.v*s.v) v, sum(q.p*f.v*s.w) w
FROM (SELECT id, node_id, unnest([{", ".join(powers)}]) p, unnest(range(7)) b FROM ({at})) q
JOIN (VALUES {factors}) f(b, i, v) ON f.b=q.b JOIN series s ON s.t_idx=f.i AND s.node_id=q.node_id GROUP BY 1, 2"""


def _node_visits(t):
    """Every event visits a node at its own time, some of them at exact snapshots and beyond both ends."""
    events = t.event_rows().select(F.col("event_id").alias("id"), (F.col("event_id") % 990).alias("node_id"), F.when(F.col("event_id") % 5 == 0, F.floor(F.col("t") * 10) % 9 - 1).otherwise(F.col("t") / 4).cast("double").alias("t"))
    return smp.sample_cubic(events, smp.spline_table(t.samples(), t.times()), t.times()).select("id", "node_id", *"uvw")


query(
    "sample_cubic",
    _spline_values("SELECT event_id id, event_id % 990 node_id, CASE WHEN event_id % 5 = 0 THEN floor(t*10)::BIGINT % 9 - 1 ELSE t/4 END::DOUBLE t FROM event_rows"),
    "event_rows series", "u v w", "id node_id", digits=9,
)(_node_visits)



def _cubic_in_time(t):
    """Nodal values that are cubic polynomials of time: a cubic spline has to reproduce them between the snapshots."""
    nodes = t.node_values().select("node_id", *"uvw")
    tt = F.col("t")
    rows = t.samples().select("t_idx", "t", "node_id").join(nodes, "node_id")
    return rows.select("t_idx", "t", "node_id", (F.col("u") * tt * tt * tt - F.col("v") * tt).alias("u"), (F.col("v") * tt * tt + 1.0).alias("v"), (F.col("w") * (3.0 - tt)).alias("w"))


query(
    "interp_time_cubic_exact",
    "SELECT q.t, node_id, u*q.t*q.t*q.t-v*q.t u, v*q.t*q.t+1 v, w*(3-q.t) w FROM node_values, (VALUES (0.1::DOUBLE),(2.3::DOUBLE),(5.7::DOUBLE)) q(t)",
    "node_values", "t u v w", "node_id",
)(lambda t: smp.interp_time_cubic(_cubic_in_time(t), t.times(), [0.1, 2.3, 5.7]))

query(
    "nearest_time_step",
    f"""SELECT t, t_idx FROM (SELECT q.t, x.t_idx, row_number() OVER (PARTITION BY q.t ORDER BY abs(x.t-q.t), x.t_idx) n
 FROM (SELECT DISTINCT t FROM ({TIMES_SQL})) q, times x) WHERE n=1""",
    "event_rows times", "t", "t_idx",
)(lambda t: smp.nearest_time(_grid_times(t), t.times()))

# ---------------------------------------------------------------------------------------------------
# grids


def tri(src: str, values: str = "node_values", mode: str = "clamp", keep: str = "p.id", extra_on: str = "") -> str:
    """Trilinear interpolation as tent functions over the nodes around a point."""
    if mode == "periodic":
        g = {a: f"({a}-{n}*floor({a}/{n}))" for a, n in zip("xyz", META.shape)}
    else:
        g = {a: f"least(greatest({a},0),{n - 1})" for a, n in zip("xyz", META.shape)}
    node = {a: f"(floor({g[a]})+d{a})" for a in "xyz"}
    if mode == "periodic":
        node = {a: f"(CASE WHEN floor({g[a]})+d{a} >= {n} THEN 0 ELSE floor({g[a]})+d{a} END)" for a, n in zip("xyz", META.shape)}
    weight = "*".join(f"(1-abs({g[a]}-(floor({g[a]})+d{a})))" for a in "xyz")
    on = " AND ".join(f"n.{i}={node[a]}" for a, i in zip("xyz", "ijk"))
    inside = " AND ".join(f"any_value({a}) BETWEEN 0 AND {n - 1}" for a, n in zip("xyz", META.shape))
    val = lambda c: f"coalesce(sum(({weight})*n.{c}),0)"
    if mode in ("zero", "nan"):
        gone = "0" if mode == "zero" else "NULL"
        val0 = val
        val = lambda c: f"CASE WHEN {inside} THEN {val0(c)} ELSE {gone} END"
    return f"""
SELECT {keep}, {val('u')} u, {val('v')} v, {val('w')} w
FROM (SELECT * FROM {src}, (SELECT unnest([0,1]) dx), (SELECT unnest([0,1]) dy), (SELECT unnest([0,1]) dz)) p
LEFT JOIN (SELECT {'' if values != 'series' else 't_idx, '}i, j, k, u, v, w FROM {values}) n ON {on} {extra_on}
GROUP BY {keep}"""


for _mode in ("clamp", "zero", "nan", "periodic"):
    query(f"trilinear_sample_{_mode}", tri("wide_points", mode=_mode), "wide_points node_values", "u v w", "id")(
        lambda t, m=_mode: smp.trilinear_sample(t.wide_points().select("id", "x", "y", "z"), t.grid(), META, m).select("id", "u", "v", "w")
    )

query(
    "trilinear_sample_items",
    f"""SELECT s.x, s.y, s.z, n, u, v, w FROM (SELECT x, y, z, count(*) n FROM item_points GROUP BY 1,2,3) c
JOIN ({tri("(SELECT DISTINCT x, y, z FROM item_points)", keep="p.x, p.y, p.z")}) s USING (x, y, z)""",
    "item_points node_values", "x y z u v w", "n",
)(
    lambda t: smp.trilinear_sample(t.item_points(), t.grid(), META).groupBy("x", "y", "z").agg(
        F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in "uvw"]
    )
)


def _timed_points(t):
    return t.points().withColumn("t", F.col("id") % 97 / 12.0 - 0.5).drop("mass")


TIMED = "(SELECT id, x, y, z, (id%97)/12.0::DOUBLE-0.5::DOUBLE t FROM points)"
SERIES_TRI = f"""
WITH q AS (SELECT id, x, y, z, least(greatest(t,0),6) t FROM {TIMED}),
     l AS (SELECT id, x, y, z, t, CAST(least(floor(t),5) AS BIGINT) t_idx FROM q),
     a AS ({tri("l", "series", keep="p.id, p.t, p.t_idx", extra_on="AND n.t_idx=p.t_idx")}),
     r AS (SELECT id, x, y, z, t, t_idx+1 t_idx FROM l),
     b AS ({tri("r", "series", keep="p.id, p.t, p.t_idx", extra_on="AND n.t_idx=p.t_idx")})
SELECT a.id, a.u+(a.t-a.t_idx)*(b.u-a.u) u, a.v+(a.t-a.t_idx)*(b.v-a.v) v, a.w+(a.t-a.t_idx)*(b.w-a.w) w FROM a JOIN b USING (id)"""

query("grid_series_sample", SERIES_TRI, "points series", "u v w", "id")(
    lambda t: smp.sample_grid_series(_timed_points(t), t.series().drop("t", "node_id"), t.times(), META).select("id", "u", "v", "w")
)

query(
    "cell_corners",
    "SELECT a.i ci, a.j cj, a.k ck, a.u u0, b.u u7, c.v v5, d.w w2 FROM node_values a JOIN node_values b ON b.i=a.i+1 AND b.j=a.j+1 AND b.k=a.k+1 JOIN node_values c ON c.i=a.i+1 AND c.j=a.j AND c.k=a.k+1 JOIN node_values d ON d.i=a.i AND d.j=a.j+1 AND d.k=a.k",
    "node_values", "u0 u7 v5 w2", "ci cj ck",
)(lambda t: smp.cell_corners(t.grid(), META).select("ci", "cj", "ck", "u0", "u7", "v5", "w2"))

query("grid_from_rows", "SELECT i, j, k, u, v, w FROM node_values", "node_values", "u v w", "i j k")(
    lambda t: smp.grid_from_rows(t.node_values(), META)
)
query("grid_from_flat", "SELECT i, j, k, u, v, w FROM node_values", "node_values", "u v w", "i j k")(
    lambda t: smp.grid_from_flat(t.node_values(), META.shape)
)

# ---------------------------------------------------------------------------------------------------
# scattered nodes

NEAREST = """SELECT id, node_id, u, v, w FROM (SELECT p.id, n.node_id, n.u, n.v, n.w,
 row_number() OVER (PARTITION BY p.id ORDER BY sqrt((p.x-n.x)*(p.x-n.x)+(p.y-n.y)*(p.y-n.y)+(p.z-n.z)*(p.z-n.z)), n.node_id) r FROM {src} p, node_values n) WHERE r=1"""

query("nearest_node_sample", NEAREST.format(src="wide_points"), "wide_points node_values", "u v w", "id node_id")(
    lambda t: smp.nearest_node_sample(t.wide_points().select("id", "x", "y", "z"), t.node_values(), t.node_values()).select("id", "node_id", "u", "v", "w")
)

KNN = """SELECT q_id, p_id, d, rank FROM (SELECT a.id q_id, b.id p_id, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) d,
 row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), b.id) rank FROM {a} a, {b} b) WHERE rank <= {k}"""

query("knn_cloud", KNN.format(a="cloud", b="cloud", k=8), "cloud", "d", "q_id p_id rank")(lambda t: cells.knn(t.cloud(), t.cloud(), 8))
query("knn_parts_nodes", KNN.format(a="points", b="(SELECT node_id id, x, y, z FROM nodes)", k=4), "points nodes", "d", "q_id p_id rank")(
    lambda t: cells.knn(t.points(), t.nodes().withColumnRenamed("node_id", "id"), 4)
)
query("knn_events", KNN.format(a="points", b="event_points", k=3), "points event_points", "d", "q_id p_id rank")(
    lambda t: cells.knn(t.points(), t.event_points(), 3)
)

RADIUS = """SELECT a.id q_id, b.id p_id, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) d FROM {a} a, {b} b
 WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= {r}"""

query("radius_join_cloud", RADIUS.format(a="cloud", b="cloud", r="0.1::DOUBLE"), "cloud", "d", "q_id p_id")(
    lambda t: cells.radius_join(t.cloud(), t.cloud(), 0.1)
)
query("radius_join_parts", RADIUS.format(a="points", b="points", r="0.7::DOUBLE"), "points", "d", "q_id p_id")(
    lambda t: cells.radius_join(t.points(), t.points(), 0.7)
)
query(
    "neighbour_counts",
    f"SELECT p.id, coalesce(n,0) n_near FROM points p LEFT JOIN (SELECT q_id, count(*) n FROM ({RADIUS.format(a='points', b='event_points', r='2.0::DOUBLE')}) GROUP BY 1) ON q_id=p.id",
    "points event_points", "", "id n_near",
)(lambda t: cells.neighbour_counts(t.points(), t.event_points(), 2.0))

# ---------------------------------------------------------------------------------------------------
# elements




def _triangle_cols():
    """Barycentric weights of every point in the triangle over its own floor cell of the x-y plane."""
    p = [F.col("x"), F.col("y"), F.lit(0.0)]
    a = [F.floor("x").cast("double"), F.floor("y").cast("double"), F.lit(0.0)]
    b = [a[0] + 2.0, a[1], F.lit(0.0)]
    c = [a[0], a[1] + 2.0, F.lit(0.0)]
    return sh.bary_triangle(p, a, b, c)


query(
    "bary_triangle",
    "SELECT id, 1-(x-floor(x))/2-(y-floor(y))/2 l1, (x-floor(x))/2 l2, (y-floor(y))/2 l3 FROM points",
    "points", "l1 l2 l3", "id",
)(lambda t: t.points().select("id", *[c.alias(n) for c, n in zip(_triangle_cols(), ("l1", "l2", "l3"))]))

query(
    "bary_tetra",
    "SELECT id, 1-(x-floor(x))/3-(y-floor(y))/4-(z-floor(z))/5 l1, (x-floor(x))/3 l2, (y-floor(y))/4 l3, (z-floor(z))/5 l4 FROM points",
    "points", "l1 l2 l3 l4", "id",
)(
    lambda t: t.points().withColumns({f"f{a}": F.floor(a).cast("double") for a in "xyz"}).select(
        "id",
        *[
            c.alias(f"l{n + 1}")
            for n, c in enumerate(
                sh.bary_tetra(
                    [F.col("x"), F.col("y"), F.col("z")], [F.col("fx"), F.col("fy"), F.col("fz")],
                    [F.col("fx") + 3, F.col("fy"), F.col("fz")], [F.col("fx"), F.col("fy") + 4, F.col("fz")], [F.col("fx"), F.col("fy"), F.col("fz") + 5],
                )
            )
        ],
    )
)

# In this mesh a point's tetrahedron follows from the order of its fractions; only the touching cells and
# orders that hold it (ties included) compete, and the lowest element id wins.
IN_TET = """
SELECT id, min(elem_id) elem_id FROM (
 SELECT p.id, e.elem_id, {det} FROM {src} p JOIN (SELECT t.*, a.x ax,a.y ay,a.z az,b.x bx,b.y b_y,b.z bz,c.x cx,c.y cy,c.z cz,d.x dx,d.y dy,d.z dz
   FROM tets t JOIN nodes a ON a.node_id=n0 JOIN nodes b ON b.node_id=n1 JOIN nodes c ON c.node_id=n2 JOIN nodes d ON d.node_id=n3) e
 ON p.x BETWEEN ax-1e-4 AND dx+1e-4 AND p.y BETWEEN ay-1e-4 AND dy+1e-4 AND p.z BETWEEN az-1e-4 AND dz+1e-4)
WHERE least(l1,l2,l3,l4) >= -1e-6 GROUP BY id"""


def _order_weights() -> str:
    """Path from corner 0 to corner 3 along the axes: weights are differences of sorted fractions."""
    fa = "(p.x-ax)*(bx-ax)+(p.y-ay)*(b_y-ay)+(p.z-az)*(bz-az)"
    fb = "(p.x-ax)*(cx-bx)+(p.y-ay)*(cy-b_y)+(p.z-az)*(cz-bz)"
    fc = "(p.x-ax)*(dx-cx)+(p.y-ay)*(dy-cy)+(p.z-az)*(dz-cz)"
    return f"1-({fa}) l1, ({fa})-({fb}) l2, ({fb})-({fc}) l3, ({fc}) l4"


def _in_tet(src: str, keep: str = "") -> str:
    return IN_TET.format(src=src, det=_order_weights())


query("point_in_element", _in_tet("wide_points"), "wide_points tets nodes", "", "id elem_id")(
    lambda t: smp.point_in_element(t.wide_points(), t.tets(), t.nodes(), "tet4").select("id", "elem_id")
)

FEM_INSIDE = f"""
SELECT p.id, h.elem_id, w.l1*a.u+w.l2*b.u+w.l3*c.u+w.l4*d.u u, w.l1*a.v+w.l2*b.v+w.l3*c.v+w.l4*d.v v, w.l1*a.w+w.l2*b.w+w.l3*c.w+w.l4*d.w w
FROM wide_points p JOIN ({_in_tet("wide_points")}) h USING (id) JOIN tets t USING (elem_id)
JOIN node_values a ON a.node_id=n0 JOIN node_values b ON b.node_id=n1 JOIN node_values c ON c.node_id=n2 JOIN node_values d ON d.node_id=n3,
LATERAL (SELECT (p.x-a.x)*(b.x-a.x)+(p.y-a.y)*(b.y-a.y)+(p.z-a.z)*(b.z-a.z) fa, (p.x-a.x)*(c.x-b.x)+(p.y-a.y)*(c.y-b.y)+(p.z-a.z)*(c.z-b.z) fb,
 (p.x-a.x)*(d.x-c.x)+(p.y-a.y)*(d.y-c.y)+(p.z-a.z)*(d.z-c.z) fc) f, LATERAL (SELECT 1-fa l1, fa-fb l2, fb-fc l3, fc l4) w"""


def _fem_sql(fallback: str) -> str:
    if fallback == "zero":
        rest = "SELECT id, NULL::BIGINT elem_id, 0.0 u, 0.0 v, 0.0 w FROM wide_points WHERE id NOT IN (SELECT id FROM hit)"
    else:
        rest = f"SELECT id, NULL::BIGINT elem_id, u, v, w FROM ({NEAREST.format(src='wide_points')}) WHERE id NOT IN (SELECT id FROM hit)"
    return f"WITH hit AS ({FEM_INSIDE}) SELECT id, elem_id, u, v, w FROM hit UNION ALL {rest}"


for _f in ("nearest_node", "zero"):
    query(f"fem_sample_tet4_{_f}", _fem_sql(_f), "wide_points tets nodes node_values", "u v w", "id elem_id")(
        lambda t, f=_f: smp.fem_sample(t.wide_points(), t.tets(), t.nodes(), t.node_values(), "tet4", f)
    )

CENTROIDS = """SELECT elem_id, (a.x+b.x+c.x+d.x)/4 mx, (a.y+b.y+c.y+d.y)/4 my, (a.z+b.z+c.z+d.z)/4 mz
FROM tets JOIN nodes a ON a.node_id=n0 JOIN nodes b ON b.node_id=n1 JOIN nodes c ON c.node_id=n2 JOIN nodes d ON d.node_id=n3"""

query(
    "element_boxes",
    """SELECT elem_id, least(a.x,b.x,c.x,d.x) lo_x, greatest(a.z,b.z,c.z,d.z) hi_z, (a.x+b.x+c.x+d.x)/4 m_x, (a.y+b.y+c.y+d.y)/4 m_y
FROM tets JOIN nodes a ON a.node_id=n0 JOIN nodes b ON b.node_id=n1 JOIN nodes c ON c.node_id=n2 JOIN nodes d ON d.node_id=n3""",
    "tets nodes", "lo_x hi_z m_x m_y", "elem_id",
)(lambda t: smp.element_boxes(smp.element_corners(t.tets(), t.nodes(), "tet4")).select("elem_id", "lo_x", "hi_z", "m_x", "m_y"))

CENTROID_D = f"""
SELECT p.id, min(sqrt((p.x-mx)*(p.x-mx)+(p.y-my)*(p.y-my)+(p.z-mz)*(p.z-mz))) d FROM points p, ({CENTROIDS}) GROUP BY p.id"""


def _centroid_distance(t):
    """Distance to the centroid that was picked (ids of exact ties depend on rounding, distances do not)."""
    pts = t.points()
    centers = smp.element_boxes(smp.element_corners(t.tets(), t.nodes(), "tet4")).select("elem_id", "m_x", "m_y", "m_z")
    near = smp.nearest_centroid_element(pts, t.tets(), t.nodes(), "tet4").select("id", "elem_id")
    d = magnitude(*[F.col(a) - F.col(f"m_{a}") for a in "xyz"])
    return pts.join(near, "id").join(centers, "elem_id").select("id", d.alias("d"))


query("nearest_centroid_element", CENTROID_D, "points tets nodes", "d", "id")(_centroid_distance)


def _linear_values(t):
    """Nodal values of a linear field: every linear element has to reproduce it."""
    return t.nodes().withColumns({"u": F.col("x") + 2 * F.col("y") - F.col("z"), "v": F.lit(3.0) - F.col("x"), "w": F.col("z") * 0.5})


LINEAR = "SELECT id, x+2*y-z u, 3-x v, z*0.5::DOUBLE w FROM points"
query("centroid_sample_tet4", LINEAR, "points", "u v w", "id")(
    lambda t: smp.centroid_sample(t.points(), t.tets(), t.nodes(), _linear_values(t), "tet4")
)
query("fem_sample_linear_exact", LINEAR, "points", "u v w", "id")(
    lambda t: smp.fem_sample(t.points(), t.tets(), t.nodes(), _linear_values(t), "tet4").select("id", "u", "v", "w")
)


def _quadratic_mesh(t):
    """Ten-node tetrahedra: corners as in the mesh, mid-edge nodes numbered by their corner pair."""
    tets, nodes = t.tets(), t.nodes()
    n = F.col("nodes")
    key = lambda i, j: F.lit(1_000_000) + F.least(n[i], n[j]) * 1000 + F.greatest(n[i], n[j])
    quad = tets.select("elem_id", F.concat(n, F.array(*[key(i, j) for i, j in sh.TET10_EDGES])).alias("nodes"))
    mids = tets.select(F.explode(F.array(*[F.struct(key(i, j).alias("node_id"), F.least(n[i], n[j]).alias("a"), F.greatest(n[i], n[j]).alias("b")) for i, j in sh.TET10_EDGES])).alias("m")).select("m.*").distinct()
    pa = nodes.select(F.col("node_id").alias("a"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    pb = nodes.select(F.col("node_id").alias("b"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    mid = mids.join(pa, "a").join(pb, "b").select("node_id", *[((F.col(f"a{c}") + F.col(f"b{c}")) / 2).alias(c) for c in "xyz"])
    return quad, nodes.select("node_id", "x", "y", "z").unionByName(mid)


def _quad_values(nodes):
    return nodes.withColumns({"u": F.col("x") * F.col("y"), "v": F.col("z") * F.col("z"), "w": F.col("x") - F.col("y") * F.col("z")})


def _fem_tet10(t):
    quad, nodes = _quadratic_mesh(t)
    return smp.fem_sample(t.points(), quad, nodes, _quad_values(nodes), "tet10").select("id", "u", "v", "w")


query("fem_sample_tet10", "SELECT id, x*y u, z*z v, x-y*z w FROM points", "points", "u v w", "id")(_fem_tet10)


def _triangles(t, quadratic: bool):
    """Two triangles per cell of the k = 0 plane, with mid-edge nodes if quadratic."""
    flat = t.nodes().filter(F.col("k") == 0)
    c = flat.filter((F.col("i") < 9) & (F.col("j") < 10))
    at = lambda di, dj: ((F.col("i") + di) * 11 + F.col("j") + dj) * 9
    both = F.array(F.array(at(0, 0), at(1, 0), at(1, 1)), F.array(at(0, 0), at(1, 1), at(0, 1)))
    tri = c.select("i", "j", F.posexplode(both).alias("ord", "nodes")).select(((F.col("i") * 10 + F.col("j")) * 2 + F.col("ord")).alias("elem_id"), "nodes")
    nodes = flat.select("node_id", "x", "y", "z")
    if not quadratic:
        return tri, nodes
    n = F.col("nodes")
    key = lambda i, j: F.lit(1_000_000) + F.least(n[i], n[j]) * 1000 + F.greatest(n[i], n[j])
    mids = tri.select(F.explode(F.array(*[F.struct(key(i, j).alias("node_id"), F.least(n[i], n[j]).alias("a"), F.greatest(n[i], n[j]).alias("b")) for i, j in sh.TRI6_EDGES])).alias("m")).select("m.*").distinct()
    pa = nodes.select(F.col("node_id").alias("a"), *[F.col(x).alias(f"a{x}") for x in "xyz"])
    pb = nodes.select(F.col("node_id").alias("b"), *[F.col(x).alias(f"b{x}") for x in "xyz"])
    mid = mids.join(pa, "a").join(pb, "b").select("node_id", *[((F.col(f"a{x}") + F.col(f"b{x}")) / 2).alias(x) for x in "xyz"])
    return tri.select("elem_id", F.concat(n, F.array(*[key(i, j) for i, j in sh.TRI6_EDGES])).alias("nodes")), nodes.unionByName(mid)


def _fem_tri(t, quadratic: bool):
    tri, nodes = _triangles(t, quadratic)
    pts = t.points().withColumn("z", F.lit(0.0))
    values = nodes.withColumns({"u": F.col("x") * F.col("y") if quadratic else F.col("x") + F.col("y"), "v": F.col("x") - 2 * F.col("y"), "w": F.lit(1.0)})
    return smp.fem_sample(pts, tri, nodes, values, "tri6" if quadratic else "tri3").select("id", "u", "v", "w")


query("fem_sample_tri3", "SELECT id, x+y u, x-2*y v, 1.0::DOUBLE w FROM points", "points", "u v w", "id")(lambda t: _fem_tri(t, False))
query("fem_sample_tri6", "SELECT id, x*y u, x-2*y v, 1.0::DOUBLE w FROM points", "points", "u v w", "id")(lambda t: _fem_tri(t, True))

query(
    "shape_functions",
    """SELECT id, a*(2*a-1) s0, b*(2*b-1) s1, 4*a*b s3, 4*b*c s4, 4*c*a s5 FROM (SELECT id, (y%1.0)/2 a, (x%1.0)/2 b, 1-(y%1.0)/2-(x%1.0)/2 c FROM points)""",
    "points", "s0 s1 s3 s4 s5", "id",
)(
    lambda t: t.points().withColumns({"a": F.col("y") % 1.0 / 2, "b": F.col("x") % 1.0 / 2}).select(
        "id", *[c.alias(f"s{n}") for n, c in enumerate(sh.tri6_shapes([F.col("a"), F.col("b"), F.lit(1.0) - F.col("a") - F.col("b")])) if n != 2]
    )
)


def _pseudo(t):
    """The nodes each point took, by their distances (which ids share a distance is decided by rounding)."""
    found = smp.pseudo_elements(t.points(), t.nodes(), "tet4")
    at = t.nodes().select("node_id", *[F.col(a).alias(f"n{a}") for a in "xyz"])
    long = found.select("id", F.posexplode("nodes").alias("rank", "node_id")).join(at, "node_id").join(t.points().drop("mass"), "id")
    return long.select("id", "rank", magnitude(*[F.col(a) - F.col(f"n{a}") for a in "xyz"]).alias("d"))


query(
    "pseudo_elements",
    """SELECT id, rank, d FROM (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d)-1 AS rank FROM
 (SELECT p.id, sqrt((p.x-n.x)*(p.x-n.x)+(p.y-n.y)*(p.y-n.y)+(p.z-n.z)*(p.z-n.z)) d FROM points p, nodes n)) WHERE rank < 4""",
    "points nodes", "d", "id rank",
)(_pseudo)


def _broken_mesh(t):
    """Elements of line items' cells, some of them a node short, over the nodes with few line items left out."""
    few = t.node_values().filter("u > 0.05").select("node_id")
    short = F.when(F.col("elem_id") % 7 == 0, F.slice("nodes", 1, 3)).otherwise(F.col("nodes"))
    return t.tets().select("elem_id", short.alias("nodes")), t.nodes().join(few, "node_id", "left_anti")


query(
    "mesh_check",
    """SELECT (SELECT count(*) FROM tets) n_elements, (SELECT count(*) FROM tets WHERE elem_id%7=0) n_wrong_width,
 (SELECT count(*) FROM (SELECT unnest(CASE WHEN elem_id%7=0 THEN [n0,n1,n2] ELSE [n0,n1,n2,n3] END) n FROM tets) JOIN node_values ON node_id=n WHERE u > 0.05) n_dangling""",
    "tets node_values", "", "n_elements n_wrong_width n_dangling",
)(lambda t: smp.mesh_check(*_broken_mesh(t), "tet4"))


def _element_cells(t):
    """Cells of side 2 per element: an element of side 1 touches one or two of them per axis."""
    boxes = smp.element_boxes(smp.element_corners(t.tets(), t.nodes(), "tet4"))
    frame = cells.Frame((0.0, 0.0, 0.0), 2.0)
    return smp.element_cells(boxes, frame).select("elem_id", "level", "cx", "cy", "cz")


query(
    "element_cells",
    """SELECT elem_id, 0 AS level, cx, cy, cz FROM (SELECT t.elem_id, n.i, n.j, n.k FROM tets t JOIN nodes n ON n.node_id=t.n0),
 LATERAL (SELECT DISTINCT floor((i+e)/2)::BIGINT cx FROM (VALUES (-1e-4::DOUBLE), (1+1e-4::DOUBLE)) v(e)),
 LATERAL (SELECT DISTINCT floor((j+e)/2)::BIGINT cy FROM (VALUES (-1e-4::DOUBLE), (1+1e-4::DOUBLE)) v(e)),
 LATERAL (SELECT DISTINCT floor((k+e)/2)::BIGINT cz FROM (VALUES (-1e-4::DOUBLE), (1+1e-4::DOUBLE)) v(e))""",
    "tets nodes", "", "elem_id level cx cy cz",
)(_element_cells)
query(
    "sampling_profile",
    f"""SELECT count(*) n, avg(s) speed_mean, stddev_pop(s) speed_std, min(s) speed_min, max(s) speed_max, avg(u) u_mean, stddev_pop(u) u_std, avg(v) v_mean, stddev_pop(v) v_std, avg(w) w_mean, stddev_pop(w) w_std,
 count(*) n_finite, 0 n_nan, 0 n_infinite FROM (SELECT *, sqrt(u*u+v*v+w*w) s FROM ({SERIES_TRI}))""",
    "points series", "speed_mean speed_std speed_min speed_max u_mean u_std v_mean v_std w_mean w_std", "n n_finite n_nan n_infinite",
)(lambda t: smp.sampling_profile(smp.sample_grid_series(_timed_points(t), t.series().drop("t", "node_id"), t.times(), META)))


def _boxes(t, shift: float, size: float):
    return t.points().select("id", *[(F.col(a) + shift).alias(f"lo_{a}") for a in "xyz"], *[(F.col(a) + shift + size + F.col("id") % 3 * 0.25).alias(f"hi_{a}") for a in "xyz"])


def _box_sql(shift: str, size: str) -> str:
    cols = ", ".join(f"{a}+{shift} lo_{a}, {a}+{shift}+{size}+(id%3)*0.25::DOUBLE hi_{a}" for a in "xyz")
    return f"(SELECT id, {cols} FROM points)"


def _mixed_boxes(t, shift: float, size: float):
    """The same, but every hundredth box is as large as the domain."""
    big = F.col("id") % 100 == 0
    return _boxes(t, shift, size).withColumns({f"hi_{a}": F.when(big, F.col(f"lo_{a}") + 12.0).otherwise(F.col(f"hi_{a}")) for a in "xyz"})


_MIXED = "(SELECT * REPLACE ({cols}) FROM {src})"
_mixed_sql = lambda src: _MIXED.format(src=src, cols=", ".join(f"CASE WHEN id%100=0 THEN lo_{a}+12 ELSE hi_{a} END AS hi_{a}" for a in "xyz"))
query(
    "box_intersects_mixed",
    f"SELECT a.id a_id, b.id b_id FROM {_mixed_sql(_box_sql('0.0::DOUBLE', '0.3::DOUBLE'))} a, {_mixed_sql(_box_sql('0.1::DOUBLE', '0.2::DOUBLE'))} b WHERE "
    + " AND ".join(f"a.lo_{x}<=b.hi_{x} AND b.lo_{x}<=a.hi_{x}" for x in "xyz"),
    "points", "", "a_id b_id",
)(lambda t: cells.box_intersections(_mixed_boxes(t, 0.0, 0.3), _mixed_boxes(t, 0.1, 0.2), cells.Frame.of(BOX)))

query(
    "box_intersects",
    f"SELECT a.id a_id, b.id b_id FROM {_box_sql('0.0::DOUBLE', '0.3::DOUBLE')} a, {_box_sql('0.1::DOUBLE', '0.2::DOUBLE')} b WHERE "
    + " AND ".join(f"a.lo_{x}<=b.hi_{x} AND b.lo_{x}<=a.hi_{x}" for x in "xyz"),
    "points", "", "a_id b_id",
)(lambda t: cells.box_intersections(_boxes(t, 0.0, 0.3), _boxes(t, 0.1, 0.2), cells.Frame.of(BOX)))

# ---------------------------------------------------------------------------------------------------
# movement


def _stage_sql(n: int, prev: str, expr: str) -> str:
    cols = ", ".join(f"{expr.format(a=a, q=q)} {a}" for a, q in zip("xyz", "uvw"))
    return f"p{n} AS (SELECT s.id, {cols} FROM {prev}), k{n} AS ({tri(f'p{n}')})"


def displace_sql(method: str, dt: str = "2.0::DOUBLE") -> str:
    ctes = [f"k1 AS ({tri('points')})"]
    if method != "euler":
        ctes.append(_stage_sql(2, "points s JOIN k1 USING (id)", f"s.{{a}}+0.5::DOUBLE*{dt}*k1.{{q}}"))
    if method == "rk4":
        ctes.append(_stage_sql(3, "points s JOIN k2 USING (id)", f"s.{{a}}+0.5::DOUBLE*{dt}*k2.{{q}}"))
        ctes.append(_stage_sql(4, "points s JOIN k3 USING (id)", f"s.{{a}}+{dt}*k3.{{q}}"))
    slope = {"euler": "k1.{q}", "rk2": "k2.{q}", "rk4": "(k1.{q}+2*k2.{q}+2*k3.{q}+k4.{q})/6"}[method]
    joins = {"euler": "JOIN k1 USING (id)", "rk2": "JOIN k2 USING (id)", "rk4": "JOIN k1 USING (id) JOIN k2 USING (id) JOIN k3 USING (id) JOIN k4 USING (id)"}[method]
    cols = ", ".join(f"s.{a}+{dt}*{slope.format(q=q)} {a}" for a, q in zip("xyz", "uvw"))
    return f"WITH {', '.join(ctes)} SELECT s.id, {cols} FROM points s {joins}"


def _wrapped(sql: str) -> str:
    cols = ", ".join(f"{a}-{hi}*floor({a}/{hi}) {a}" for a, _, hi in BOX.axes())
    return f"SELECT id, {cols} FROM ({sql})"


def _field(t):
    return move.GridField(t.grid(), META)


query("displace_euler", displace_sql("euler"), "points node_values", "x y z", "id")(lambda t: move.displace(t.points().drop("mass"), _field(t), 2.0, "euler"))
query("displace_rk2", displace_sql("rk2"), "points node_values", "x y z", "id")(lambda t: move.displace(t.points().drop("mass"), _field(t), 2.0, "rk2"))
query("displace_rk4", _wrapped(displace_sql("rk4")), "points node_values", "x y z", "id")(
    lambda t: rules.wrap_periodic(BOX)(move.displace(t.points().drop("mass"), _field(t), 2.0, "rk4")).drop("status")
)
query("displace_per_point_dt", displace_sql("rk2", "(1+s.id%5)").replace("points s", "points s"), "points node_values", "x y z", "id")(
    lambda t: move.displace(t.points().drop("mass").withColumn("dt", (F.col("id") % 5 + 1).cast("double")), _field(t), "dt", "rk2").drop("dt")
)

STEP_FROM_SERIES = f"""
WITH a AS ({tri("points", "(SELECT * FROM series WHERE t_idx=1)").replace("SELECT t_idx, i", "SELECT i")}), b AS ({tri("points", "(SELECT * FROM series WHERE t_idx=2)").replace("SELECT t_idx, i", "SELECT i")})
SELECT p.id, p.x+2*(a.u+0.3::DOUBLE*(b.u-a.u)) x, p.y+2*(a.v+0.3::DOUBLE*(b.v-a.v)) y, p.z+2*(a.w+0.3::DOUBLE*(b.w-a.w)) z FROM points p JOIN a USING (id) JOIN b USING (id)"""
query("displace_series_euler", STEP_FROM_SERIES, "points series", "x y z", "id")(
    lambda t: move.displace(t.points().drop("mass"), move.GridSeriesField(t.series().drop("t", "node_id"), t.times(), META), 2.0, "euler", 1.3)
)


def _mirrored(sql: str) -> str:
    """Reflection into the box as a triangle wave."""
    cols = ", ".join(f"abs({a}-{2 * hi}*floor({a}/{2 * hi}+0.5::DOUBLE)) {a}" for a, _, hi in BOX.axes())
    return f"SELECT id, {cols} FROM ({sql})"


RK4_TWICE = f"""WITH s1 AS ({_mirrored(displace_sql('rk4'))}), s2 AS ({_mirrored(displace_sql('rk4').replace('points', 's1'))})
SELECT id particle_id, 0 t_idx, 0.0::DOUBLE t, x, y, z FROM points UNION ALL SELECT id, 1, 2.0, x, y, z FROM s1 UNION ALL SELECT id, 2, 4.0, x, y, z FROM s2"""
query("advect_rk4_reflect", RK4_TWICE, "points node_values", "t x y z", "particle_id t_idx")(
    lambda t: move.advect(t.points(), _field(t), 2.0, 2, "rk4", rules.reflect(BOX))
)

TWO_STEPS = f"""WITH RECURSIVE s1 AS ({displace_sql('euler')}),
 s2 AS ({displace_sql('euler').replace('points', 's1')})
SELECT id particle_id, 0 t_idx, 0.0::DOUBLE t, x, y, z FROM points UNION ALL SELECT id, 1, 2.0, x, y, z FROM s1 UNION ALL SELECT id, 2, 4.0, x, y, z FROM s2"""

for _plan in ("broadcast", "joins"):
    query(f"advect_euler_{_plan}", TWO_STEPS, "points node_values", "t x y z", "particle_id t_idx")(
        lambda t, p=_plan: move.advect(t.points(), _field(t), 2.0, 2, "euler", plan=p)
    )

EULER_ROTATION = """WITH RECURSIVE w(particle_id, t_idx, x, y, z) AS (
 SELECT id, 0, x, y, z FROM points UNION ALL SELECT particle_id, t_idx+1, x-(1/23.0::DOUBLE)*y, y+(1/23.0::DOUBLE)*x, z FROM w WHERE t_idx < 30)
SELECT particle_id, t_idx, t_idx*(1/23.0::DOUBLE) t, x, y, z FROM w"""

query("advect_analytic", EULER_ROTATION, "points", "t x y z", "particle_id t_idx")(
    lambda t: move.advect(t.points(), move.AnalyticField(analytic.rotation()), 1 / 23.0, 30, "euler")
)
def _chain(step, first: int, last: int) -> str:
    """CTEs s1 .. sN, each the table after one more step of the table before."""
    return ", ".join(f"s{n} AS MATERIALIZED ({step(n, 'points' if n == 1 else f's{n - 1}')})" for n in range(first, last + 1))


def _recorded(steps, dt: float) -> str:
    return " UNION ALL ".join(f"SELECT id particle_id, {n} t_idx, {n * dt}::DOUBLE t, x, y, z FROM {f's{n}' if n else 'points'}" for n in steps)


def _rk4_on(src: str, dt: float) -> str:
    return displace_sql("rk4", f"{dt}::DOUBLE").replace("points", src)


query(
    "advect_rk4_steps",
    f"WITH {_chain(lambda n, src: _mirrored(_rk4_on(src, 0.5)), 1, 20)} {_recorded(range(0, 21, 5), 0.5)}",
    "points node_values", "t x y z", "particle_id t_idx", digits=5,
)(lambda t: move.advect(t.points(), _field(t), 0.5, 20, "rk4", rules.reflect(BOX), record_every=5))
def _values_at(t: float) -> str:
    """Node values at a time between two snapshots."""
    left = min(int(t), 5)
    cols = ", ".join(f"a.{c}+{t - left!r}::DOUBLE*(b.{c}-a.{c}) {c}" for c in "uvw")
    return f"(SELECT a.node_id, a.i, a.j, a.k, a.i::DOUBLE x, a.j::DOUBLE y, a.k::DOUBLE z, {cols} FROM series a JOIN series b ON b.node_id=a.node_id AND b.t_idx={left + 1} WHERE a.t_idx={left})"


def _series_rk4(n: int, src: str, dt: float) -> str:
    t = (n - 1) * dt
    stage = lambda a, at: f"({tri(a, _values_at(at))})"
    ctes = [f"k1 AS {stage(src, t)}"]
    for m, (share, at) in enumerate(((0.5, t + dt / 2), (0.5, t + dt / 2), (1.0, t + dt)), 2):
        cols = ", ".join(f"s.{a}+{share * dt}::DOUBLE*k{m - 1}.{q} {a}" for a, q in zip("xyz", "uvw"))
        ctes += [f"p{m} AS (SELECT s.id, {cols} FROM {src} s JOIN k{m - 1} USING (id))", f"k{m} AS {stage(f'p{m}', at)}"]
    cols = ", ".join(f"least(greatest(s.{a}+{dt}::DOUBLE*(k1.{q}+2*k2.{q}+2*k3.{q}+k4.{q})/6,0),{hi}) {a}" for (a, _, hi), q in zip(BOX.axes(), "uvw"))
    return f"WITH {', '.join(ctes)} SELECT s.id, {cols} FROM {src} s JOIN k1 USING (id) JOIN k2 USING (id) JOIN k3 USING (id) JOIN k4 USING (id)"


query(
    "advect_series",
    f"WITH {_chain(lambda n, src: _series_rk4(n, src, 0.25), 1, 12)} {_recorded(range(13), 0.25)}",
    "points series", "t x y z", "particle_id t_idx", digits=5,
)(
    lambda t: move.advect(t.points(), move.GridSeriesField(t.series().drop("t", "node_id"), t.times(), META), 0.25, 12, "rk4", rules.clamp(BOX))
)


def _with_velocity(t):
    field = move.GridSeriesField(t.series().drop("t", "node_id"), t.times(), META)
    return move.with_velocity(_timed_points(t), field).select("id", "u", "v", "w")


query("with_velocity", SERIES_TRI, "points series", "u v w", "id")(_with_velocity)


def _compare(t):
    finals = {m: move.advect(t.points(), _field(t), 2.0, 1, m, plan="broadcast").filter("t_idx = 1") for m in move.METHODS}
    return move.compare_methods(finals, "rk4")


def _compare_sql() -> str:
    parts = [
        f"SELECT '{m}' AS method, avg(d) AS mean, max(d) AS max, stddev_pop(d) AS std FROM (SELECT sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) d FROM ({displace_sql(m)}) a JOIN ({displace_sql('rk4')}) b USING (id))"
        for m in ("euler", "rk2")
    ]
    return " UNION ALL ".join(parts)


query("compare_methods", _compare_sql(), "points node_values", "mean max std")(_compare)

_STAMPS = [0.0, 0.5, 1.25, 3.0]
VORTEX_SQL = f"""SELECT s.t_idx, s.t, p.id node_id, -st*(p.y-cy)/((p.x-cx)*(p.x-cx)+(p.y-cy)*(p.y-cy)+1e-6) u, st*(p.x-cx)/((p.x-cx)*(p.x-cx)+(p.y-cy)*(p.y-cy)+1e-6) v, 0.0::DOUBLE w
FROM points p, (SELECT t_idx, t, 1+0.5::DOUBLE*sin(2*pi()*t/5) st, 0.3::DOUBLE*cos(2*pi()*t/5) cx, 0.3::DOUBLE*sin(2*pi()*t/5) cy FROM (VALUES {', '.join(f'({n},{v}::DOUBLE)' for n, v in enumerate(_STAMPS))}) v(t_idx,t)) s"""
query("field_from_expression", VORTEX_SQL, "points", "t u v w", "t_idx node_id", digits=5)(
    lambda t: move.field_from_expression(t.points().withColumnRenamed("id", "node_id"), _STAMPS, analytic.moving_vortex())
)

REPEAT = "SELECT p.n*5+s.t_idx-1 t_idx, s.t-1+p.n*4 t, s.node_id, s.u, s.v, s.w FROM series s, range(3) p(n) WHERE s.t_idx BETWEEN 1 AND 5"
query("repeat_period", REPEAT, "series", "t u v w", "t_idx node_id")(lambda t: move.repeat_period(t.samples(), t.times(), 3, (1.0, 5.0))[0])


def _smooth(t):
    rows, per, n = move.repeat_period(t.samples(), t.times(), 3, (1.0, 5.0))
    return move.smooth_joints(rows, per, n, 0.4)


query(
    "repeat_period_target",
    REPEAT.replace("range(3)", "range(4)"),
    "series", "t u v w", "t_idx node_id",
)(lambda t: move.repeat_period(t.samples(), t.times(), time_slice=(1.0, 5.0), target=13.0)[0])


def _smooth_most(t):
    """Four of five snapshots blended: mirror images are themselves blended at the joint before."""
    rows, per, n = move.repeat_period(t.samples(), t.times(), 3, (1.0, 5.0))
    return move.smooth_joints(rows, per, n, 0.8)


def _joint_by_joint() -> str:
    """Snapshot after snapshot in the order of time: own weight (i + 1) / 4, the rest from the mirror image as it then is."""
    ctes, now = [f"r0 AS ({REPEAT})"], 0
    for joint in (5, 10):
        for i in range(4):
            a = (i + 1) / 4
            mixed = ", ".join(f"CASE WHEN a.t_idx={joint + i} THEN {a}::DOUBLE*a.{c}+{1 - a}::DOUBLE*b.{c} ELSE a.{c} END {c}" for c in "uvw")
            ctes.append(f"r{now + 1} AS MATERIALIZED (SELECT a.t_idx, a.t, a.node_id, {mixed} FROM r{now} a LEFT JOIN r{now} b ON b.node_id=a.node_id AND a.t_idx={joint + i} AND b.t_idx={joint - 1 - i})")
            now += 1
    return f"WITH {', '.join(ctes)} SELECT * FROM r{now}"


query("smooth_joints_most", _joint_by_joint(), "series", "t u v w", "t_idx node_id")(_smooth_most)
query(
    "smooth_joints",
    f"""WITH r AS ({REPEAT}) SELECT a.t_idx, a.t, a.node_id, {", ".join(f"CASE WHEN a.t_idx IN (5,10) THEN 0.5*a.{c}+0.5*b.{c} ELSE a.{c} END {c}" for c in "uvw")}
FROM r a LEFT JOIN r b ON b.node_id=a.node_id AND b.t_idx = CASE WHEN a.t_idx IN (5,10) THEN a.t_idx-1 END""",
    "series", "t u v w", "t_idx node_id",
)(_smooth)

query(
    "analytic_fields",
    "SELECT id, -2*(y-5)/greatest((x-4)*(x-4)+(y-5)*(y-5),1e-10) vu, 2*(x-4)/greatest((x-4)*(x-4)+(y-5)*(y-5),1e-10) vv, 0.5::DOUBLE*x su, -0.5::DOUBLE*y sv, 0.1::DOUBLE uu FROM points",
    "points", "vu vv su sv uu", "id",
)(
    lambda t: t.points().select(
        "id",
        *[c.alias(n) for c, n in zip(analytic.vortex((4.0, 5.0), 2.0)(F.col("x"), F.col("y"), F.col("z"), F.lit(0.0)), ("vu", "vv"))],
        *[c.alias(n) for c, n in zip(analytic.saddle(0.5)(F.col("x"), F.col("y"), F.col("z"), F.lit(0.0)), ("su", "sv"))],
        analytic.uniform((0.1, 0.0, 0.0))(F.col("x"), F.col("y"), F.col("z"), F.lit(0.0))[0].alias("uu"),
    )
)

_NEAR_ELEMENT = """SELECT p.id, arg_min(e.elem_id, ((p.x-mx)*(p.x-mx)+(p.y-my)*(p.y-my)+(p.z-mz)*(p.z-mz), e.elem_id)) elem_id FROM {src} p, ({cent}) e GROUP BY p.id"""
query(
    "fem_sample_tet4_element_node",
    f"""WITH hit AS ({FEM_INSIDE}), near AS ({_NEAR_ELEMENT.format(src='(SELECT * FROM wide_points WHERE id NOT IN (SELECT id FROM hit))', cent=CENTROIDS)}),
 pick AS (SELECT p.id, arg_min(n.node_id, ((p.x-n.x)*(p.x-n.x)+(p.y-n.y)*(p.y-n.y)+(p.z-n.z)*(p.z-n.z), n.node_id)) node_id
  FROM near JOIN wide_points p USING (id) JOIN tets t USING (elem_id) JOIN nodes n ON n.node_id IN (n0, n1, n2, n3) GROUP BY p.id)
SELECT id, elem_id, u, v, w FROM hit UNION ALL SELECT pick.id, NULL::BIGINT, v.u, v.v, v.w FROM pick JOIN node_values v USING (node_id)""",
    "wide_points tets nodes node_values", "u v w", "id elem_id",
)(lambda t: smp.fem_sample(t.wide_points(), t.tets(), t.nodes(), t.node_values(), "tet4", "nearest_element_node"))
query(
    "centroid_sample_strict",
    f"""WITH near AS ({_NEAR_ELEMENT.format(src='wide_points', cent=CENTROIDS)}), h AS (
 SELECT p.id, w.l1, w.l2, w.l3, w.l4, a.u au, a.v av, a.w aw, b.u bu, b.v bv, b.w bw, c.u cu, c.v cv, c.w cw, d.u du, d.v dv, d.w dw
 FROM wide_points p JOIN near USING (id) JOIN tets t USING (elem_id)
 JOIN node_values a ON a.node_id=n0 JOIN node_values b ON b.node_id=n1 JOIN node_values c ON c.node_id=n2 JOIN node_values d ON d.node_id=n3,
 LATERAL (SELECT (p.x-a.x)*(b.x-a.x)+(p.y-a.y)*(b.y-a.y)+(p.z-a.z)*(b.z-a.z) fa, (p.x-a.x)*(c.x-b.x)+(p.y-a.y)*(c.y-b.y)+(p.z-a.z)*(c.z-b.z) fb,
  (p.x-a.x)*(d.x-c.x)+(p.y-a.y)*(d.y-c.y)+(p.z-a.z)*(d.z-c.z) fc) f, LATERAL (SELECT 1-fa l1, fa-fb l2, fb-fc l3, fc l4) w)
SELECT id, {", ".join(f"CASE WHEN least(l1,l2,l3,l4) >= -1e-6 THEN l1*a{c}+l2*b{c}+l3*c{c}+l4*d{c} ELSE 0 END {c}" for c in "uvw")} FROM h""",
    "wide_points tets nodes node_values", "u v w", "id",
)(lambda t: smp.centroid_sample(t.wide_points(), t.tets(), t.nodes(), t.node_values(), "tet4", strict_inside=True))

# ---------------------------------------------------------------------------------------------------
# fields on nodes and meshes that change with time


def _node_of(p: str) -> str:
    """The nearest grid node of a point, lower index on ties."""
    i, j, k = (f"least(greatest(ceil({p}.{a}-0.5::DOUBLE),0),{hi})" for a, _, hi in BOX.axes())
    return f"CAST(({i}*11+{j})*9+{k} AS BIGINT)"


def _node_step(src: str, t: float, dt: float) -> str:
    cols = ", ".join(f"p.{a}+{dt}::DOUBLE*n.{q} {a}" for a, q in zip("xyz", "uvw"))
    return f"SELECT p.id, {cols} FROM {src} p JOIN {_values_at(t)} n ON n.node_id={_node_of('p')}"


def _mesh_step(src: str, values: str, dt: float) -> str:
    """Euler step in the mesh; outside it the nearest node counts."""
    inside = FEM_INSIDE.replace("wide_points", src).replace("JOIN node_values", f"JOIN {values}")
    cols = ", ".join(f"p.{a}+{dt}::DOUBLE*h.{q} {a}" for a, q in zip("xyz", "uvw"))
    return f"""WITH hit AS ({inside}), everyone AS (SELECT id, u, v, w FROM hit UNION ALL
 SELECT p.id, n.u, n.v, n.w FROM {src} p JOIN {values} n ON n.node_id={_node_of('p')} WHERE p.id NOT IN (SELECT id FROM hit))
SELECT p.id, {cols} FROM {src} p JOIN everyone h USING (id)"""


def _node_series(t):
    return move.NodeSeriesField(t.nodes(), t.samples().drop("t"), t.times())


def _mesh_series(t):
    return move.MeshSeriesField(t.tets(), t.nodes(), t.samples().drop("t"), t.times())


query("displace_nodes_euler", _node_step("points", 1.3, 2.0), "points series", "x y z", "id")(
    lambda t: move.displace(t.points().drop("mass"), _node_series(t), 2.0, "euler", 1.3)
)
query("displace_steady_nodes", "SELECT p.id, p.x+2*n.u x, p.y+2*n.v y, p.z+2*n.w z FROM points p JOIN node_values n ON n.node_id=" + _node_of("p"), "points node_values", "x y z", "id")(
    lambda t: move.displace(t.points().drop("mass"), move.NodeField(t.nodes(), t.node_values().select("node_id", *"uvw")), 2.0, "euler")
)
query(
    "advect_nodes_two_steps",
    f"WITH {_chain(lambda n, src: _node_step(src, 1.25 + (n - 1) * 0.5, 0.5), 1, 2)} " + _recorded(range(3), 0.5).replace("::DOUBLE t,", "::DOUBLE+1.25 t,"),
    "points series", "t x y z", "particle_id t_idx",
)(lambda t: move.advect(t.points(), _node_series(t), 0.5, 2, "euler", t0=1.25))
query(
    "with_velocity_nodes",
    f"""WITH q AS (SELECT id, x, y, z, least(greatest(t,0),6) t FROM {TIMED}), b AS (SELECT *, least(floor(t),5) l FROM q)
SELECT p.id, {", ".join(f"a.{c}+(p.t-p.l)*(b.{c}-a.{c}) {c}" for c in "uvw")} FROM b p
JOIN series a ON a.t_idx=p.l AND a.node_id={_node_of('p')} JOIN series b ON b.t_idx=p.l+1 AND b.node_id=a.node_id""",
    "points series", "u v w", "id",
)(lambda t: move.with_velocity(_timed_points(t), _node_series(t)).select("id", "u", "v", "w"))
query("displace_mesh_euler", _mesh_step("wide_points", "node_values", 0.5), "wide_points tets nodes node_values", "x y z", "id")(
    lambda t: move.displace(t.wide_points().drop("mass"), move.MeshField(t.tets(), t.nodes(), t.node_values().select("node_id", *"uvw")), 0.5, "euler")
)
query(
    "advect_mesh_series",
    f"WITH {_chain(lambda n, src: _mesh_step(src, _values_at(1.25 + (n - 1) * 0.5), 0.5), 1, 2)} " + _recorded(range(3), 0.5).replace("::DOUBLE t,", "::DOUBLE+1.25 t,"),
    "points series tets nodes", "t x y z", "particle_id t_idx",
)(lambda t: move.advect(t.points(), _mesh_series(t), 0.5, 2, "euler", t0=1.25))
