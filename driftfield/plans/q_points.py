"""Queries: projections and scalar math (P), point generation (G)."""

from __future__ import annotations


from pyspark.sql import functions as F

from driftfield.functions import rand, vector as vec
from driftfield.operators import points as gen, sample as smp
from driftfield.plans.fixtures import BOX, META
from driftfield.plans.registry import query

# ---------------------------------------------------------------------------------------------------
# projections


def q(name, sql, fn, uses="points", dbl="x y z", ints="id", digits=6):
    query(name, sql, uses, dbl, ints, digits)(fn)


def _pts(t):
    return t.points().drop("mass")


q("as_points", "SELECT vec_id id, embedding[1]::DOUBLE x, embedding[2]::DOUBLE y, 0.0::DOUBLE z FROM embeddings",
  lambda t: vec.as_points(t.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))), "")
q("pad_vector3", "SELECT vec_id id, embedding[1]::DOUBLE u, CASE WHEN vec_id%3>0 THEN embedding[2]::DOUBLE ELSE 0 END v, CASE WHEN vec_id%3>1 THEN embedding[3]::DOUBLE ELSE 0 END w FROM embeddings",
  lambda t: t.raw("embeddings").select(F.col("vec_id").alias("id"), *[c.alias(n) for c, n in zip(vec.pad_vector3(F.slice("embedding", F.lit(1), (F.col("vec_id") % 3 + 1).cast("int"))), "uvw")]), "", "u v w")
q("in_box", "SELECT id, x, y, z FROM wide_points WHERE x BETWEEN 0 AND 9 AND y BETWEEN 0 AND 10 AND z BETWEEN 0 AND 8",
  lambda t: vec.in_box(t.wide_points().drop("mass"), BOX), "wide_points")
q("clamp_points", "SELECT id, least(greatest(x,-0.5),9.5) x, least(greatest(y,-0.5),10.5) y, least(greatest(z,-0.5),8.5) z FROM wide_points",
  lambda t: vec.clamp_points(t.wide_points().drop("mass"), vec.expand_box(BOX, 0.5)), "wide_points")
q("box_size", "SELECT x1-x0 x, y1-y0 y, z1-z0 z FROM box",
  lambda t: t.spark.createDataFrame([tuple(map(float, vec.box_size(t.box())))], "x double, y double, z double"), "box", "x y z", "")
q("translate", "SELECT id, x+1.5 x, y-2 y, z+0.25 z FROM points", lambda t: vec.translate(_pts(t), (1.5, -2.0, 0.25)))
q("scale", "SELECT id, x*2 x, y*3 y, z*0.5 z FROM points", lambda t: vec.scale(_pts(t), (2.0, 3.0, 0.5)))
q("rotate2d", "SELECT id, x*cos(0.7)-y*sin(0.7) x, x*sin(0.7)+y*cos(0.7) y, z FROM points", lambda t: vec.rotate2d(_pts(t), 0.7))
# x first, then y, then z: applied one after the other
EULER = """SELECT id, x*cos(0.9)-y*sin(0.9) x, x*sin(0.9)+y*cos(0.9) y, z FROM (
 SELECT id, x*cos(0.5)+z*sin(0.5) x, y, z*cos(0.5)-x*sin(0.5) z FROM (
 SELECT id, x, y*cos(0.3)-z*sin(0.3) y, y*sin(0.3)+z*cos(0.3) z FROM points))"""
q("rotate3d_euler", EULER, lambda t: vec.rotate3d_euler(_pts(t), (0.3, 0.5, 0.9), "xyz"))
q("similarity", EULER.replace("FROM points", "FROM (SELECT id, x*2 x, y*2 y, z*2 z FROM points)").replace("SELECT id, x*cos(0.9)-y*sin(0.9) x, x*sin(0.9)+y*cos(0.9) y, z FROM", "SELECT id, x*cos(0.9)-y*sin(0.9)+1 x, x*sin(0.9)+y*cos(0.9)-1 y, z+0.5 z FROM", 1),
  lambda t: vec.similarity(_pts(t), 2.0, vec.euler_matrix((0.3, 0.5, 0.9)), (1.0, -1.0, 0.5)))
q("grid_cell", "SELECT id, CAST(floor((x-0.1)/0.75) AS BIGINT) cx, CAST(floor((y-0.1)/0.75) AS BIGINT) cy, CAST(floor((z-0.1)/0.75) AS BIGINT) cz FROM points",
  lambda t: vec.grid_cell(_pts(t), (0.1, 0.1, 0.1), 0.75).select("id", "cx", "cy", "cz"), dbl="", ints="id cx cy cz")
q("cell_key", "SELECT id, xor(xor(CAST(floor(x/0.75) AS BIGINT)*73856093, CAST(floor(y/0.75) AS BIGINT)*19349663), CAST(floor(z/0.75) AS BIGINT)*83492791) key FROM points",
  lambda t: vec.grid_cell(_pts(t), (0.0, 0.0, 0.0), 0.75).select("id", vec.cell_key(F.col("cx"), F.col("cy"), F.col("cz")).alias("key")), dbl="", ints="id key")
q("plane_project", "SELECT id, x p, z q FROM points", lambda t: vec.plane_project(_pts(t), "xz").select("id", "p", "q"), dbl="p q")
q("extract_slice", "SELECT id, 0.0::DOUBLE x, y, z FROM points", lambda t: vec.flatten_axis(_pts(t), "yz"))
q("slab_filter", "SELECT id, x p, y q FROM points WHERE abs(z-4) <= 0.5", lambda t: vec.slab_filter(_pts(t), "xy", 4.0, 1.0).select("id", "p", "q"), dbl="p q")
q("slab_filter_empty", "SELECT id, x p, y q FROM points", lambda t: vec.slab_filter(_pts(t), "xy", 100.0, 1.0, all_if_empty=True).select("id", "p", "q"), dbl="p q")
q("magnitude", "SELECT i, j, k, sqrt(u*u+v*v+w*w) speed FROM grid", lambda t: t.grid().select("i", "j", "k", vec.magnitude(F.col("u"), F.col("v"), F.col("w")).alias("speed")), "grid", "speed", "i j k")
q("drop_still_nodes", "SELECT node_id, t_idx, u FROM series WHERE sqrt(u*u+v*v+w*w) > 0.2",
  lambda t: vec.drop_still_nodes(t.samples(), 0.2).select("node_id", "t_idx", "u"), "series", "u", "node_id t_idx")
q("subsample_rows", "SELECT id, x, y, z FROM points WHERE id%3=0 ORDER BY id LIMIT 100", lambda t: vec.subsample_rows(_pts(t), "id", 3, 100))
q("plot_frame", "SELECT " + ", ".join(f"{a}0-0.02*({a}1-{a}0) lo{a}, {a}1+0.02*({a}1-{a}0) hi{a}" for a in "xyz") + " FROM box",
  lambda t: vec.plot_frame(_pts(t)), "box", "lox hix loy hiy loz hiz", "")
q("fraction_box", "SELECT id, x, y, z FROM points, box WHERE x BETWEEN x0+0.1::DOUBLE*(x1-x0) AND x0+0.35::DOUBLE*(x1-x0) AND y BETWEEN y0 AND y1 AND z BETWEEN z0+0.25::DOUBLE*(z1-z0) AND z0+0.75::DOUBLE*(z1-z0)",
  lambda t: vec.in_box(_pts(t), vec.fraction_box(t.box(), {"x": (0.1, 0.35), "z": (0.25, 0.75)})), "points box")
q("percentile_clip", "SELECT event_id id, greatest(least(x,(SELECT quantile_cont(x,0.95) FROM event_rows)),(SELECT quantile_cont(x,0.05) FROM event_rows)) x FROM event_rows",
  lambda t: vec.percentile_clip(t.event_points().select("id", "x"), "x", 5, 95), "event_rows", "x")

# ---------------------------------------------------------------------------------------------------
# random numbers and generators; n and the box come from the points table


def bits(seed, tag: str, key: str = "id") -> str:
    return f"('0x'||substr(md5('{seed}:'||({key})||':{tag}'),1,13))::BIGINT::DOUBLE"


def U(seed, tag: str, key: str = "id") -> str:
    return f"({bits(seed, tag, key)}/4503599627370496.0::DOUBLE)"


def N(seed, tag: str, key: str = "id") -> str:
    return f"(sqrt(-2*ln(({bits(seed, tag + 'r', key)}+0.5::DOUBLE)/4503599627370496.0::DOUBLE))*cos(2*pi()*{U(seed, tag + 'a', key)}))"


def box_sql(seed, key: str = "id") -> str:
    return ", ".join(f"{a}0+{U(seed, a, key)}*({a}1-{a}0) {a}" for a in "xyz")


q("keyed_random", f"SELECT id, {U(3, 'a')} u, {N(3, 'b')} n, CAST(5+floor({U(3, 'c')}*20) AS BIGINT) k FROM points",
  lambda t: t.points().select("id", rand.keyed_uniform(3, F.col("id"), "a").alias("u"), rand.keyed_normal(3, F.col("id"), "b").alias("n"), rand.keyed_integer(3, F.col("id"), "c", 5, 25).alias("k")), dbl="u n", ints="id k")
q("random_points", f"SELECT id, {box_sql(7)} FROM ids, box", lambda t: gen.random_points(t.spark, t.n_points(), t.box(), 7), "ids box")


def _side(t) -> int:
    return max(2, int(round(t.n_points() ** (1 / 3))))


SIDE = "(SELECT CAST(greatest(2,round(count(*)**(1/3.0))) AS BIGINT) n FROM part)"
GRID = f"SELECT (i*n+j)*4+k id, x0+i*(x1-x0)/(n-1) x, y0+j*(y1-y0)/(n-1) y, z0+k*(z1-z0)/3 z FROM box, {SIDE}, LATERAL (SELECT unnest(range(n)) i), LATERAL (SELECT unnest(range(n)) j), (SELECT unnest(range(4)) k)"
q("grid_points", GRID, lambda t: gen.grid_points(t.spark, (_side(t), _side(t), 4), t.box()).select("id", "x", "y", "z"), "box")
q("grid_points_interior", f"SELECT i*n+j id, x0+(i+1)*(x1-x0)/(n+1) x, y0+(j+1)*(y1-y0)/(n+1) y, z0 z FROM box, {SIDE}, LATERAL (SELECT unnest(range(n)) i), LATERAL (SELECT unnest(range(n)) j)",
  lambda t: gen.grid_points(t.spark, (_side(t), _side(t), 1), t.box(), boundary=False).select("id", "x", "y", "z"), "box")
q("line_points", "SELECT id, x0+id*(x1-x0)/((SELECT count(*) FROM part)-1) x, y0+id*(y1-y0)/((SELECT count(*) FROM part)-1) y, z0+id*(z1-z0)/((SELECT count(*) FROM part)-1) z FROM ids, box",
  lambda t: gen.line_points(t.spark, t.n_points(), t.box().lo, t.box().hi), "ids box")
_AROUND = "(SELECT vec_id id, embedding[1]::DOUBLE x, embedding[2]::DOUBLE y, embedding[3]::DOUBLE z, 0.5::DOUBLE+label::DOUBLE radius FROM embeddings)"


def _around(t):
    """Centres and radii from the vectors."""
    return t.raw("embeddings").select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")], (F.col("label") + 0.5).cast("double").alias("radius"))


q("circle_points", f"SELECT id*7+m id, id center, x, y+radius*cos(0.4::DOUBLE+2*pi()*m/7) y, z+radius*sin(0.4::DOUBLE+2*pi()*m/7) z FROM {_AROUND}, range(7) r(m)",
  lambda t: gen.circles(_around(t), 7, "yz", 0.4), "", ints="id center")
_SPH = "SELECT id, center, " + ", ".join(f"{a}+{{f}}*n{a}/sqrt(nx*nx+ny*ny+nz*nz) {a}" for a in "xyz") + f" FROM (SELECT *, {N(9, 'x')} nx, {N(9, 'y')} ny, {N(9, 'z')} nz, {U(9, 'r')} r FROM (SELECT id*3+m id, id center, x, y, z, radius FROM {_AROUND}, range(3) q(m)))"
q("sphere_points", _SPH.format(f="radius*cbrt(r)"), lambda t: gen.spheres(_around(t), 3, 9), "", ints="id center")
q("sphere_surface_points", _SPH.format(f="radius"), lambda t: gen.spheres(_around(t), 3, 9, surface=True), "", ints="id center")
_FACE = """SELECT id, CASE f WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x END x, CASE f WHEN 2 THEN y0 WHEN 3 THEN y1 ELSE y END y, CASE f WHEN 4 THEN z0 WHEN 5 THEN z1 ELSE z END z
FROM (SELECT id, f, """ + box_sql(4) + """, x0, x1, y0, y1, z0, z1 FROM (SELECT face f, row_number() OVER (ORDER BY face, m)-1 id FROM
 (SELECT unnest(range(6)) face), (SELECT count(*) n FROM part), LATERAL (SELECT unnest(range(n//6 + CASE WHEN face < n%6 THEN 1 ELSE 0 END)) m)), box)"""
q("box_points_boundary", _FACE, lambda t: gen.box_points(t.spark, t.n_points(), t.box(), "boundary", 4), "box")
q("box_points_corners", "SELECT id, CASE WHEN id<8 THEN CASE WHEN id&1=1 THEN x1 ELSE x0 END ELSE x END x, CASE WHEN id<8 THEN CASE WHEN id&2=2 THEN y1 ELSE y0 END ELSE y END y, CASE WHEN id<8 THEN CASE WHEN id&4=4 THEN z1 ELSE z0 END ELSE z END z FROM (SELECT id, " + box_sql(4) + ", x0, x1, y0, y1, z0, z1 FROM ids, box)",
  lambda t: gen.box_points(t.spark, t.n_points(), t.box(), "corners", 4), "ids box")
q("box_points_uniform", f"SELECT id, {box_sql(4)} FROM ids, box", lambda t: gen.box_points(t.spark, t.n_points(), t.box(), "uniform", 4), "ids box")
q("gaussian_clusters", "SELECT id, cluster, " + ", ".join(f"{a}+0.25::DOUBLE*{N(5, a)} {a}" for a in "xyz") + " FROM (SELECT p.id*4+m id, p.id AS \"cluster\", x, y, z FROM points p, range(4) r(m))",
  lambda t: gen.gaussian_clusters(_pts(t), 0.25, 4, 5), ints='id "cluster"')
q("stratified_points", "SELECT id, " + ", ".join(f"{a}0+({i}+{U(6, a)})*(({a}1-{a}0)/{n}) {a}" for a, i, n in zip("xyz", ("s//12", "(s//4)%3", "s%4"), (2, 3, 4)))
  + " FROM (SELECT s, row_number() OVER (ORDER BY s, m)-1 id FROM (SELECT unnest(range(24)) s), (SELECT count(*) n FROM part), LATERAL (SELECT unnest(range(n//24 + CASE WHEN s < n%24 THEN 1 ELSE 0 END)) m)), box",
  lambda t: gen.stratified_points(t.spark, t.n_points(), t.box(), (2, 3, 4), 6).select("id", "x", "y", "z"), "box")

_PDF = "exp(-((x-4)*(x-4)+(y-5)*(y-5))/8)"
def _dens(pdf: str, per_point: int) -> str:
    """The first accepted of per_point candidates a point, which are more than enough."""
    return f"""WITH probe AS (SELECT {box_sql(8)} FROM range(1000) r(id), box), bound AS (SELECT 1.1::DOUBLE*max({pdf}) b FROM probe),
 cand AS (SELECT id, {box_sql('8c')}, {U('8c', 'accept')} a FROM (SELECT unnest(range({per_point}*(SELECT count(*) FROM part))) id), box)
SELECT id, x, y, z FROM (SELECT id, x, y, z FROM cand, bound WHERE a*b <= {pdf} ORDER BY id LIMIT (SELECT count(*) FROM part))"""


def _gauss_pdf(df):
    dx, dy = F.col("x") - 4.0, F.col("y") - 5.0
    return df.withColumn("pdf", F.exp(-(dx * dx + dy * dy) / 8.0))


q("density_sampled_points", _dens(_PDF, 40), lambda t: gen.density_sampled_points(t.spark, t.n_points(), t.box(), _gauss_pdf, 8), "box")
_CORNER = "CASE WHEN x < 1.8 AND y < 2.0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"  # about 4 % of the box
q("density_sampled_corner", _dens(_CORNER, 60), lambda t: gen.density_sampled_points(t.spark, t.n_points(), t.box(), lambda df: df.withColumn("pdf", F.expr(_CORNER)), 8), "box")
_NEAR = "JOIN (SELECT c.id cid, arg_min(sqrt(n.u*n.u+n.v*n.v+n.w*n.w)+1e-10, (sqrt((c.x-n.x)*(c.x-n.x)+(c.y-n.y)*(c.y-n.y)+(c.z-n.z)*(c.z-n.z)), n.node_id)) pdf FROM {c} c, node_values n GROUP BY 1) ON cid=id"
_SPAN = lambda seed: ", ".join(f"{U(seed, a)}*{hi} {a}" for a, _, hi in BOX.axes())
_FIELD = f"""WITH probe AS (SELECT id, {_SPAN(3)} FROM range(1000) r(id)), bound AS (SELECT 1.1::DOUBLE*max(pdf) b FROM probe {_NEAR.format(c='probe')}),
 cand AS (SELECT id, {_SPAN('3c')}, {U('3c', 'accept')} a FROM (SELECT unnest(range(12*(SELECT count(*) FROM part))) id))
SELECT id, x, y, z FROM (SELECT id, x, y, z FROM cand {_NEAR.format(c='cand')}, bound WHERE a*b <= pdf ORDER BY id LIMIT (SELECT count(*) FROM part))"""
query("field_weighted_points", _FIELD, "node_values", "x y z", "id")(
    lambda t: gen.field_weighted_points(t.spark, t.n_points(), BOX, gen.grid_metric(t.node_values(), META.spacing, "magnitude"), 3, META, raise_bound=False)
)

_NB = "LEFT JOIN node_values {n} ON " + "{n}.i=g.i+{a} AND {n}.j=g.j+{b} AND {n}.k=g.k+{c}"
_JOINS = " ".join(_NB.format(n=f"{ax}{s}", a=(1 if s == "p" else -1) * (ax == "i"), b=(1 if s == "p" else -1) * (ax == "j"), c=(1 if s == "p" else -1) * (ax == "k")) for ax in "ijk" for s in "pm")


def _slope(c: str, ax: str) -> str:
    return f"((coalesce({ax}p.{c},g.{c})-coalesce({ax}m.{c},g.{c}))/(CASE WHEN {ax}p.{c} IS NOT NULL AND {ax}m.{c} IS NOT NULL THEN 2 ELSE 1 END))"


q("grid_divergence", f"SELECT g.node_id, abs({_slope('u', 'i')}+{_slope('v', 'j')}+{_slope('w', 'k')}) weight FROM node_values g {_JOINS}",
  lambda t: gen.grid_metric(t.node_values(), META.spacing, "divergence").select("node_id", "weight"), "node_values", "weight", "node_id")
_CURL = [f"({_slope('w', 'j')}-{_slope('v', 'k')})", f"({_slope('u', 'k')}-{_slope('w', 'i')})", f"({_slope('v', 'i')}-{_slope('u', 'j')})"]
q("grid_vorticity", "SELECT g.node_id, sqrt(" + "+".join(f"{c}*{c}" for c in _CURL) + f") weight FROM node_values g {_JOINS}",
  lambda t: gen.grid_metric(t.node_values(), META.spacing, "vorticity").select("node_id", "weight"), "node_values", "weight", "node_id")
q("combine_points", f"SELECT id, {box_sql(1)} FROM ids, box UNION ALL SELECT id+(SELECT count(*) FROM part), x, y, z FROM (SELECT id, {box_sql(2)} FROM ids, box)",
  lambda t: gen.combine_points([(gen.random_points(t.spark, t.n_points(), t.box(), s), t.n_points()) for s in (1, 2)]), "ids box")
q("clipped_gaussian_points", "SELECT id, " + ", ".join(f"least(greatest(({a}0+{a}1)/2+{N(2, a)}*(0.3::DOUBLE*({a}1-{a}0)),{a}0),{a}1) {a}" for a in "xyz") + " FROM ids, box",
  lambda t: gen.clipped_gaussian_points(t.spark, (t.n_points(), 1, 1), t.box(), (0.3, 0.3, 0.3), 2), "ids box")
q("count_points", f"SELECT id, {box_sql(11)} FROM (SELECT unnest(range(2*(SELECT count(*) FROM part))) id), box", lambda t: gen.count_points(t.spark, (t.n_points(), 2, 1), t.box(), 11), "box")
q("inlet_face_points", "SELECT id, x0 x, y0+(n//7)*(y1-y0)/10 y, z0+(n%7)*(z1-z0)/6 z FROM (SELECT id, CAST(floor(id*77/(SELECT count(*) FROM part)) AS BIGINT) n FROM ids), box",
  lambda t: gen.inlet_face_points(t.spark, t.n_points(), t.box(), "x", t.box().lo[0], {"y": 11, "z": 7}).select("id", "x", "y", "z"), "ids box")
q("validate_points", "SELECT count(*) n, count(*) n_finite, count(*) FILTER (x BETWEEN 0 AND 9 AND y BETWEEN 0 AND 10 AND z BETWEEN 0 AND 8) n_inside, " + ", ".join(f"min({a}) {a}_min, max({a}) {a}_max, avg({a}) {a}_mean, stddev_pop({a}) {a}_std" for a in "xyz") + " FROM wide_points",
  lambda t: gen.validate_points(t.wide_points(), BOX), "wide_points", " ".join(f"{a}_{m}" for a in "xyz" for m in ("min", "max", "mean", "std")), "n n_finite n_inside")
_HIST = " UNION ALL ".join(f"SELECT '{a}' axis, b.b bin, coalesce(c.n,0) n FROM range(20) b(b) LEFT JOIN (SELECT least(CAST(floor(({a}-{a}0)/(({a}1-{a}0)/20)) AS BIGINT),19) bin, count(*) n FROM points, box GROUP BY 1) c ON c.bin=b.b" for a in "xyz")
q("axis_histograms", _HIST, lambda t: gen.axis_histograms(_pts(t), 20), "points box", "", "bin n")
q("neighbour_distance_stats", "SELECT avg(d) mean, stddev_pop(d) std, min(d) min, max(d) max FROM (SELECT a.id, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) d FROM cloud a JOIN cloud b ON a.id<>b.id GROUP BY 1)",
  lambda t: gen.neighbour_distance_stats(t.cloud()), "cloud", "mean std min max", "")
q("shuffle_rows", f"SELECT id, {U(12, 'shuffle')} shuffle_key FROM points", lambda t: gen.shuffle_rows(t.points(), "id", 12).select("id", "shuffle_key"), dbl="shuffle_key")
_CLOUD_HIST = " UNION ALL ".join(
    f"""SELECT '{a}' axis, b.i bin, count(c.{a}) n FROM (SELECT unnest(range(20)) i) b, (SELECT min({a}) lo, max({a}) hi FROM cloud) r
 LEFT JOIN cloud c ON least(floor((c.{a}-r.lo)/((r.hi-r.lo)/20)),19)=b.i GROUP BY 1,2"""
    for a in "xyz"
)
q("point_density_profile", f"""WITH h AS ({_CLOUD_HIST}), b AS (SELECT count(*) n, (max(x)-min(x))*(max(y)-min(y))*(max(z)-min(z)) vol FROM cloud),
 d AS (SELECT a.id, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) d FROM cloud a JOIN cloud b ON a.id<>b.id GROUP BY 1)
SELECT 'n_points' metric, n::DOUBLE AS value FROM b UNION ALL SELECT 'volume', vol FROM b UNION ALL SELECT 'mean_density', n/vol FROM b
UNION ALL SELECT 'histogram_'||axis||'_mean', avg(n) FROM h GROUP BY axis UNION ALL SELECT 'histogram_'||axis||'_std', stddev_pop(n) FROM h GROUP BY axis
UNION ALL SELECT 'histogram_'||axis||'_max', max(n)::DOUBLE FROM h GROUP BY axis
UNION ALL SELECT 'neighbour_mean', avg(d) FROM d UNION ALL SELECT 'neighbour_std', stddev_pop(d) FROM d UNION ALL SELECT 'neighbour_min', min(d) FROM d UNION ALL SELECT 'neighbour_max', max(d) FROM d""",
  lambda t: gen.point_density_profile(t.cloud(), 20), "cloud", "value", "", digits=5)
q("choose_without", f"SELECT id, key choice_key FROM (SELECT event_id id, -ln(({bits(13, 'choice', 'event_id')}+0.5::DOUBLE)/4503599627370496.0::DOUBLE)/x AS key FROM event_rows) ORDER BY key, id LIMIT 500",
  lambda t: gen.choose_without(t.event_points(), "id", F.col("x"), 500, 13).select("id", "choice_key"), "event_rows", "choice_key")
q("choose_with", f"SELECT d.draw, min(r.id) id FROM (SELECT draw, {U(14, 'draw', 'draw')}*(SELECT sum(x) FROM event_points) u FROM (SELECT unnest(range((SELECT count(*) FROM part))) draw)) d ASOF JOIN (SELECT id, sum(x) OVER (ORDER BY id)-x lo FROM event_points) r ON d.u >= r.lo GROUP BY 1",
  lambda t: gen.choose_with(t.event_points(), "id", F.col("x"), t.n_points(), 14, by_start=True), "event_points", "", "draw id")
q("random_integers", f"SELECT id, CASE WHEN hi > lo THEN CAST(lo+floor({U(15, 'int')}*(hi-lo)::DOUBLE) AS BIGINT) END AS value FROM (SELECT p_partkey id, p_size lo, p_partkey % 100 hi FROM part)",
  lambda t: gen.with_random_integer(t.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("lo"), (F.col("p_partkey") % 100).alias("hi")), "id", "lo", "hi", 15).select("id", "value"), "", "", "id value")
