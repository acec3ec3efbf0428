"""Queries: kernels and density estimates (D), bandwidths."""

from __future__ import annotations


from pyspark.sql import functions as F

from driftfield.functions import kernels
from driftfield.functions.vector import magnitude
from driftfield.model import Box
from driftfield.operators import density as den
from driftfield.plans.registry import query

PI = "pi()"
D3 = "sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z))"
D2 = "sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y))"


def cubic(r: str, h: str, dim: int) -> str:
    c = f"10/(7*{PI}*{h}*{h})" if dim == 2 else f"1/({PI}*{h}*{h}*{h})"
    return f"({c}*CASE WHEN {r}/{h} <= 1 THEN 1-1.5*({r}/{h})*({r}/{h})+0.75*({r}/{h})*({r}/{h})*({r}/{h}) WHEN {r}/{h} <= 2 THEN 0.25*(2-{r}/{h})*(2-{r}/{h})*(2-{r}/{h}) ELSE 0 END)"


def wend(r: str, h: str, dim: int, support: str = "h") -> str:
    if support == "h":
        c = f"7/({PI}*{h}*{h})" if dim == 2 else f"21/(2*{PI}*{h}*{h}*{h})"
        return f"({c}*pow(greatest(1-{r}/{h},0),4)*(1+4*{r}/{h}))"
    c = f"7/(4*{PI}*{h}*{h})" if dim == 2 else f"21/(16*{PI}*{h}*{h}*{h})"
    return f"({c}*pow(greatest(1-{r}/{h}/2,0),4)*(1+2*{r}/{h}))"


def gauss(r: str, h: str, dim: int) -> str:
    return f"(pow({PI},{-dim / 2})/pow({h},{dim})*exp(-({r}/{h})*({r}/{h})))"


def _radius(t):
    return t.cloud().select("id", magnitude(F.col("x"), F.col("y"), F.col("z")).alias("r"))


_K = [(f"cubic{d}", cubic("r", "0.3::DOUBLE", d), lambda r, d=d: kernels.cubic_spline(r, 0.3, d)) for d in (2, 3)]
_K += [(f"wend{d}", wend("r", "0.3::DOUBLE", d, "2h"), lambda r, d=d: kernels.wendland_c2(r, 0.3, d)) for d in (2, 3)]
_K += [(f"wendh{d}", wend("r", "0.3::DOUBLE", d), lambda r, d=d: kernels.wendland_c2(r, 0.3, d, "h")) for d in (2, 3)]
_K += [(f"gauss{d}", gauss("r", "0.3::DOUBLE", d), lambda r, d=d: kernels.sph_gaussian(r, 0.3, d)) for d in (2, 3)]
_K += [(f"mean{d}", f"pow(2*{PI},{-d / 2})*exp(-0.5*r*r/0.09::DOUBLE)", lambda r, d=d: kernels.gaussian_kernel(r * r / 0.09, d)) for d in (2, 3)]
query("kernels", f"SELECT id, {', '.join(f'{e} {n}' for n, e, _ in _K)} FROM (SELECT id, sqrt(x*x+y*y+z*z) r FROM cloud)", "cloud", " ".join(n for n, _, _ in _K), "id")(
    lambda t: _radius(t).select("id", *[fn(F.col("r")).alias(n) for n, _, fn in _K])
)

query(
    "bandwidths",
    "SELECT n, s*pow(n,-1/7.0) scott, s*pow(n,-1/7.0)*pow(0.8,1/7.0) silverman FROM (SELECT count(*) n, (stddev_samp(x)+stddev_samp(y)+stddev_samp(z))/3 s FROM event_points)",
    "event_points", "scott silverman", "n",
)(lambda t: den.bandwidths(t.event_points()))
query("fixed_smoothing", "SELECT least(greatest(2*e/pow(n,1/3.0),0.01),0.1::DOUBLE*e) h FROM (SELECT ((max(x)-min(x))+(max(y)-min(y))+(max(z)-min(z)))/3 e, count(*) n FROM event_points)", "event_points", "h")(
    lambda t: den.fixed_smoothing(t.event_points())
)

SCOTT = "(SELECT (stddev_samp(x)+stddev_samp(y)+stddev_samp(z))/3*pow(count(*),-1/7.0) h FROM {src})"
# every pair, no cut-off: what is left out on our side is below double precision
KDE = f"SELECT q.id, pow(2*{PI},-1.5)*sum(exp(-0.5*({D3}/h)*({D3}/h)))/count(*) rho FROM {{q}} q, {{p}} p, {{h}} GROUP BY 1"
query("kde_at_cloud", KDE.format(q="cloud", p="cloud", h=SCOTT.format(src="cloud")), "cloud", "rho", "id", digits=8)(
    lambda t: den.kde_at(t.cloud(), t.cloud(), den.scott_bandwidth(t.cloud()))
)
query("kde_at_events", KDE.format(q="points", p="event_points", h="(SELECT 4.0::DOUBLE h)"), "points event_points", "rho", "id", digits=8)(
    lambda t: den.kde_at(t.event_points(), t.points(), 4.0)
)
query("kde_at_density", f"SELECT id, rho/(0.05::DOUBLE*0.05::DOUBLE*0.05::DOUBLE) rho FROM ({KDE.format(q='cloud', p='cloud', h='(SELECT 0.05::DOUBLE h)')})", "cloud", "rho", "id")(
    lambda t: den.kde_at(t.cloud(), t.cloud(), 0.05, scale="density")
)

query(
    "kde_slab",
    """SELECT q.id, sum(exp(-0.5::DOUBLE*((q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y))/(0.3::DOUBLE*0.3::DOUBLE)))/(2*pi())/count(*) rho
FROM points q, (SELECT x, y FROM cloud WHERE abs(z-0.1::DOUBLE) <= 0.1) p GROUP BY q.id""",
    "points cloud", "rho", "id",
)(lambda t: den.kde_slab(t.cloud(), t.points().select("id", F.col("x").alias("p"), F.col("y").alias("q")), "xy", 0.1, 0.2, 0.3))

EB = "(SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1, min(z) z0, max(z) z1 FROM {src})"


def _grid_sql(nx: int, ny: int, nz: int, src: str) -> str:
    at = lambda a, n: f"{a}0+{a}i*({a}1-{a}0)/{n - 1}" if n > 1 else f"{a}0"
    return f"(SELECT xi gx, yi gy, zi gz, {at('x', nx)} x, {at('y', ny)} y, {at('z', nz)} z FROM {EB.format(src=src)}, range({nx}) a(xi), range({ny}) b(yi), range({nz}) c(zi))"


def _kde_grid_sql(shape, src: str, dim: int, h: str) -> str:
    d = D3 if dim == 3 else D2
    nx, ny, nz = shape
    cell = f"((x1-x0)/{nx - 1})*((y1-y0)/{ny - 1})" + (f"*((z1-z0)/{nz - 1})" if dim == 3 else "")
    area = "(x1-x0)*(y1-y0)" + ("*(z1-z0)" if dim == 3 else "")
    return f"""WITH r AS (SELECT q.gx, q.gy, q.gz, q.x, q.y, q.z, pow(2*{PI},{-dim / 2})*sum(exp(-0.5*({d}/h)*({d}/h)))/count(*) rho FROM {_grid_sql(nx, ny, nz, src)} q, {src} p, {h} GROUP BY ALL)
SELECT gx, gy, gz, x, y, z, rho*({area})/((SELECT sum(rho) FROM r)*{cell}) rho FROM r, {EB.format(src=src)}"""


FLAT = "(SELECT id, x, y, 0.0::DOUBLE z FROM event_points)"
query("kde_grid_3d", _kde_grid_sql((8, 7, 6), "event_points", 3, SCOTT.format(src="event_points")), "event_points", "x y z rho", "gx gy gz")(
    lambda t: den.kde_grid(t.event_points(), den.scott_bandwidth(t.event_points()), (8, 7, 6))
)
query("kde_grid_2d", _kde_grid_sql((20, 15, 1), FLAT, 2, "(SELECT (stddev_samp(x)+stddev_samp(y))/2*pow(count(*),-1/6.0) h FROM event_points)"), "event_points", "x y z rho", "gx gy gz")(
    lambda t: den.kde_grid(den.as_plane(t.event_points()), den.scott_bandwidth(t.event_points(), ("x", "y")), (20, 15, 1), 2)
)
query("kde_grid_points", f"SELECT gx, gy, gz, x, y, z FROM {_grid_sql(9, 8, 7, 'event_points')}", "event_points", "x y z", "gx gy gz")(
    lambda t: den.grid_nodes(t.event_points(), Box.around(t.event_points()), (9, 8, 7)).drop("id")
)

NN = "SELECT id, 1.2::DOUBLE*d h FROM (SELECT p.id, {d} d, row_number() OVER (PARTITION BY p.id ORDER BY {d}) r FROM {src} p, {src} q) WHERE r={k}+1".replace("{d}", D3)
query("adaptive_h", NN.format(src="cloud", k=16), "cloud", "h", "id")(lambda t: den.adaptive_h(t.cloud(), 16))


def _sph_sql(kernel: str, reach: str, src: str, queries: str, d: str = D3) -> str:
    return f"SELECT id, coalesce(rho,0) rho FROM {queries} LEFT JOIN (SELECT q.id, sum(p.mass*{kernel}) rho FROM {queries} q, {src} p WHERE {d} <= {reach} GROUP BY 1) USING (id)"


FIX = "(SELECT *, 0.12::DOUBLE h FROM cloud)"


def _with_h(df, h=0.12):
    return df.withColumn("h", F.lit(h))


for _name, _k, _reach in (("cubic_spline", cubic(D3, "p.h", 3), "2*p.h"), ("wendland", wend(D3, "p.h", 3), "p.h"), ("gaussian", gauss(D3, "p.h", 3), "2*p.h")):
    query(f"sph_{_name}", _sph_sql(_k, _reach, FIX, "cloud"), "cloud", "rho", "id", digits=5)(
        lambda t, n=_name: den.sph_at(_with_h(t.cloud()), t.cloud(), n)
    )
query("sph_events", _sph_sql(cubic(D3, "p.h", 3), "2*p.h", "(SELECT *, 1.0::DOUBLE mass, 1.5::DOUBLE h FROM event_points)", "points"), "points event_points", "rho", "id", digits=6)(
    lambda t: den.sph_at(_with_h(t.event_points().withColumn("mass", F.lit(1.0)), 1.5), t.points())
)
# a few source sizes, so balls live on several levels
VARY = "(SELECT *, 0.02::DOUBLE*pow(2,id%5) h FROM cloud)"
query("sph_varying_h", _sph_sql(cubic(D3, "p.h", 3), "2*p.h", VARY, "cloud"), "cloud", "rho", "id", digits=4)(
    lambda t: den.sph_at(t.cloud().withColumn("h", F.lit(0.02) * F.pow(F.lit(2.0), F.col("id") % 5)), t.cloud())
)
query("sph_adaptive", _sph_sql(cubic(D3, "p.h", 3), "2*p.h", f"(SELECT cloud.*, h FROM cloud JOIN ({NN.format(src='cloud', k=8)}) USING (id))", "cloud"), "cloud", "rho", "id", digits=5)(
    lambda t: den.sph_at(t.cloud().join(den.adaptive_h(t.cloud(), 8), "id"), t.cloud())
)
SLAB = "(SELECT id, x, y, 0.0::DOUBLE z, mass, 0.1::DOUBLE h FROM cloud WHERE abs(z) <= 0.05)"
query("sph_slab_2d", _sph_sql(cubic(D2, "p.h", 2), "2*p.h", SLAB, "cloud", D2), "cloud", "rho", "id", digits=5)(
    lambda t: den.sph_at(_with_h(den.slab_plane(t.cloud(), "xy", 0.0, 0.1), 0.1), den.as_plane(t.cloud()), dim=2)
)
EXT = "(SELECT (max(x)-min(x))*(max(y)-min(y))*(max(z)-min(z)) e, count(*) n FROM cloud)"
query("sph_normalised", f"SELECT id, rho*e/n rho FROM ({_sph_sql(cubic(D3, 'p.h', 3), '2*p.h', FIX, 'cloud')}), {EXT}", "cloud", "rho", "id")(
    lambda t: den.sph_normalised(den.sph_at(_with_h(t.cloud()), t.cloud()), t.cloud().count(), t.cloud())
)

YZ = f"""WITH b AS {EB.format(src='wide_points')}, s AS (SELECT w.y x, w.z y FROM wide_points w, b WHERE abs(w.x-0.7::DOUBLE*x1) < 0.05::DOUBLE*(x1-x0)),
 h AS (SELECT (stddev_samp(x)+stddev_samp(y))/2*pow(count(*),-1/6.0) h FROM s),
 g AS (SELECT yi gx, zi gy, y0+yi*(y1-y0)/29 x, z0+zi*(z1-z0)/29 y FROM b, range(30) r1(yi), range(30) r2(zi)),
 r AS (SELECT q.gx, q.gy, q.x, q.y, 1/(2*{PI})*sum(exp(-0.5*({D2}/h)*({D2}/h)))/count(*) rho FROM g q, s p, h GROUP BY ALL)
SELECT gx, gy, x, y, least(rho, (SELECT quantile_cont(rho, 0.95) FROM r)) rho FROM r"""
query("yz_slice_density", YZ, "wide_points", "x y rho", "gx gy")(lambda t: den.yz_slice_density(t.wide_points(), resolution=30, at_least=10))

REPORT = f"""WITH k AS (SELECT q.gx, q.gy, pow(2*{PI},-1.5)*sum(exp(-0.5*(({D3})/h)*(({D3})/h)))/count(*) rho FROM (SELECT gx, gy, x, y, 0.0::DOUBLE z FROM {_grid_sql(20, 20, 1, 'cloud')}) q, cloud p, {SCOTT.format(src='cloud')} GROUP BY ALL),
 s AS (SELECT id, rho*e/n rho FROM ({_sph_sql(cubic(D3, 'p.h', 3), '2*p.h', '(SELECT id, x, y, z, 1.0::DOUBLE mass, 0.1::DOUBLE h FROM cloud)', 'cloud')}), {EXT})
SELECT 'kde' source, count(*) n, avg(rho) mean, min(rho) min, max(rho) max FROM k UNION ALL SELECT 'sph', count(*), avg(rho), min(rho), max(rho) FROM s"""
query("density_report", REPORT, "cloud", "mean min max", "n", digits=5)(lambda t: den.density_report(t.cloud(), resolution=20, h=0.1))
