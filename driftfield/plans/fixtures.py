"""The library's table shapes (grid field, time series, mesh, points, trajectories) derived from the given tables.

``Tables`` builds them with DataFrame code; ``CTE`` holds the same shapes as SQL for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftfield.model import Box, GridMeta
from driftfield.operators.ranks import number_steps
from driftfield.session import cut_lineage

META = GridMeta((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (10, 11, 9))
BOX = META.box
YEARS = 7
# The six tetrahedra of a cube along its main diagonal, as the two inner corners between
# corner 0 (low) and corner 7 (high); corner number = 4 * di + 2 * dj + dk.
CUBE_TETS = ((4, 6), (4, 5), (2, 6), (2, 3), (1, 5), (1, 3))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        self._cells: DataFrame | None = None

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # F1 ------------------------------------------------------------------------------------------
    def _node_rows(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.select(
            F.floor((F.col("l_quantity") - 1) / 5).cast("bigint").alias("i"),
            F.round(F.col("l_discount") * 100).cast("bigint").alias("j"),
            F.round(F.col("l_tax") * 100).cast("bigint").alias("k"),
            "l_extendedprice", "l_linenumber", F.dayofyear("l_shipdate").alias("doy"), F.year("l_shipdate").alias("yr"),
        )

    def _averages(self, df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            (F.avg("l_extendedprice") / 52500 - 1).alias("u"),
            (F.avg("doy") / 183 - 1).alias("v"),
            ((F.avg("l_linenumber") - 4) / 3).alias("w"),
        )

    def grid(self) -> DataFrame:
        return self._averages(self._node_rows(), "i", "j", "k")

    # F2 ------------------------------------------------------------------------------------------
    def series(self) -> DataFrame:
        """(t_idx, t, node_id, i, j, k, u, v, w), complete over nodes and years."""
        rows = self._node_rows().withColumn("t_idx", (F.col("yr") - 1995).cast("bigint"))
        own = self._averages(rows, "t_idx", "i", "j", "k").withColumnsRenamed({c: f"_{c}" for c in "uvw"})
        base = self.nodes().join(self.grid(), ["i", "j", "k"], "left").withColumn("t_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(YEARS - 1).cast("bigint"))))
        full = base.join(own, ["t_idx", "i", "j", "k"], "left")
        return full.select(
            "t_idx", F.col("t_idx").cast("double").alias("t"), "node_id", "i", "j", "k",
            *[F.coalesce(F.col(f"_{c}"), F.col(c), F.lit(0.0)).alias(c) for c in "uvw"],
        )

    def samples(self) -> DataFrame:
        return self.series().drop("i", "j", "k")

    def times(self) -> DataFrame:
        years = self.raw("lineitem").select((F.year("l_shipdate") - 1995).cast("bigint").alias("t_idx")).distinct()
        return years.select("t_idx", F.col("t_idx").cast("double").alias("t"))

    def nodes(self) -> DataFrame:
        """Every node of the F1 grid: (node_id, i, j, k, x, y, z), all combinations of the indices that line items have per axis."""
        if self._cells is None:  # written: a query asks for the nodes several times, and line items are many
            self._cells = cut_lineage(self._node_rows().select("i", "j", "k").distinct())
        seen = self._cells.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in "ijk"])  # a row with 10, 11 and 9 values
        df = seen.select(F.explode("i").alias("i"), "j", "k").select("i", F.explode("j").alias("j"), "k").select("i", "j", F.explode("k").alias("k"))
        _, ny, nz = META.shape
        df = df.select(((F.col("i") * ny + F.col("j")) * nz + F.col("k")).alias("node_id"), "i", "j", "k")
        return df.withColumns({a: F.col(c).cast("double") for a, c in zip("xyz", "ijk")})

    def node_values(self) -> DataFrame:
        """(node_id, i, j, k, x, y, z, u, v, w) with missing values 0."""
        return self.nodes().join(self.grid(), ["i", "j", "k"], "left").select(
            "node_id", "i", "j", "k", "x", "y", "z", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in "uvw"]
        )

    # F3 ------------------------------------------------------------------------------------------
    def points(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.raw("part").select(
            key.alias("id"), ((F.col("p_size") - 1) / 49.0 * 9).alias("x"), (key % 1000 / 1000.0 * 10).alias("y"),
            (key % 77 / 77.0 * 8).alias("z"), F.lit(1.0).alias("mass"),
        )

    def n_points(self) -> int:
        return self.raw("part").count()

    def box(self) -> Box:
        """Bounds of the F3 points: the generators below fill the data's own box with as many points as there are rows."""
        return Box.around(self.points())

    def item_points(self) -> DataFrame:
        """One point per line item (many copies of a position, so joins meet real duplicates)."""
        return self.raw("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            ((F.col("l_quantity") - 1) / 49.0 * 9).alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"),
        )

    def wide_points(self) -> DataFrame:
        """F3 stretched about the box centre, so a good part lies outside the box on every side."""
        p = self.points()
        mids = {a: (lo + hi) / 2 for a, lo, hi in BOX.axes()}
        return p.withColumns({a: F.lit(m) + (F.col(a) - F.lit(m)) * F.lit(1.75) for a, m in mids.items()})

    # F4 ------------------------------------------------------------------------------------------
    def tets(self) -> DataFrame:
        """Every cell in six tetrahedra along its main diagonal: (elem_id, nodes)."""
        nx, ny, nz = META.shape
        low = self.nodes().filter((F.col("i") < nx - 1) & (F.col("j") < ny - 1) & (F.col("k") < nz - 1))
        df = low.select((((F.col("i") * (ny - 1)) + F.col("j")) * (nz - 1) + F.col("k")).alias("cell"), "i", "j", "k")
        df = df.select("cell", "i", "j", "k", F.posexplode(F.lit([list(t) for t in CUBE_TETS])).alias("ord", "inner"))

        def corner(c):
            di, dj, dk = (F.floor(c / 4) % 2, F.floor(c / 2) % 2, c % 2)
            return ((F.col("i") + di) * (ny * nz) + (F.col("j") + dj) * nz + F.col("k") + dk).cast("bigint")

        nodes = F.array(corner(F.lit(0)), corner(F.col("inner")[0]), corner(F.col("inner")[1]), corner(F.lit(7)))
        return df.select((F.col("cell") * 6 + F.col("ord")).alias("elem_id"), nodes.alias("nodes"))

    # F5 ------------------------------------------------------------------------------------------
    def cloud(self) -> DataFrame:
        e = F.col("embedding")
        return self.raw("embeddings").select(
            F.col("vec_id").alias("id"), *[e[n].cast("double").alias(a) for n, a in enumerate("xyz")], (F.lit(1.0) + F.col("label")).alias("mass")
        )

    # F6 ------------------------------------------------------------------------------------------
    def event_rows(self) -> DataFrame:
        # both ends are wall-clock times, so the session's time zone cancels
        micros = F.unix_micros(F.col("ts").cast("timestamp"))
        start = F.unix_micros(F.expr("cast(timestamp_ntz'2024-01-01 00:00:00' as timestamp)"))
        return self.raw("events").select(
            F.col("user_id").alias("particle_id"), "event_id", "ts",
            ((micros - start) / F.lit(86400000000.0)).alias("t"), F.col("value").alias("x"),
            F.get_json_object("props", "$.k").cast("double").alias("y"), F.length("event_type").cast("double").alias("z"),
        )

    def event_points(self) -> DataFrame:
        return self.event_rows().select(F.col("event_id").alias("id"), "x", "y", "z")

    def traj(self) -> DataFrame:
        rows = self.event_rows().withColumn("_day", F.floor("t"))
        return number_steps(rows, "particle_id", ["ts", "event_id"], "_day").select("particle_id", "t_idx", "t", "x", "y", "z")

    # F7 ------------------------------------------------------------------------------------------
    def file_names(self) -> DataFrame:
        """One .pvtu name per order and a .vtu twin for even keys: (name)."""
        key = F.col("o_orderkey")
        base = F.concat(F.lit("run7_"), key.cast("string"))
        both = F.when(key % 2 == 0, F.array(F.lit(".pvtu"), F.lit(".vtu"))).otherwise(F.array(F.lit(".pvtu")))
        return self.raw("orders").select(F.explode(F.transform(both, lambda e: F.concat(base, e))).alias("name"))


CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "grid": ((), """
SELECT CAST(floor((l_quantity-1)/5) AS BIGINT) i, CAST(round(l_discount*100) AS BIGINT) j, CAST(round(l_tax*100) AS BIGINT) k,
       avg(l_extendedprice)/52500-1 u, avg(dayofyear(l_shipdate))/183-1 v, (avg(l_linenumber)-4)/3 w
FROM lineitem GROUP BY 1,2,3"""),
    "nodes": ((), """
SELECT (i*11+j)*9+k node_id, i, j, k, i::DOUBLE x, j::DOUBLE y, k::DOUBLE z
FROM (SELECT DISTINCT CAST(floor((l_quantity-1)/5) AS BIGINT) i FROM lineitem), (SELECT DISTINCT CAST(round(l_discount*100) AS BIGINT) j FROM lineitem),
 (SELECT DISTINCT CAST(round(l_tax*100) AS BIGINT) k FROM lineitem)"""),
    "node_values": (("grid", "nodes"), """
SELECT n.node_id, n.i, n.j, n.k, n.x, n.y, n.z, coalesce(g.u,0) u, coalesce(g.v,0) v, coalesce(g.w,0) w
FROM nodes n LEFT JOIN grid g USING (i,j,k)"""),
    "series": (("node_values",), """
SELECT y.t_idx, y.t_idx::DOUBLE t, n.node_id, n.i, n.j, n.k, coalesce(o.u,n.u) u, coalesce(o.v,n.v) v, coalesce(o.w,n.w) w
FROM node_values n CROSS JOIN range(7) y(t_idx) LEFT JOIN (
  SELECT year(l_shipdate)-1995 t_idx, CAST(floor((l_quantity-1)/5) AS BIGINT) i, CAST(round(l_discount*100) AS BIGINT) j, CAST(round(l_tax*100) AS BIGINT) k,
         avg(l_extendedprice)/52500-1 u, avg(dayofyear(l_shipdate))/183-1 v, (avg(l_linenumber)-4)/3 w
  FROM lineitem GROUP BY 1,2,3,4) o ON o.t_idx=y.t_idx AND o.i=n.i AND o.j=n.j AND o.k=n.k"""),
    "times": ((), "SELECT DISTINCT year(l_shipdate)-1995 t_idx, (year(l_shipdate)-1995)::DOUBLE t FROM lineitem"),
    "points": ((), """
SELECT p_partkey id, (p_size-1)/49.0::DOUBLE*9 x, (p_partkey%1000)/1000.0::DOUBLE*10 y, (p_partkey%77)/77.0::DOUBLE*8 z, 1.0::DOUBLE mass FROM part"""),
    "item_points": ((), """
SELECT l_orderkey*10+l_linenumber id, (l_quantity-1)/49.0::DOUBLE*9 x, l_discount*100 y, l_tax*100 z FROM lineitem"""),
    "wide_points": (("points",), "SELECT id, 4.5::DOUBLE+(x-4.5::DOUBLE)*1.75::DOUBLE x, 5.0::DOUBLE+(y-5.0::DOUBLE)*1.75::DOUBLE y, 4.0::DOUBLE+(z-4.0::DOUBLE)*1.75::DOUBLE z, mass FROM points"),
    "tets": (("nodes",), """
SELECT cell*6+ord elem_id, c0 n0, ((i+((a>>2)&1))*11+j+((a>>1)&1))*9+k+(a&1) n1, ((i+((b>>2)&1))*11+j+((b>>1)&1))*9+k+(b&1) n2, ((i+1)*11+j+1)*9+k+1 n3
FROM (SELECT (i*10+j)*8+k cell, i, j, k, node_id c0 FROM nodes WHERE i < 9 AND j < 10 AND k < 8) c,
     (VALUES (0,4,6),(1,4,5),(2,2,6),(3,2,3),(4,1,5),(5,1,3)) o(ord,a,b)"""),
    "cloud": ((), "SELECT vec_id id, embedding[1]::DOUBLE x, embedding[2]::DOUBLE y, embedding[3]::DOUBLE z, 1.0::DOUBLE+label mass FROM embeddings"),
    "event_rows": ((), """
SELECT user_id particle_id, event_id, ts, (epoch_us(ts)-1704067200000000)/86400000000.0::DOUBLE t, value x,
       CAST(json_extract(props,'$.k') AS DOUBLE) y, length(event_type)::DOUBLE z FROM events"""),
    "event_points": (("event_rows",), "SELECT event_id id, x, y, z FROM event_rows"),
    "traj": (("event_rows",), """
SELECT particle_id, row_number() OVER (PARTITION BY particle_id ORDER BY ts, event_id)-1 t_idx, t, x, y, z FROM event_rows"""),
    "ids": ((), "SELECT unnest(range((SELECT count(*) FROM part))) id"),
    "box": (("points",), "SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1, min(z) z0, max(z) z1 FROM points"),
    "file_names": ((), """
SELECT 'run7_'||o_orderkey||'.pvtu' AS name FROM orders UNION ALL SELECT 'run7_'||o_orderkey||'.vtu' FROM orders WHERE o_orderkey%2=0"""),
}
