"""Clustered tables and the checked append of streams."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftfield.plans import q_sources
from driftfield.session import scratch_path
from driftfield.sources import clustered
from driftfield.streaming import stream

XYZ = "id bigint, x double, y double, z double"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(12)
    rows = [(i, *map(float, r)) for i, r in enumerate(np.vstack([rng.uniform(0, 10, (3000, 3)), rng.normal(5, 0.1, (1000, 3))]))]
    rows += [(9000, None, 1.0, 1.0), (9001, float("nan"), 1.0, 1.0), (9002, 5.0, 5.0, None)]
    df = spark.createDataFrame(rows, XYZ).repartition(5)
    path = scratch_path(spark, "clustered")
    clustered.write_clustered(df, path, 32)
    return rows, df, path


@pytest.mark.parametrize(
    "ranges", [{"x": (1.0, 2.0), "y": (1.0, 2.0), "z": (1.0, 2.0)}, {"x": (None, 0.5)}, {"z": (5.0, 5.0)}, {"y": (99.0, None)}, {"id": (100, 120), "x": (0.0, 10.0)}, {}]
)
def test_ranges_equal_a_filter(spark, table, ranges):
    rows, df, path = table
    names = ["id", "x", "y", "z"]

    def fits(r):
        for c, (lo, hi) in ranges.items():
            v = r[names.index(c)]
            if v is None or v != v or (lo is not None and v < lo) or (hi is not None and v > hi):
                return False
        return True

    assert sorted(r["id"] for r in clustered.read_ranges(spark, path, ranges).collect()) == sorted(r[0] for r in rows if fits(r))


def test_a_small_box_reads_few_files(spark, table):
    _, df, path = table
    everything = clustered.files_touched(spark, path, {})
    few = clustered.files_touched(spark, path, {"x": (1.0, 1.5), "y": (1.0, 1.5), "z": (1.0, 1.5)})
    assert len(everything) >= 24 and 1 <= len(few) <= 4
    read = clustered.read_ranges(spark, path, {"x": (1.0, 1.5), "y": (1.0, 1.5), "z": (1.0, 1.5)})
    assert {f.rsplit("/", 1)[1] for f in read.inputFiles()} == {f.rsplit("/", 1)[1] for f in few}
    assert spark.read.parquet(path).count() == df.count()


def write(spark, folder, rows):
    spark.createDataFrame(rows, stream.ROW_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_checked_append_refuses_and_restarts(spark):
    folder, out, ckpt = (scratch_path(spark, c) for c in ("in", "out", "ckpt"))
    row = lambda p, n, x=0.0: (p, n, float(n), x, 0.0, 0.0)
    run = lambda **o: stream.append_checked_stream(stream.read_rows(spark, folder), out, ckpt, **o).awaitTermination()
    write(spark, folder, [row(1, 0), row(1, 1), row(2, 0)])
    run()
    write(spark, folder, [row(1, 1), row(1, 2), row(2, 1), row(2, 1, 5.0), row(3, 0)])
    run()
    write(spark, folder, [row(2, 2)])
    run()  # from the checkpoint: earlier files are not read again
    kept = sorted((r["particle_id"], r["t_idx"]) for r in stream.read_checked(spark, out).collect())
    assert kept == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]
    assert {r["reason"]: r["n"] for r in stream.read_refused(spark, out).collect()} == {"unknown particle": 1, "overlapping step": 1, "repeated row": 1}


def test_checked_append_can_stop(spark):
    folder, out, ckpt = (scratch_path(spark, c) for c in ("in", "out", "ckpt"))
    particles = spark.createDataFrame([(1,)], "particle_id bigint")
    write(spark, folder, [(1, 0, 0.0, 0.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 0.0, 0.0)])
    with pytest.raises(Exception, match="rows refused"):
        stream.append_checked_stream(stream.read_rows(spark, folder), out, ckpt, particles, refuse="raise").awaitTermination()
    with pytest.raises(Exception):
        stream.read_checked(spark, out).collect()


def test_parts_arrive_in_order_whatever_the_clocks_say(spark):
    """A file source goes by modification times: those of a part are one, a second after the part before."""
    rows = spark.range(400).select(
        (F.col("id") % 20).alias("particle_id"), F.floor(F.col("id") / 20).alias("t_idx"), (F.col("id") / 40).alias("t"), *[F.lit(0.0).alias(a) for a in "xyz"]
    )
    folder = q_sources._arrivals(SimpleNamespace(spark=spark), rows, "floor(t / 3)")
    files = spark.read.parquet(folder).select(F.floor(F.col("t") / 3).alias("part"), F.col("_metadata.file_modification_time").alias("at"))
    at = [sorted(r["at"]) for r in files.groupBy("part").agg(F.collect_set("at").alias("at")).orderBy("part").collect()]
    assert len(at) == 4 and all(len(a) == 1 for a in at)
    assert {(b[0] - a[0]).total_seconds() for a, b in zip(at, at[1:])} == {1.0}
