import pytest
from pyspark.sql import functions as F

from driftfield.operators import cells, paths, sample
from driftfield.session import cut_lineage, scratch_path
from driftfield.sources import scan, sinks
from driftfield.streaming import stream

TRAJ = "particle_id bigint, t_idx bigint, t double, x double, y double, z double"


@pytest.fixture(scope="module")
def traj(spark):
    rows = [(p, t, t * 0.5, float(p + t), float(t * t % 7), float(p)) for p in range(4) for t in range(90 if p == 0 else 12)]
    return spark.createDataFrame(rows, TRAJ)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_append_checks_particles_and_steps(spark, traj, tmp_path):
    path = str(tmp_path / "traj")
    sinks.write_trajectory(traj.filter("t_idx < 6"), path)
    with pytest.raises(ValueError):
        sinks.append_trajectory(traj.filter("t_idx >= 6 AND particle_id > 0"), path)
    with pytest.raises(ValueError):
        sinks.append_trajectory(traj.filter("t_idx >= 5"), path)
    sinks.append_trajectory(traj.filter("t_idx >= 6"), path)
    assert spark.read.parquet(path).count() == traj.count()


def test_time_slices_are_pruned_by_partition(spark, traj, tmp_path):
    path = str(tmp_path / "steps")
    sinks.write_series(traj, path)
    text = plan_of(paths.at_time(spark.read.parquet(path), 3))
    assert "PartitionFilters: [isnotnull(t_idx" in text


def test_long_paths_are_cut_and_whole(traj):
    got = sinks.lines_layout(traj, points_per_line=16).collect()
    assert max(len(r["path"]) for r in got) <= 16
    assert sum(r["n"] for r in got if r["particle_id"] == 0) == 90
    whole = {r["particle_id"]: r["path_length"] for r in paths.path_length(traj).collect()}
    assert {r["particle_id"]: r["path_length"] for r in got} == pytest.approx(whole)


def test_path_length_does_not_depend_on_the_cut(traj):
    a = {r["particle_id"]: r["path_length"] for r in paths.path_length(traj, 5).collect()}
    b = {r["particle_id"]: r["path_length"] for r in paths.path_length(traj.repartition(9)).collect()}
    assert a == pytest.approx(b)


def test_check_finds_what_is_wrong(spark, traj):
    bad = traj.withColumn("x", F.when((F.col("particle_id") == 1) & (F.col("t_idx") == 2), F.lit(float("nan"))).otherwise(F.col("x")))
    row = paths.trajectory_check(bad).first()
    assert row["n_not_finite"] == 1 and not row["valid"] and row["n_uneven_steps"] == 78
    assert paths.trajectory_check(traj.filter("t_idx < 12")).first()["valid"]
    assert paths.convergence(traj.filter("t_idx < 5"), at_least=10).first()["status"] == "insufficient_data"
    assert paths.convergence(traj.filter("t_idx < 5")).first()["status"] == "success"


def test_merge_refuses_other_particles_and_times(traj):
    with pytest.raises(ValueError):
        paths.merge_time(traj, traj.filter("particle_id < 2"))
    with pytest.raises(ValueError):
        paths.merge_particles(traj, traj.withColumn("t", F.col("t") + 1))


def test_clusters_cover_all_particles(spark):
    rows = [(p, t, float(t), float(p % 2 * 10 + t * 0.01), float(p % 3) * 0.1, 0.0) for p in range(20) for t in range(5)]
    got = paths.clusters(spark.createDataFrame(rows, TRAJ), k=2).collect()
    assert sum(r["n"] for r in got if r["step"] == "final") == 20
    assert {r["kept_share"] for r in got} == {1.0}


def test_manifest_choices(spark, tmp_path):
    for name in ("a_2.pvtu", "a_10.pvtu", "a_2.vtu", "a_1.vtu"):
        (tmp_path / name).write_text("x")
    files = scan.file_manifest(spark, str(tmp_path))
    kept = scan.natural_order(scan.prefer_parallel(files)).orderBy("t_idx").collect()
    assert [r["name"] for r in kept] == ["a_2.pvtu", "a_10.pvtu"]
    only_vtu = scan.prefer_parallel(files.filter("ext = 'vtu'"))
    assert only_vtu.count() == 2
    with pytest.raises(ValueError):
        scan.detect_vector_column(files)
    with pytest.raises(ValueError):
        scan.open_table(spark, "x.vtk")


def test_a_table_stored_in_parts_is_one_entry(spark, tmp_path):
    """part files are not entries of their own."""
    for name in ("one.parquet", "many.parquet/part-0.parquet", "many.parquet/x=1/part-1", "plain/two.parquet", "plain/note.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("abc")
    for root in (f"{tmp_path}", f"file://{tmp_path}/"):
        got = {r["name"]: (r["ext"], r["length"], r["path"].split("/", 3)[-1].endswith(r["name"])) for r in scan.file_manifest(spark, root, "*.parquet").collect()}
        assert got == {"one.parquet": ("parquet", 3, True), "many.parquet": ("parquet", 6, True), "two.parquet": ("parquet", 3, True)}
    assert scan.file_manifest(spark, str(tmp_path)).count() == 4


def test_late_rows_are_counted_and_a_rerun_changes_nothing(spark, tmp_path):
    src = str(tmp_path / "in")
    batches = [[(1, 0, 0.0, 0.0, 0.0, 0.0), (1, 1, 1.0, 3.0, 4.0, 0.0)], [(1, 3, 3.0, 3.0, 4.0, 2.0), (2, 0, 0.0, 0.0, 0.0, 0.0)], [(1, 2, 2.0, 9.0, 9.0, 9.0), (1, 4, 4.0, 3.0, 4.0, 5.0)]]
    for rows in batches:
        spark.createDataFrame(rows, TRAJ).coalesce(1).write.mode("append").parquet(src)
    state, ckpt = str(tmp_path / "state"), str(tmp_path / "ckpt")
    for _ in range(2):
        stream.running_path_length(stream.read_rows(spark, src), state, ckpt).awaitTermination()
    got = {r["particle_id"]: (r["path_length"], r["n_late"]) for r in stream.read_running(spark, state).collect()}
    assert got == {1: (5.0 + 2.0 + 3.0, 1), 2: (0.0, 0)}


class _Session:
    """Just enough of a session to ask where scratch data goes."""

    def __init__(self, named, master):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext = type("C", (), {"master": master, "applicationId": "app-test"})()


def test_scratch_goes_to_the_folder_the_cluster_names(spark):
    assert scratch_path(_Session("hdfs://x/ckpt", "yarn"), "a").startswith("hdfs://x/ckpt/a-")
    with pytest.raises(RuntimeError):
        scratch_path(_Session(None, "yarn"), "a")
    assert "driftfield" in scratch_path(_Session(None, "local[2]"), "a")
    assert cut_lineage(spark.range(5)).count() == 5


def test_plans_have_no_cross_joins_and_no_python(spark, cloud):
    _, df = cloud
    grid = spark.range(8).select(*[(F.floor(F.col("id") / d) % 2).cast("int").alias(c) for c, d in zip("ijk", (4, 2, 1))], *[F.lit(1.0).alias(c) for c in "uvw"])
    from driftfield.model import GridMeta

    plans = [
        cells.radius_join(df, df, 0.2),
        cells.knn(df, df, 2),
        cells.neighbour_counts(df, df, 0.2),
        sample.trilinear_sample(df, grid, GridMeta((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (2, 2, 2))),
        paths.path_length(spark.createDataFrame([], TRAJ)),
    ]
    for p in map(plan_of, plans):
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
        assert "Python" not in p and "InPandas" not in p


def test_sampling_a_small_grid_does_not_shuffle_the_points(spark, cloud):
    _, df = cloud
    from driftfield.model import GridMeta

    corners = spark.createDataFrame([(0, 0, 0, *[1.0] * 24)], "ci bigint, cj bigint, ck bigint, " + ", ".join(f"{c}{n} double" for c in "uvw" for n in range(8)))
    meta = GridMeta((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (2, 2, 2))
    assert "Exchange hashpartitioning" not in plan_of(sample.sample_corners(df, corners, meta))
    huge = GridMeta((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (3000, 3000, 3000))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan_of(sample.sample_corners(df, corners, huge))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
