import numpy as np
import pytest
from pyspark.sql import functions as F

from driftfield.model import Box
from driftfield.operators import points, ranks


def test_number_rows_over_many_ranges(spark):
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("k"))
    got = {r["k"]: r["rank"] for r in ranks.number_rows(df, "k", rows_per_range=9).collect()}
    assert got == {k: n + 1 for n, k in enumerate(sorted(got))}


def test_number_sorted_by_text(spark):
    df = spark.range(50).select(F.format_string("n%02d", F.col("id") * 7 % 50).alias("name"))
    got = {r["name"]: r["rank"] for r in ranks.number_sorted(df, [F.col("name")]).collect()}
    assert got == {f"n{i:02d}": i for i in range(50)}


@pytest.mark.parametrize("rows_per_range", [5, 1_000_000])
def test_exact_percentiles_with_ties(spark, rows_per_range):
    vals = [float(v % 17) for v in range(60)] + [3.0] * 40 + [None, float("nan")]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    clean = [v for v in vals if v is not None and v == v]
    at = [0.0, 0.05, 0.5, 0.95, 1.0]
    assert ranks.exact_percentiles(df, "v", at, rows_per_range) == pytest.approx(list(np.percentile(clean, [100 * p for p in at])))
    assert ranks.exact_percentiles(df.limit(0), "v", [0.5]) == [None]


def test_prefix_sum_over_many_ranges(spark):
    df = spark.range(40).withColumn("w", (F.col("id") % 5).cast("double"))
    got, total = ranks.prefix_sum(df, "id", "w", rows_per_range=6)
    want = np.cumsum([i % 5 for i in range(40)])
    assert [r["running"] for r in got.orderBy("id").collect()] == list(want) and total == want[-1]


def test_prefix_sums_leave_no_gaps(spark):
    df = spark.range(300).withColumn("w", 1.0 / (F.col("id") % 7 + 3))
    got, total = ranks.prefix_sum(df, "id", "w", "hi", rows_per_range=11, before="lo")
    rows = got.orderBy("id").collect()
    assert rows[0]["lo"] == 0.0 and rows[-1]["hi"] == total
    assert all(a["hi"] == b["lo"] for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("n", [0, 1, 31, 89, 90, 95, 500])
def test_first_rows_order_ties_and_nulls(spark, n):
    rows = [(i, float(i % 9)) for i in range(90)] + [(90, None), (91, float("nan")), (92, None)]
    df = spark.createDataFrame(rows, "id bigint, v double")
    want = sorted((v, i) for i, v in rows if v is not None and v == v)[:n]
    assert sorted((r["v"], r["id"]) for r in ranks.first_rows(df, "v", n, "id").collect()) == want


def test_first_rows_of_many(spark):
    df = spark.range(60_000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(1 << 30)))
    values = sorted(r["v"] for r in df.collect())
    for n in (9_999, 10_001, 30_000):
        assert sorted(r["v"] for r in ranks.first_rows(df, "v", n).collect()) == values[:n]


def test_sampler_accepts_only_its_support(spark):
    box = Box((0, 0, 0), (1, 1, 1))
    narrow = lambda df: df.withColumn("pdf", (F.col("x") < 0.01).cast("double"))
    got = points.density_sampled_points(spark, 300, box, narrow, seed=3)
    row = got.agg(F.count("*"), F.max("x"), F.countDistinct("id")).first()
    assert row[0] == row[2] == 300 and row[1] < 0.01
    spike = lambda df: df.withColumn("pdf", F.when(F.col("x") < 0.001, 50.0).otherwise(1.0))  # above every probe
    share = points.density_sampled_points(spark, 4000, box, spike, seed=5, probes=5).filter("x < 0.001").count() / 4000
    assert 0.02 < share < 0.08
    with pytest.raises(ValueError):
        points.density_sampled_points(spark, 10, box, lambda df: df.withColumn("pdf", F.when(F.col("id") < 0, 1.0).otherwise(-1.0)), max_rounds=2)


def test_every_draw_meets_one_interval(spark):
    df = spark.range(500).withColumn("w", 1.0 / (F.col("id") + 3))
    got = points.choose_with(df, "id", F.col("w"), 3000, seed=2).collect()
    assert sorted(r["draw"] for r in got) == list(range(3000))


@pytest.mark.parametrize("span", [1, 4, 1000])
def test_previous_row_across_pieces_and_gaps(spark, span):
    rows = [(k, t, float(k * 100 + t)) for k, ts in ((1, range(0, 40)), (2, [0, 9, 10, 31]), (3, [5])) for t in ts]
    df = spark.createDataFrame(rows, "k bigint, t bigint, v double")
    got = {(r["k"], r["t"]): r["prev"]["v"] if r["prev"] else None for r in ranks.with_previous(df, "k", "t", ["v"], span).collect()}
    want = {}
    for k in (1, 2, 3):
        last = None
        for kk, t, v in sorted(rows):
            if kk == k:
                want[(k, t)] = last
                last = v
    assert got == want


def test_steps_are_numbered_across_spans(spark):
    df = spark.range(30).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"), F.floor(F.col("id") / 4).alias("span"))
    got = {r["o"]: r["t_idx"] for r in ranks.number_steps(df, "k", ["o"], "span").collect()}
    assert got == {o: o // 2 for o in range(30)}


def test_sampler_keeps_the_bound_of_its_probes_if_asked(spark):
    """the list of candidates is not started again; those above the bound count as at the bound."""
    spike = lambda df: df.withColumn("pdf", F.when(F.col("x") < 0.001, 50.0).otherwise(1.0))
    got = points.density_sampled_points(spark, 4000, Box((0, 0, 0), (1, 1, 1)), spike, seed=5, probes=5, raise_bound=False)
    row = got.agg(F.count("*"), F.avg((F.col("x") < 0.001).cast("double")), F.max("id")).first()
    assert row[0] == 4000 and row[1] < 0.01 and row[2] < 4700
