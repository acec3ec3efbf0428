"""Tables stored along a space-filling curve, with the bounds of every file: a box or time scan reads the files it touches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftfield.model import AXES

CURVE_BITS = 12  # cells per axis: 2 ** CURVE_BITS
#: Beside the data, in a folder that readers of the table skip.
BOUNDS = "_bounds"


def curve_key(df: DataFrame, by: tuple[str, ...], bits: int = CURVE_BITS) -> Column:
    """Place along a Z-order curve over the table's own range of the columns: their cells' bits in turn. NULL or NaN in one: NULL.

    One row with the ranges comes to the driver.
    """
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    row = df.agg(*[f(value(c)).alias(f"{n}{i}") for i, c in enumerate(by) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    key = F.lit(0).cast("bigint")
    for i, c in enumerate(by):
        lo, hi = row[f"lo{i}"] or 0.0, row[f"hi{i}"] or 0.0
        cell = F.least(F.floor((value(c) - F.lit(lo)) * F.lit((1 << bits) / max(hi - lo, 1e-300))), F.lit((1 << bits) - 1)).cast("bigint")
        for b in range(bits):
            key = key + F.shiftleft(F.shiftright(cell, b).bitwiseAND(1), b * len(by) + i)
    return key


def write_clustered(df: DataFrame, path: str, files: int, by: tuple[str, ...] = AXES, mode: str = "errorifexists") -> None:
    """Write ``df`` in about ``files`` Parquet files, each a stretch of the curve over the columns ``by``, and the bounds of each file.

    Rows that have no place on the curve are kept, in files of their own or at the end of others.
    """
    keyed = df.withColumn("_curve", curve_key(df, by))
    keyed.repartitionByRange(files, "_curve").sortWithinPartitions("_curve").drop("_curve").write.mode(mode).parquet(path)
    spark = df.sparkSession
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c))
    bounds = [f(known(c)).alias(f"{n}_{c}") for c in by for n, f in (("lo", F.min), ("hi", F.max))]
    stored = spark.read.schema(df.schema).parquet(path)
    stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"), *bounds).coalesce(1).write.mode(mode).parquet(f"{path}/{BOUNDS}")


def files_touched(spark: SparkSession, path: str, ranges: dict[str, tuple[float | None, float | None]]) -> list[str]:
    """The files whose bounds overlap all ranges (None: open on that side). Their names alone come to the driver."""
    bounds = spark.read.parquet(f"{path}/{BOUNDS}")
    tests = [F.lit(True)]
    for c, (lo, hi) in ranges.items():
        if f"lo_{c}" not in bounds.columns:
            continue  # the table is not clustered by it: every file may hold it
        if lo is not None:
            tests.append(F.col(f"hi_{c}") >= F.lit(lo))
        if hi is not None:
            tests.append(F.col(f"lo_{c}") <= F.lit(hi))
    return sorted(r["file"] for r in bounds.filter(reduce(lambda a, b: a & b, tests)).select("file").collect())


def read_ranges(spark: SparkSession, path: str, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """The rows with every column of ``ranges`` between its two values (ends included), from the files that can hold such rows."""
    whole = spark.read.parquet(path)
    files = files_touched(spark, path, ranges)
    if not files:
        return whole.limit(0)
    out = spark.read.schema(whole.schema).parquet(*files)
    for c, (lo, hi) in ranges.items():
        value = F.col(c)
        fits = value.isNotNull() & ~F.isnan(value.cast("double"))
        if lo is not None:
            fits = fits & (value >= F.lit(lo))
        if hi is not None:
            fits = fits & (value <= F.lit(hi))
        out = out.filter(fits)
    return out
