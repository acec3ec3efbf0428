"""Ranks, prefix sums, quantiles and previous rows without one task ever holding a whole table or key.

A global window sorts everything in one task, and a window per key does so for a key that owns a large
share of the rows. Both are split here: rows are cut into ranges, each range is ranked on its own, and a
small summary with one row per range supplies the offset.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from driftfield.session import cut_lineage

ROWS_PER_RANGE = 1_000_000
HOT_KEY_ROWS = 1_000_000
HOT_KEYS_BROADCAST = 200_000


def _split_points(df: DataFrame, col: str, rows_per_range: int) -> list[float]:
    """Cut values that split ``col`` into ranges of about ``rows_per_range`` rows."""
    n = df.count()
    ranges = -(-n // rows_per_range)
    if ranges <= 1:
        return []
    at = [i / ranges for i in range(1, ranges)]
    cuts = df.agg(F.percentile_approx(F.col(col).cast("double"), at, max(10_000, 10 * ranges)).alias("c")).first()["c"]
    return sorted(set(cuts or []))


def _with_range(df: DataFrame, col: str, cuts: list[float]) -> DataFrame:
    if not cuts:
        return df.withColumn("_range", F.lit(0))
    bucketizer = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")], inputCol="_rank_key", outputCol="_range_d", handleInvalid="keep"
    )
    ranged = bucketizer.transform(df.withColumn("_rank_key", F.col(col).cast("double")))
    return ranged.withColumn("_range", F.col("_range_d").cast("int")).drop("_rank_key", "_range_d")


def _offsets(ranged: DataFrame, amount: Column, n_ranges: int) -> tuple[list[float], float]:
    """Sum of ``amount`` over all earlier ranges, per range, and the grand total."""
    sums = {r["_range"]: r["s"] or 0 for r in ranged.groupBy("_range").agg(F.sum(amount).alias("s")).collect()}
    out, run = [], 0
    for i in range(n_ranges):
        out.append(run)
        run += sums.get(i, 0)
    return out, run


def number_rows(df: DataFrame, col: str, name: str = "rank", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """1-based position of each row in the order of a unique, non-null numeric column."""
    cuts = _split_points(df, col, rows_per_range)
    ranged = _with_range(df, col, cuts)
    offsets, _ = _offsets(ranged, F.lit(1), len(cuts) + 1)
    base = F.element_at(F.lit([int(o) for o in offsets]), F.col("_range") + 1)
    pos = F.row_number().over(W.partitionBy("_range").orderBy(col))
    return ranged.withColumn(name, (base + pos).cast("bigint")).drop("_range")


def number_sorted(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """0-based position of each row in any unique sort order.

    Rows are range-partitioned by the order and written with their partition number, so the ranges stay what
    they are however often they are read; each range is then numbered on its own and shifted by the sizes before.
    """
    keyed = df.withColumn("_key", F.struct(*order))
    ranged = cut_lineage(keyed.repartitionByRange("_key").withColumn("_range", F.spark_partition_id()))
    sizes = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}
    starts, run = [], 0
    for i in range(max(sizes, default=0) + 1):
        starts.append(run)
        run += sizes.get(i, 0)
    base = F.element_at(F.lit(starts), F.col("_range") + 1)
    pos = F.row_number().over(W.partitionBy("_range").orderBy("_key")) - 1
    return ranged.withColumn(name, (base + pos).cast("bigint")).drop("_range", "_key")


def prefix_sum(
    df: DataFrame, order: str, amount: str, name: str = "running", rows_per_range: int = ROWS_PER_RANGE, before: str | None = None
) -> tuple[DataFrame, float]:
    """Running total of ``amount`` in the order of a unique numeric column, and the grand total.

    With ``before`` the total up to the row before is added: exactly what that row has as ``name``, so intervals leave no gaps.
    """
    cuts = _split_points(df, order, rows_per_range)
    win = W.partitionBy("_range").orderBy(order)
    upto = F.sum(amount).over(win.rowsBetween(W.unboundedPreceding, W.currentRow))
    earlier = F.coalesce(F.sum(amount).over(win.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    ranged = _with_range(df, order, cuts).withColumns({"_in": upto.cast("double"), "_earlier": earlier.cast("double")})
    # a range's total is its last running total, not a sum in another order
    lasts = {r["_range"]: r["s"] or 0.0 for r in ranged.groupBy("_range").agg(F.max_by("_in", order).alias("s")).collect()}
    starts, run = [], 0.0
    for i in range(len(cuts) + 1):
        starts.append(run)
        run += lasts.get(i, 0.0)
    base = F.element_at(F.lit(starts), F.col("_range") + 1)
    out = ranged.withColumn(name, base + F.col("_in"))
    if before:
        out = out.withColumn(before, base + F.col("_earlier"))
    return out.drop("_range", "_in", "_earlier"), run


def first_rows(df: DataFrame, col: str, n: int, ties: str | None = None) -> DataFrame:
    """The n rows with the smallest values of ``col``, then of ``ties``. NULL and NaN are never among them.

    An approximate percentile drops what is surely beyond, and only the rest is sorted and numbered, by ranges.
    """
    value = F.col(col).cast("double")
    known = df.filter(value.isNotNull() & ~F.isnan(value))
    if n <= 0:
        return known.limit(0)
    total = known.count()
    if n >= total:
        return known
    share = n / total
    while share < 1.0:
        share = min(1.0, share * 1.05 + 0.001)
        cut = known.agg(F.percentile_approx(value, share, 10_000)).first()[0]
        few = known.filter(value <= F.lit(cut)) if share < 1.0 else known
        if share == 1.0 or few.count() >= n:
            break
    order = [F.col(col), *([F.col(ties)] if ties else [])]
    return number_sorted(few, order, "_pos").filter(F.col("_pos") < n).drop("_pos")


def join_per_key(rows: DataFrame, per_key: DataFrame, on: list[str] | str, how: str = "inner", hot: int = HOT_KEY_ROWS) -> DataFrame:
    """``rows`` with the columns of ``per_key``, which has one row per key.

    The rows of a key that has more than ``hot`` of them are dealt out by a hash, and the key's row is repeated as often. Which keys these
    are is counted first; up to HOT_KEYS_BROADCAST of them are broadcast, so their rows are dealt where they lie.
    """
    on = [on] if isinstance(on, str) else list(on)
    crowded = cut_lineage(rows.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / hot).alias("_of")).filter("_of > 1"))
    n = crowded.count()
    if n == 0:
        return rows.join(per_key, on, how)
    crowded = F.broadcast(crowded) if n <= HOT_KEYS_BROADCAST else crowded
    simple = [c for c, t in rows.dtypes if "map<" not in t]
    dealt = rows.join(crowded, on, "left").withColumn("_slot", F.pmod(F.xxhash64(*simple), F.coalesce("_of", F.lit(1)))).drop("_of")
    repeated = per_key.join(crowded, on, "left").withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_of", F.lit(1)) - 1))).drop("_of")
    return dealt.join(repeated, [*on, "_slot"], how).drop("_slot")


def exact_percentiles(
    df: DataFrame, col: str, at: list[float], rows_per_range: int = ROWS_PER_RANGE
) -> list[float | None]:
    """Exact percentiles with linear interpolation, NULL and NaN left out.

    Equal values are counted together first. Approximate cut points only decide the ranges; the ranges
    that hold a wanted rank are then walked exactly, so the answer does not depend on the cuts.
    """
    vals = df.select(F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    counts = vals.groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    cuts = _split_points(counts, "_v", rows_per_range)
    ranged = _with_range(counts, "_v", cuts)
    offsets, n = _offsets(ranged, F.col("_n"), len(cuts) + 1)
    if n == 0:
        return [None] * len(at)
    ranks = sorted({r for p in at for r in (int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1))})
    wanted = sorted({max(i for i, o in enumerate(offsets) if o <= r) for r in ranks})
    base = F.element_at(F.lit([int(o) for o in offsets]), F.col("_range") + 1)
    win = W.partitionBy("_range").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    walked = ranged.filter(F.col("_range").isin(wanted)).withColumn("_hi", base + F.sum("_n").over(win))
    hit = F.lit(False)
    for r in ranks:
        hit = hit | ((F.col("_hi") - F.col("_n") <= r) & (F.col("_hi") > r))
    rows = walked.filter(hit).select("_v", (F.col("_hi") - F.col("_n")).alias("lo"), F.col("_hi").alias("hi")).collect()

    def value(rank: int) -> float:
        return next(row["_v"] for row in rows if row["lo"] <= rank < row["hi"])

    out = []
    for p in at:
        exact = p * (n - 1)
        low = value(int(exact))
        high = value(min(int(exact) + 1, n - 1))
        out.append(low + (exact - int(exact)) * (high - low))
    return out


def number_steps(df: DataFrame, key: str, order: list[str], span: str, name: str = "t_idx") -> DataFrame:
    """0-based step number per key in the given order.

    ``span`` is a column that never falls along the order (a day, an hour): each (key, span) piece is
    numbered on its own, so a key that owns much of the table is shared by many tasks.
    """
    sizes = df.groupBy(key, span).agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(key).orderBy(span).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(key, span, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    within = F.row_number().over(W.partitionBy(key, span).orderBy(*order))
    return (
        df.withColumn("_pos", within)
        .join(starts, [key, span])
        .withColumn(name, (F.col("_start") + F.col("_pos") - 1).cast("bigint"))
        .drop("_start", "_pos")
    )


def with_previous(
    df: DataFrame, key: str, order: str, cols: list[str], span_rows: int = 65_536, name: str = "prev"
) -> DataFrame:
    """Add a struct ``prev`` with the given columns of the previous row of the same key (NULL at the first).

    Rows are cut at every ``span_rows`` values of the integer order column. Inside a piece it is a plain
    ``lag``; the first row of a piece takes the last row of the piece before, from a summary that has
    one row per piece.
    """
    pack = F.struct(*cols)
    cut = df.withColumn("_span", F.floor(F.col(order) / F.lit(span_rows)))
    lasts = cut.groupBy(key, "_span").agg(F.max_by(pack, F.col(order)).alias("_last"))
    before = lasts.select(key, "_span", F.lag("_last").over(W.partitionBy(key).orderBy("_span")).alias("_before"))
    inside = F.lag(pack).over(W.partitionBy(key, "_span").orderBy(order))
    return (
        cut.withColumn(name, inside)
        .join(before, [key, "_span"])
        .withColumn(name, F.coalesce(F.col(name), F.col("_before")))
        .drop("_span", "_before")
    )
