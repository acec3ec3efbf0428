"""Streams of trajectory rows that arrive as Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from driftfield.functions.vector import distance
from driftfield.model import AXES
from driftfield.operators.paths import PID
from driftfield.operators.ranks import with_previous
from driftfield.session import cut_lineage

ROW_SCHEMA = "particle_id bigint, t_idx bigint, t double, x double, y double, z double"


def read_rows(spark: SparkSession, folder: str, files_per_trigger: int = 1, schema: str = ROW_SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def append_trajectory_stream(rows: DataFrame, out: str, checkpoint: str):
    """Append arriving rows to a trajectory table stored by runs of 64 steps (exactly once, by the file sink's log)."""
    stored = rows.withColumn("t_bucket", F.floor(F.col("t_idx") / 64).cast("int"))
    return (
        stored.writeStream.format("parquet").outputMode("append").partitionBy("t_bucket")
        .option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    )


LAST_SCHEMA = "particle_id bigint, t_idx bigint, batch_no bigint"
REASONS = ("unknown particle", "overlapping step", "repeated row")


def append_checked_stream(rows: DataFrame, out: str, checkpoint: str, particles: DataFrame | None = None, refuse: str = "count"):
    """Append arriving rows under the contract of the batch form: known particles, and steps later than the ones the table has.

    Known are the particles of ``particles``, else those of the first micro-batch. A row whose step its particle has reached already overlaps;
    of rows of one particle and step in a micro-batch one stays. Refused rows are counted by reason, or, with ``refuse='raise'``, stop the
    stream before anything of their micro-batch is written.

    Each micro-batch writes its rows, its counts and the last steps that it changed under its own number, and reads those of earlier ones only:
    one that is run again after a failure overwrites itself, so every key is stored once. See ``read_checked`` and ``read_refused``.
    """
    if refuse not in ("count", "raise"):
        raise ValueError("refuse must be count or raise")
    spark = rows.sparkSession

    def append(batch: DataFrame, n: int) -> None:
        batch = cut_lineage(batch)
        last = _latest(spark, f"{out}/last", LAST_SCHEMA, n)
        seen = last.select(F.col(PID), F.col("t_idx").alias("_last"))
        if particles is not None:
            known = particles.select(PID).distinct().join(seen, PID, "left")
        elif n == 0 or not _written(spark, f"{out}/last", n):
            known = batch.select(PID).distinct().withColumn("_last", F.lit(None).cast("bigint"))
        else:
            known = seen
        same = W.partitionBy(PID, "t_idx").orderBy("t", *AXES)
        tagged = batch.join(known.withColumn("_known", F.lit(True)), PID, "left").withColumn("_n", F.row_number().over(same))
        reason = F.when(F.col("_known").isNull(), REASONS[0]).when(F.col("t_idx") <= F.col("_last"), REASONS[1]).when(F.col("_n") > 1, REASONS[2])
        tagged = cut_lineage(tagged.withColumn("_reason", reason))
        refused = tagged.filter("_reason IS NOT NULL").groupBy(F.col("_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
        if refuse == "raise":
            bad = {r["reason"]: r["n"] for r in refused.collect()}  # a row per reason
            if bad:
                raise ValueError(f"rows refused: {bad}")
        fresh = tagged.filter("_reason IS NULL").select(*batch.columns)
        stored = fresh.withColumn("t_bucket", F.floor(F.col("t_idx") / 64).cast("int"))
        stored.write.mode("overwrite").partitionBy("t_bucket").parquet(f"{out}/rows/batch={n}")
        refused.write.mode("overwrite").parquet(f"{out}/refused/batch={n}")
        moved = fresh.groupBy(PID).agg(F.max("t_idx").alias("t_idx")).withColumn("batch_no", F.lit(n).cast("bigint"))
        if n % FULL_EVERY == 0:
            still = last.join(moved.select(PID), PID, "left_anti").withColumn("batch_no", F.lit(n).cast("bigint"))
            moved = moved.unionByName(still.select(*moved.columns))
        moved.write.mode("overwrite").parquet(f"{out}/last/batch={n}")

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _written(spark: SparkSession, path: str, n: int) -> bool:
    """Whether a batch before n has stored any particle."""
    return n > 0 and not _latest(spark, path, LAST_SCHEMA, n).isEmpty()


def read_checked(spark: SparkSession, out: str, schema: str = ROW_SCHEMA) -> DataFrame:
    """The rows that ``append_checked_stream`` has stored."""
    rows = spark.read.schema(f"{schema}, batch bigint, t_bucket int").parquet(f"{out}/rows")
    return rows.drop("batch", "t_bucket")


def read_refused(spark: SparkSession, out: str) -> DataFrame:
    """(reason, n) over all micro-batches."""
    return spark.read.schema("reason string, n bigint, batch bigint").parquet(f"{out}/refused").groupBy("reason").agg(F.sum("n").alias("n"))


STATE_SCHEMA = "particle_id bigint, t_idx bigint, x double, y double, z double, path_length double, n_late bigint, batch_no bigint"


FULL_EVERY = 50  # micro-batches between complete state tables


def _state_before(spark: SparkSession, state_path: str, n: int) -> DataFrame:
    """Latest state row per particle after batches 0 .. n-1: the last complete table and the changes since."""
    return _latest(spark, state_path, STATE_SCHEMA, n)


def _latest(spark: SparkSession, path: str, schema: str, n: int) -> DataFrame:
    if n <= 0:
        return spark.createDataFrame([], schema)
    first = (n - 1) // FULL_EVERY * FULL_EVERY
    rows = spark.read.schema(schema).parquet(*[f"{path}/batch={b}" for b in range(first, n)])
    latest = F.max_by(F.struct(*rows.columns), "batch_no").alias("s")
    return rows.groupBy(PID).agg(latest).select("s.*")


def read_running(spark: SparkSession, state_path: str) -> DataFrame:
    """(particle_id, t_idx, x, y, z, path_length, n_late) after the last batch."""
    last = spark.read.schema(STATE_SCHEMA).parquet(f"{state_path}/batch=*").agg(F.max("batch_no")).first()[0]
    return _state_before(spark, state_path, -1 if last is None else last + 1).drop("batch_no")


def running_path_length(rows: DataFrame, state_path: str, checkpoint: str):
    """Per particle the last row and the running path length: each micro-batch writes the particles it changed.

    Every FULL_EVERY batches the whole state is written, so a reader needs that table and the few since.
    A batch that is run again after a failure overwrites its own table and reads only earlier ones, so
    steps are never counted twice. Rows must come in step order per particle; rows not later than the
    stored step are counted as late and dropped.
    """
    spark = rows.sparkSession

    def merge(batch: DataFrame, n: int) -> None:
        new = batch.select(PID, "t_idx", *AXES)
        every = _state_before(spark, state_path, n)
        full = n % FULL_EVERY == 0
        old = every if full else every.join(new.select(PID).distinct(), PID, "left_semi")
        tagged = new.join(old.select(PID, F.col("t_idx").alias("_last")), PID, "left").withColumn(
            "_late", F.col("_last").isNotNull() & (F.col("t_idx") <= F.col("_last"))
        )
        late = tagged.filter("_late").groupBy(PID).agg(F.count(F.lit(1)).alias("_more_late"))
        fresh = tagged.filter(~F.col("_late")).select(PID, "t_idx", *AXES)
        # the stored last row is the first "previous" row of the batch
        run = with_previous(fresh.unionByName(old.select(PID, "t_idx", *AXES)), PID, "t_idx", list(AXES))
        d = distance(*[F.col(a) for a in AXES], *[F.col(f"prev.{a}") for a in AXES])
        grown = run.groupBy(PID).agg(
            F.max("t_idx").alias("t_idx"), *[F.max_by(a, "t_idx").alias(a) for a in AXES], F.coalesce(F.sum(d), F.lit(0.0)).alias("_more")
        )
        merged = grown.join(old.select(PID, "path_length", "n_late"), PID, "left").join(late, PID, "left").select(
            PID, "t_idx", *AXES,
            (F.coalesce("path_length", F.lit(0.0)) + F.col("_more")).alias("path_length"),
            (F.coalesce("n_late", F.lit(0)) + F.coalesce("_more_late", F.lit(0))).cast("bigint").alias("n_late"),
            F.lit(n).cast("bigint").alias("batch_no"),
        )
        merged.write.mode("overwrite").parquet(f"{state_path}/batch={n}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_cell_counts(rows: DataFrame, ts: str, size: float, window: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """(window_start, cx, cy, cz, n): points per cell and tumbling window of event time, with a watermark."""
    cells = {f"c{a}": F.floor(F.col(a) / F.lit(float(size))).cast("bigint") for a in AXES}
    return (
        rows.withWatermark(ts, lateness).withColumns(cells)
        .groupBy(F.window(ts, window).alias("win"), "cx", "cy", "cz")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("win.start").alias("window_start"), "cx", "cy", "cz", "n")
    )


def drain_to_table(counts: DataFrame, out: str, checkpoint: str):
    """Append closed windows to a Parquet table."""
    return counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
