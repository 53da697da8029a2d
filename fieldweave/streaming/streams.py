"""Streaming forms: intake of event files, windowed rates and counts, drift baselines, duplicates, and routed output."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.operators.quality_checks import validate


def read_events(spark: SparkSession, folder: str, schema, name: str = "*.parquet", per_trigger: int | None = None) -> DataFrame:
    """Files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(folder)


def timed(events: DataFrame, column: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The time column as an instant with a watermark: rows later than `late` are left out of what is closed."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def null_rates(events: DataFrame, columns: list[str], column: str = "ts", window: str = "1 day") -> DataFrame:
    """Share of nulls of each column by window."""
    return events.groupBy(F.window(column, window)).agg(F.count("*").alias("n"), *[F.avg(F.col(c).isNull().cast("double")).alias(f"{c}_null_rate") for c in columns]).select(F.col("window.start").alias("period"), "n", *[f"{c}_null_rate" for c in columns])


def counts(events: DataFrame, by: list[str], value: str, column: str = "ts", window: str = "1 day") -> DataFrame:
    """Rows and sum of a value by window and group."""
    return events.groupBy(F.window(column, window), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("period"), *by, "n", "total")


def sessions(events: DataFrame, by: str, column: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """Sessions of each key: runs of rows less than `gap` apart."""
    return events.groupBy(F.session_window(column, gap), by).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def without_duplicates(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    return events.dropDuplicatesWithinWatermark(keys)


def drift(events: DataFrame, by: str, value: str, column: str = "ts", window: str = "1 day", limit: float = 4.0) -> DataFrame:
    """Each key's closed windows against all windows before: period, the key, rows, mean, seen (the rows
    before), baseline (their mean; null for the first), strays.

    A window strays if its mean is more than `limit` standard errors from the baseline, by the spread of the values before. `events` needs
    a watermark on `column`. A window is closed when the watermark has passed its end, and windows are compared in the order of time,
    so the result doesn't depend on batches of any kind. Nulls are left out. The state of a key is the sums of what is closed and of each
    open window.
    """

    def step(key, frames, state):
        import pandas as pd

        n, total, squares, *kept = state.get if state.exists else (0, 0.0, 0.0, [], [], [], [], [])
        open_ = {(a, b): [c, t, q] for a, b, c, t, q in zip(*kept, strict=True)}
        for frame in frames:
            sums = frame.assign(c=1, q=frame["x"] ** 2).groupby(["a", "b"])[["c", "x", "q"]].sum()
            for at, row in zip(sums.index, sums.itertuples(index=False), strict=True):
                open_[at] = [u + v for u, v in zip(open_.get(at, (0, 0.0, 0.0)), row, strict=True)]
        out, closed = [], state.getCurrentWatermarkMs()
        for a, b in sorted(at for at in open_ if at[1] <= closed):
            c, t, q = open_.pop((a, b))
            before = total / n if n else None
            error = (max(squares / n - before * before, 0.0) / c) ** 0.5 if n else 0.0
            out.append((pd.Timestamp(a, unit="ms"), key[0], int(c), t / c, int(n), before, bool(n and abs(t / c - before) > limit * error)))
            n, total, squares = n + c, total + t, squares + q
        left = sorted(open_)
        state.update((int(n), float(total), float(squares), [int(a) for a, _ in left], [int(b) for _, b in left], *([kind(open_[at][i]) for at in left] for i, kind in enumerate((int, float, float)))))
        if left:
            state.setTimeoutTimestamp(left[0][1])
        yield pd.DataFrame(out, columns=["period", by, "rows", "mean", "seen", "baseline", "strays"])

    at = F.window(column, window)
    rows = events.select(column, by, F.col(value).cast("double").alias("x"), at.alias("w")).where("x is not null").select(column, by, F.unix_millis("w.start").alias("a"), F.unix_millis("w.end").alias("b"), "x")
    kind = events.schema[by].dataType.simpleString()
    result = f"period timestamp, `{by}` {kind}, rows bigint, mean double, seen bigint, baseline double, strays boolean"
    return rows.groupBy(by).applyInPandasWithState(step, result, "n bigint, total double, squares double, a array<bigint>, b array<bigint>, c array<bigint>, t array<double>, q array<double>", "append", "EventTimeTimeout")


def route(events: DataFrame, folder: str | Path, checkpoint: str, required: list[str], types: dict[str, str], partition: str, alert: Callable[[int, float], None] | None = None, alert_rate: float = 0.05):
    """Write good rows by event type, others to dead letters, and each batch's scores by event type (rows, rejected, share) for dashboards.

    Calls `alert` with batch and share of rejected rows where that passes the limit.

    Each batch overwrites its own folder, so one that runs twice leaves one copy.
    """

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            good, bad = validate(df, required, types)
            good.write.mode("overwrite").partitionBy(partition).parquet(f"{folder}/clean/batch={number}")
            bad.write.mode("overwrite").parquet(f"{folder}/dead_letters/batch={number}")
            scores = good.select(partition, F.lit(0).alias("bad")).union(bad.select(partition, F.lit(1))).groupBy(partition).agg(F.count("*").alias("n"), F.sum("bad").alias("rejected"))
            scores.withColumn("share", F.col("rejected") / F.col("n")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/scores/batch={number}")
            n, rejected = df.sparkSession.read.parquet(f"{folder}/scores/batch={number}").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("rejected"), F.lit(0))).first()
            share = rejected / n if n else 0.0
            if alert and share > alert_rate:
                alert(number, share)
        finally:
            df.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that a bounded stream gives, as a table of Parquet files in `folder`, a place that all executors share; for back-fills and tests.

    `complete` results replace each other; the last one stays.
    """
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/rows").outputMode(mode).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/rows")).outputMode(mode).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
