"""Stateful streams: windowed rollups, sessions, deduplication, issue lifecycles and learners' mastery."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.learning import applied, clamped_sum, evidence_weight, merged_sums


def events_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = 1) -> DataFrame:
    """The events table read as a stream, its time as a timestamp that watermarks accept; None takes all files at once,
    so that no file can make another's rows late."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(f"{path}*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def whole_span(spark: SparkSession, sf_dir: str) -> str:
    """A lateness that covers the events' whole time span, so that no order of files makes a row late."""
    ts = F.col("ts").cast("timestamp").cast("double")
    span = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max(ts) - F.min(ts)).first()[0]
    return f"{int(span or 0) + 1} seconds"


def rollup(stream: DataFrame, keys: list[str], value: str, width: str, lateness: str, slide: str | None = None) -> DataFrame:
    """count, sum, min and max of a value by event-time window and keys; rows later than the watermark are left out."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = stream.withWatermark("ts", lateness).groupBy(window.alias("w"), *keys)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("lo"), F.max(value).alias("hi")).select(F.col("w.start").alias("bucket"), *keys, "n", "total", "lo", "hi")


def sessions(stream: DataFrame, key: str, gap: str, lateness: str) -> DataFrame:
    g = stream.withWatermark("ts", lateness).groupBy(key, F.session_window("ts", gap).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("started"), "n")


def deduplicated(stream: DataFrame, keys: list[str], lateness: str) -> DataFrame:
    """One row for each key among the rows that arrive within the lateness of each other."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def routed(events: DataFrame, rooms: list) -> DataFrame:
    """A row for each event and room that it goes to; null rooms are left out."""
    return events.withColumn("room", F.explode(F.array_distinct(F.array_compact(F.array(*rooms)))))


def mastery_days(stream: DataFrame, lateness: str) -> DataFrame:
    """user_id, concept, day, sum and n: each day's evidence folded by itself, as L.clamped_sum().

    The state is the evidence of days that may still change; a day is folded in the order of its events, whatever the
    order of arrival, and its state is dropped once the watermark has passed it. In update mode a later row of a day
    replaces the ones before.
    """
    rows = stream.withWatermark("ts", lateness).withColumn("w", evidence_weight(F.col("event_type")))
    days = rows.groupBy(F.window("ts", "1 day").alias("_day"), "user_id", "concept").agg(F.collect_list(F.struct("ts", "event_id", "w")).alias("_x"))
    weights = F.transform(F.sort_array("_x"), lambda x: x["w"])
    return days.select("user_id", "concept", F.col("_day.start").alias("day"), clamped_sum(weights).alias("sum"), F.size("_x").alias("n"))


def mastery(days: DataFrame) -> DataFrame:
    """user_id, concept, mastery and evidence from a row for each day: the days' folds merged in their order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("day", "sum"))), lambda x: x["sum"])
    g = days.groupBy("user_id", "concept").agg(merged_sums(ordered).alias("_total"), F.sum("n").cast("int").alias("evidence"))
    return g.select("user_id", "concept", applied(F.col("_total")).alias("mastery"), "evidence")


def issues(stream: DataFrame) -> DataFrame:
    """fingerprint, status, occurrences, first_seen and last_seen: a new fingerprint opens an issue, later ones are
    counted, and one after a resolution (a row with resolved true) opens it again."""

    def fold(key, frames, state):
        status, n, first, last = state.get if state.exists else ("new", 0, None, None)
        rows = pd.concat(list(frames)).sort_values("ts")
        for ts, resolved in zip(rows.ts, rows.resolved, strict=True):
            if resolved:
                status = "resolved" if n else status
                continue
            status = {"new": "open", "resolved": "reopened"}.get(status, status)
            n, first, last = n + 1, first or ts.to_pydatetime(), ts.to_pydatetime()
        state.update((status, n, first, last))
        yield pd.DataFrame({"fingerprint": [key[0]], "status": [status], "occurrences": [n], "first_seen": [first], "last_seen": [last]})

    schema = "fingerprint string, status string, occurrences int, first_seen timestamp, last_seen timestamp"
    return stream.groupBy("fingerprint").applyInPandasWithState(fold, schema, "s string, n int, f timestamp, l timestamp", "update", "NoTimeout")


def drained(stream: DataFrame, mode: str, path: str, latest: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over all that its source has, into a table at path, and returns the table.

    Each batch is written to a folder of its own number, so a batch that runs again replaces itself. latest picks the
    rows that count where later batches update earlier ones; it sees their batch as a column.
    """
    spark = stream.sparkSession

    def write(frame: DataFrame, batch: int) -> None:
        frame.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/rows/part={batch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state-{uuid.uuid4().hex}").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{path}/rows/*")
    return (latest(rows) if latest else rows).drop("batch")
