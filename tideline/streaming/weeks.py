"""Summaries of closed weeks, written once each.

A run reads the files that came since the last one, adds their rows to a staging table by week, and writes the summary of
every week that has closed and is not in the ledger. Rows of a week that was written before change nothing; they are kept
apart and counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Learners of whom one run writes summaries.
MOST = 500


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """week, learners and rows of each week that has been written."""
    return spark.read.schema("week date, learners long, rows long").parquet(f"{root}/ledger") if _exists(spark, f"{root}/ledger") else spark.createDataFrame([], "week date, learners long, rows long")


def summaries(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("user_id long, events long, concepts long, total double, week date").parquet(f"{root}/summaries")


def late_rows(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The rows that came after their week was written."""
    return spark.read.schema(schema.add("week", T.DateType())).parquet(f"{root}/late") if _exists(spark, f"{root}/late") else spark.createDataFrame([], schema.add("week", T.DateType()))


def write_closed_weeks(events: DataFrame, root: str, lateness: str = "1 day", most: int | None = MOST) -> int:
    """Runs the stream `events` (ts, user_id, concept, value) over what is new and returns how many weeks were written.

    A week (from Monday) is closed when an event was seen that is later than its end by `lateness`. Its summary has a row
    for each of the `most` learners with the smallest ids who took part (all, if None). Running again without new files
    writes nothing; a batch that runs again after a failure replaces what it wrote.
    """
    spark = events.sparkSession
    schema = T.StructType(list(events.schema.fields))
    written = 0

    def add(frame: DataFrame, batch: int) -> None:
        nonlocal written
        rows = frame.withColumn("week", F.date_trunc("week", "ts").cast("date"))
        done = [r["week"] for r in ledger(spark, root).collect()]  # a row for each week
        late = F.col("week").isin(done) if done else F.lit(False)
        rows.where(~late).write.mode("overwrite").partitionBy("week").parquet(f"{root}/staged/part={batch}")
        if done and not (after := rows.where(late)).isEmpty():
            after.write.mode("overwrite").partitionBy("week").parquet(f"{root}/late/part={batch}")
        staged = spark.read.schema(schema.add("week", T.DateType())).option("basePath", f"{root}/staged").parquet(f"{root}/staged/part=*")
        newest = staged.agg(F.max("ts")).first()[0]
        closed = F.col("week") + F.expr("INTERVAL 7 DAYS") + F.expr(f"INTERVAL {lateness}") <= F.lit(newest)
        ready = staged.where(closed & (~F.col("week").isin(done) if done else F.lit(True)))
        for week in [r["week"] for r in ready.select("week").distinct().collect()]:
            own = ready.where(F.col("week") == F.lit(week))
            all_of = own.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("concept").alias("concepts"), F.bround(F.sum("value"), 2).alias("total"))
            chosen = all_of if most is None else all_of.orderBy("user_id").limit(most)
            path = f"{root}/summaries/week={week}"
            chosen.write.mode("overwrite").parquet(path)
            n = spark.read.parquet(path).count()
            spark.createDataFrame([(week, n, own.count())], "week date, learners long, rows long").coalesce(1).write.mode("append").parquet(f"{root}/ledger")
            written += 1

    q = events.writeStream.option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).foreachBatch(add).start()
    q.awaitTermination()
    return written
