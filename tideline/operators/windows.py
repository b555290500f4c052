"""Ordered operators: fills, trends, anomalies, streaks, sampling and interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forward_filled(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each row's columns, or together those of the last row before it in which one of them is set."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    any_set = F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()
    state = F.last(F.when(any_set, F.struct(*columns)), ignorenulls=True).over(w)
    return df.withColumn("_state", state).select(*[c for c in df.columns if c not in columns], *[F.coalesce(F.col(c), F.col(f"_state.{c}")).alias(c) for c in columns])


def with_next(df: DataFrame, key: str, value: str, name: str, parts: int | None = None) -> DataFrame:
    """Adds the value of the row with the next greater key, over the whole table; null for the last row.

    The key is a number, unique and not null. Rows are dealt to ranges between its quantiles; a range's last row takes
    the first value of the next range that has rows, of which there are `parts` at most."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.approxQuantile(key, [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    ranged = df.withColumn("_part", part)
    firsts = ranged.groupBy("_part").agg(F.min_by(value, key).alias("_first"))
    after = firsts.select("_part", F.lead("_first").over(Window.orderBy("_part")).alias("_after"))  # a row for each range
    near = ranged.withColumn("_lead", F.lead(F.struct(value)).over(Window.partitionBy("_part").orderBy(key)))
    return near.join(F.broadcast(after), "_part", "left").withColumn(name, F.when(F.col("_lead").isNotNull(), F.col(f"_lead.{value}")).otherwise(F.col("_after"))).drop("_part", "_lead", "_after")


def ordered_list(value: str, *order: str) -> Column:
    """An aggregate: the group's values in the given order."""
    return F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"])


def middle(values: Column) -> Column:
    """Median of an array, the mean of the middle two for an even number."""
    s, n = F.sort_array(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def ewma(values: Column, alpha: float = 0.3, threshold: float = 3.0) -> Column:
    """Struct (ewma, score, anomaly) of the last value: its distance from the average in scaled median residuals.

    Fewer than five values are no anomaly and have no score."""
    start = F.struct(F.get(values, F.lit(0)).alias("e"), F.array().cast("array<double>").alias("r"))

    def step(a, v):
        e = alpha * v + (1 - alpha) * a["e"]
        return F.struct(e.alias("e"), F.concat(a["r"], F.array(F.abs(v - e))).alias("r"))

    folded = F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), start, step)
    result = F.transform(F.array(folded), lambda a: F.struct(a["e"].alias("e"), F.coalesce(F.nullif(middle(a["r"]), F.lit(0.0)), F.lit(1e-6)).alias("m")))
    last = F.element_at(values, -1)
    scored = F.transform(result, lambda a: F.struct(a["e"].alias("ewma"), (F.abs(last - a["e"]) / (1.4826 * a["m"])).alias("score")))[0]
    enough = F.size(values) >= 5
    return F.struct(F.when(enough, scored["ewma"]).alias("ewma"), F.when(enough, scored["score"]).alias("score"), F.coalesce(enough & (scored["score"] >= threshold), F.lit(False)).alias("anomaly"))


def mad(values: Column, threshold: float = 3.5) -> Column:
    """Struct (score, anomaly) of the last value against the median of all, in scaled median deviations."""
    m = middle(values)
    spread = F.coalesce(F.nullif(F.transform(F.array(m), lambda c: middle(F.transform(values, lambda v: F.abs(v - c))))[0], F.lit(0.0)), F.lit(1e-6))
    score = F.abs(F.element_at(values, -1) - m) / (1.4826 * spread)
    enough = F.size(values) >= 5
    return F.struct(F.when(enough, score).alias("score"), (enough & (score >= threshold)).alias("anomaly"))


def all_of_last(flags: Column, n: int) -> Column:
    """Whether there are n flags at least and the last n are all true."""
    if n <= 0:
        return F.lit(False)
    return F.when(F.size(flags) >= n, F.forall(F.slice(flags, -n, n), lambda x: x)).otherwise(F.lit(False))


def compared(value: Column, comparator: Column, threshold: Column) -> Column:
    """Comparison named by a column; an unknown name is false."""
    return (
        F.when(comparator == "gt", value > threshold).when(comparator == "gte", value >= threshold).when(comparator == "lt", value < threshold)
        .when(comparator == "lte", value <= threshold).when(comparator == "eq", F.abs(value - threshold) < 1e-9).otherwise(F.lit(False))
    )


def streaks(days: DataFrame, key: str, day: str, today: str) -> DataFrame:
    """key, current, longest and last day, from rows of one key and day: runs of consecutive days; the current run
    counts only if it reaches yesterday."""
    w = Window.partitionBy(key).orderBy(day)
    runs = days.select(key, day).distinct().withColumn("_run", F.date_sub(F.col(day), F.row_number().over(w)))
    runs = runs.groupBy(key, "_run").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max(day).alias("last"))
    best = runs.groupBy(key).agg(F.max("n").alias("longest"), F.max(F.struct("last", "n")).alias("x"))
    alive = F.col("x.last") >= F.date_sub(F.lit(today).cast("date"), 1)
    return best.select(key, F.when(alive, F.col("x.n")).otherwise(0).alias("current"), "longest", F.col("x.last").alias("last_day"))


def spread_sample(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """n rows of each key at even distances, the first and the last among them; all rows where there are fewer."""
    w = Window.partitionBy(*keys).orderBy(*order)
    pos = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    step = (F.col("_n") - 1) / F.lit(max(n - 1, 1))
    chosen = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.least(F.col("_n") - 1, F.rint(i * step).cast("long")))
    return pos.where((F.col("_n") <= n) | F.array_contains(chosen, F.col("_i").cast("long"))).drop("_i", "_n")


def interleaved(df: DataFrame, queue: str, order: list[str], item: str, limit: int) -> DataFrame:
    """Items taken from the queues in turn, each once whatever its case, up to a limit, with their place."""
    rank = F.row_number().over(Window.partitionBy(queue).orderBy(*order))
    first = df.withColumn("_turn", rank).where(F.col("_turn") <= limit * 4).groupBy(F.lower(item).alias("_low")).agg(F.min(F.struct("_turn", queue, item)).alias("x"))
    return first.select("x.*").orderBy("_turn", queue).limit(limit).drop("_turn")


def locf_weeks(values: DataFrame, at: str, value: str, as_of: str, weeks: int = 5) -> DataFrame:
    """(week_end, mean) of the weeks before as_of, the oldest first; an empty week repeats the one before, 0 at first."""
    spark = values.sparkSession
    end = lambda k: F.expr(f"TIMESTAMP_NTZ'{as_of}'") - F.make_dt_interval(7 * k)
    spine = spark.range(weeks).select(F.col("id").cast("int").alias("k"))
    bucket = F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - 1 - F.unix_micros(F.col(at).cast("timestamp"))) / F.lit(7 * 86400 * 1_000_000)).cast("int")
    means = values.withColumn("k", bucket).where(F.col("k").between(0, weeks - 1)).groupBy("k").agg(F.avg(value).alias("m"))
    filled = F.last("m", ignorenulls=True).over(Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0))  # one row a week
    return spine.join(means, "k", "left").select(end(F.col("k")).cast("date").alias("week_end"), F.coalesce(filled, F.lit(0.0)).alias("mean"))
