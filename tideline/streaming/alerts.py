"""The alert state machine: fire, stay quiet for a cooldown, resolve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold_alerts(events: DataFrame, keys: list[str], order: list[str], breached: str, cooldown_seconds: int) -> DataFrame:
    """keys, state ('firing' or 'ok'), last_notified, and how many notices and recoveries were sent.

    A breach notifies if nothing fires yet or the last notice is a cooldown old; the first value that is no breach
    resolves. order[0] is the event time. Keys must not be null.
    """
    at = order[0]
    kind = events.schema[at].dataType.simpleString()
    hit = F.coalesce(F.col(breached), F.lit(False))
    way = Window.partitionBy(*keys).orderBy(*order)
    rows = events.select(*keys, *order, hit.alias("_hit"))
    rows = rows.withColumn("_before", F.lag("_hit", 1, False).over(way)).withColumn("_run", F.sum((~F.col("_hit")).cast("long")).over(way.rowsBetween(Window.unboundedPreceding, 0)))

    def notice(a, t):
        late = F.unix_micros(t.cast("timestamp")) - F.unix_micros(a["last"].cast("timestamp")) >= cooldown_seconds * 1_000_000
        send = F.coalesce(late, F.lit(True))
        return F.struct(F.when(send, t).otherwise(a["last"]).alias("last"), (a["sent"] + send.cast("int")).alias("sent"))

    # Breaches between two recoveries are folded by themselves: what came before a recovery does not matter after it.
    times = F.transform(F.sort_array(F.collect_list(F.struct(*order))), lambda x: x[at])
    runs = rows.where("_hit").groupBy(*keys, "_run").agg(F.aggregate(times, F.struct(F.lit(None).cast(kind).alias("last"), F.lit(0).alias("sent")), notice).alias("_a"))
    sent = runs.groupBy(*keys).agg(F.max("_a.last").alias("last_notified"), F.sum("_a.sent").cast("int").alias("sent"))
    state = F.when(F.max_by("_hit", F.struct(*order)), "firing").otherwise("ok")
    every = rows.groupBy(*keys).agg(state.alias("state"), F.count_if(~F.col("_hit") & F.col("_before")).cast("int").alias("resolved"))
    return every.join(sent, keys, "left").select(*keys, "state", "last_notified", F.coalesce("sent", F.lit(0)).alias("sent"), "resolved")
