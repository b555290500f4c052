"""Drained queries count every row, in whatever order the files of events come."""

import datetime as dt
import glob
import os
import shutil

from pyspark.sql import functions as F

from tideline import catalog

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_late_files_count(spark, tmp_path):
    start, target = dt.datetime(2024, 1, 1, 10), tmp_path / "events.parquet"
    os.makedirs(target)
    rows = [(100 * day + i, start + dt.timedelta(days=day, minutes=i), i % 2, "view", 1.0, "{}") for day in (120, 70, 0, 121) for i in range(6)]
    for n in range(4):
        spark.createDataFrame(rows[6 * n : 6 * n + 6], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"p{n}"))
        at = str(target / f"{n}.parquet")
        shutil.move(glob.glob(str(tmp_path / f"p{n}" / "*.parquet"))[0], at)
        os.utime(at, (1_700_000_000 + n, 1_700_000_000 + n))
    total = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).agg(F.sum("n")).first()[0]
    assert total("stream_hour_rollup") == 24
    assert total("stream_sliding_day") == 48
    kinds = catalog.QUERIES["stream_dedup"](spark, str(tmp_path)).collect()
    assert {r.user_id: r.kinds for r in kinds} == {0: 1, 1: 1}
