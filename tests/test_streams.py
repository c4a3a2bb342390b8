"""Streams run to their end against their batch twins, with late rows, idle users and a restart."""

import datetime

import pytest
from pyspark.sql import functions as F

from lacuna.streaming import fixes


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def put(spark, data, path, schema=fixes.FIX):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, **how):
    return fixes.throttle_fix_stream(spark.readStream.schema(fixes.FIX).option("maxFilesPerTrigger", 1).parquet(path), **how)


END = (99, 0, 10_000_000, 0.0, 0.0)  #: moves the watermark past all else


def test_fixes_out_of_order_over_a_restart(spark, tmp_path):
    source, folder = str(tmp_path / "in"), f"file://{tmp_path}/out"
    data = [(u, e, 1000 + e * 7, float((e * 13) % 90), 0.0) for u in (1, 2) for e in range(60)]
    late = data[10:20]
    put(spark, data[:10] + data[20:60], source)
    fixes.run_to_end(stream(spark, source), "fixes", folder)
    put(spark, late + data[60:], source)  # out of order, within the delay
    fixes.run_to_end(stream(spark, source), "fixes", folder)
    put(spark, [END], source)
    fixes.run_to_end(stream(spark, source), "fixes", folder)
    put(spark, [(1, 1000, 3, 500.0, 0.0)], source)  # later than the delay: dropped
    got = fixes.run_to_end(stream(spark, source), "fixes", folder)
    want = fixes.throttle_fixes(spark.createDataFrame(data, fixes.FIX))
    assert rows(got, "user_id", "event_id") == rows(want, "user_id", "event_id")
    assert 4 < want.count() < len(data)


def test_an_idle_user_starts_anew(spark, tmp_path):
    source, folder = str(tmp_path / "in"), f"file://{tmp_path}/out"
    first, again = [(1, 1, 50, 0.0, 0.0), (1, 2, 100, 5.0, 0.0)], [(1, 3, 20_000, 6.0, 0.0), (1, 4, 20_100, 7.0, 0.0)]
    put(spark, first, source)
    put(spark, [(2, 9, 15_000, 0.0, 0.0)], source)
    fixes.run_to_end(stream(spark, source, idle=1000, delay="10 seconds"), "fixes", folder)
    put(spark, again, source)
    put(spark, [END], source)
    got = fixes.run_to_end(stream(spark, source, idle=1000, delay="10 seconds"), "fixes", folder)
    want = fixes.throttle_fixes(spark.createDataFrame([*first, *again, (2, 9, 15_000, 0.0, 0.0)], fixes.FIX), idle=1000)
    assert rows(got, "user_id", "event_id") == rows(want, "user_id", "event_id") == [(1, 1), (1, 3), (2, 9)]


def test_feed_repeats_and_stale_rows(spark, tmp_path):
    source = str(tmp_path / "in")
    at = lambda h, m=0: datetime.datetime(2026, 1, 10, h, m)
    day = datetime.date(2026, 1, 10)
    data = [("r1", at(12), day), ("r1", at(12, 5), day), ("r2", at(3), day), ("r2", at(3), datetime.date(2026, 1, 9)), ("r3", at(23), day), ("r3", at(23, 1), day)]
    schema = "resource string, ts timestamp, date date"
    put(spark, data[:3], source, schema)
    put(spark, data[3:], source, schema)
    read = spark.readStream.schema(schema).parquet(source)
    got = fixes.run_to_end(fixes.dedupe_feed_stream(read, ["resource", "date"]), "feed")
    assert rows(got, "resource", "date") == [("r1", day), ("r2", datetime.date(2026, 1, 9)), ("r2", day), ("r3", day)]
    kept = fixes.run_to_end(fixes.stale_feed_stream(read, "America/New_York"), "stale")
    # 3 in the morning, UTC, is the day before in New York
    want = fixes.stale_feed_stream(spark.createDataFrame(data, schema), "America/New_York")
    assert rows(kept, "resource", "date") == rows(want, "resource", "date") == [("r1", day), ("r1", day), ("r2", datetime.date(2026, 1, 9)), ("r3", day), ("r3", day)]


@pytest.mark.parametrize("nan", [float("nan"), 1e9])
def test_a_fix_without_a_place_is_never_far(spark, nan):
    data = [(1, 1, 0, 0.0, 0.0), (1, 2, 100, nan, 0.0)]
    got = fixes.throttle_fixes(spark.createDataFrame(data, fixes.FIX)).where(~F.isnan("x")).count()
    assert got == (1 if nan != nan else 2)
