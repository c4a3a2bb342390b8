"""Meetings, weekdays, sessions: the funnel from raw rows to usable intervals, and what share of them is live."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.intervals import merge_intervals
from lacuna.operators.order import rows_before


def is_real_resource(df: DataFrame, pseudo: Sequence[str]) -> Column:
    return F.col("resource_id").isNotNull() & ~F.col("resource_id").isin(*pseudo) & ~F.coalesce(F.col("place_id").isin(*pseudo), F.lit(False))


def funnel_stage(df: DataFrame, pseudo: Sequence[str], places: DataFrame | None = None) -> DataFrame:
    """``stage``: the first test that a row fails, of blankId, pseudo, unknownPlace, noWeekday, badTime; else usable.

    Without ``places`` no place is unknown.
    """
    known = F.lit(True)
    if places is not None:
        df = df.join(places.select("place_id").distinct().withColumn("_known", F.lit(True)), "place_id", "left")
        known = F.col("_known").isNotNull()
    stage = (
        F.when(F.col("resource_id").isNull(), "blankId")
        .when(~is_real_resource(df, pseudo), "pseudo")
        .when(~known, "unknownPlace")
        .when(F.col("day").isNull(), "noWeekday")
        .when(F.col("start").isNull() | F.col("end").isNull() | (F.col("end") <= F.col("start")), "badTime")
        .otherwise("usable")
    )
    return df.withColumn("stage", stage).drop("_known")


def funnel_counts(staged: DataFrame) -> DataFrame:
    """Rows at each stage, those of them with a window, and the share of all."""
    timed = F.col("start").isNotNull() & (F.col("end") > F.col("start"))
    counts = staged.groupBy("stage").agg(F.count(F.lit(1)).alias("rows"), F.count_if(timed).alias("timed"))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy()))


def expand_weekdays(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """A row for each true flag; its number is the day."""
    days = F.array(*[F.when(F.col(f), F.lit(i)) for i, f in enumerate(flags)])
    return df.withColumn("day", F.explode(F.array_compact(days))).drop(*flags)


def active_sessions(busy: DataFrame, sessions: DataFrame, date: Column) -> DataFrame:
    """Rows whose session holds the date, both ends included; a session that isn't listed is live."""
    return busy.join(sessions.select("session_id", "first", "last"), "session_id", "left").where(F.col("first").isNull() | date.between(F.col("first"), F.col("last"))).drop("first", "last")


def distinct_sessions(df: DataFrame) -> DataFrame:
    """Distinct (first, last), a row's own or else its parent's, numbered in order."""
    spans = df.select(F.coalesce("first", "parent_first").alias("first"), F.coalesce("last", "parent_last").alias("last")).where("first is not null and last is not null").distinct()
    return rows_before(spans, ["first", "last"], name="session_id")


def prune_sessions(sessions: DataFrame, busy: DataFrame) -> DataFrame:
    """Sessions that some row refers to, numbered anew."""
    used = sessions.join(busy.select("session_id").distinct(), "session_id", "left_semi")
    return rows_before(used, ["session_id"], name="new_id")


def label_dictionary(df: DataFrame, column: str) -> DataFrame:
    """Distinct labels in order with their numbers."""
    return rows_before(df.select(F.col(column).alias("label")).where("label is not null").distinct(), ["label"], name="label_id")


def schedule_coverage(busy: DataFrame, sessions: DataFrame, dates: DataFrame) -> DataFrame:
    """Per date: blocks that are live, all blocks, and their share (null without blocks). Counted by session first."""
    per = busy.groupBy("session_id").agg(F.count(F.lit(1)).alias("blocks"))
    per = per.join(sessions, "session_id", "left")
    live = F.col("first").isNull() | F.col("date").between(F.col("first"), F.col("last"))
    both = dates.crossJoin(per)  # every date and session
    out = both.groupBy("date").agg(F.sum(F.when(live, F.col("blocks")).otherwise(0)).alias("live"), F.sum("blocks").alias("total"))
    return out.withColumn("share", F.col("live") / F.nullif(F.col("total"), F.lit(0)))


def busy_day_profile(busy: DataFrame, low: float = 0.005, high: float = 0.995, least_share: float = 0.01) -> DataFrame:
    """Per weekday: nearest-rank quantiles of starts and ends over all rows, the day's share, and whether it counts.

    The rank of p among n values is min(n - 1, floor(n * p)); exact, from counts of each minute.
    """
    rows = busy.where("end > start")

    def pick(column: str, p: float) -> DataFrame:
        counts = rows.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))  # 1441 rows at most
        up = counts.withColumn("upto", F.sum("n").over(Window.orderBy("v"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
        rank = F.least(F.col("all") - 1, F.floor(F.col("all") * p))
        return up.where(F.col("upto") > rank).agg(F.min("v").alias(f"{column}_q"))

    days = rows.groupBy("day").agg(F.count(F.lit(1)).alias("rows"))
    days = days.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy()))
    return days.crossJoin(pick("start", low)).crossJoin(pick("end", high)).withColumn("on", F.col("share") >= least_share)


def index_measure(busy: DataFrame, exclude: Sequence | None = None) -> DataFrame:
    """Resources, blocks, minutes, minutes of each weekday, and the weekday balance min / max (0 if max is 0)."""
    rows = busy.where(~F.col("resource_id").isin(*exclude)) if exclude else busy
    minutes = F.greatest(F.col("end") - F.col("start"), F.lit(0))
    by_day = [F.coalesce(F.sum(F.when(F.col("day") == d, minutes)), F.lit(0)).cast("long").alias(f"minutes_{d}") for d in range(7)]
    out = rows.agg(F.countDistinct("resource_id").alias("resources"), F.count(F.lit(1)).alias("blocks"), F.sum(minutes).cast("long").alias("minutes"), *by_day)
    work = [F.col(f"minutes_{d}") for d in range(1, 6)]
    return out.withColumn("balance", F.when(F.greatest(*work) > 0, F.least(*work) / F.greatest(*work)).otherwise(F.lit(0.0)))


def last_end_by_place_day(busy: DataFrame, resources: DataFrame) -> DataFrame:
    return busy.join(resources.select("resource_id", "place_id"), "resource_id").groupBy("place_id", "day").agg(F.max("end").alias("last_end"))


def overrun_check(last_ends: DataFrame, hours: DataFrame) -> DataFrame:
    """Places and days whose last interval ends after the close, or that are closed."""
    both = last_ends.join(hours, ["place_id", "day"])
    why = F.when(F.col("open").isNull(), "closed").when(F.col("last_end") > F.col("close"), "after-close")
    return both.withColumn("why", why).where("why is not null").select("place_id", "day", "last_end", "close", "why")


def propagate_groups(busy: DataFrame, halves: DataFrame) -> DataFrame:
    """A parent's own intervals on its halves too, and the halves' own on the parent, merged again. ``halves``: parent, child.

    Returns the own rows as they were (own true) and, for every resource, its merged ones (own false; merges and dropped
    count what was joined). If ``busy`` has the column own, only its own rows are read, so that a second run gives the same.
    """
    if "own" in busy.columns:
        busy = busy.where("own")
    own = busy.select("resource_id", "day", "start", "end", "label")
    h = halves.select("parent", "child").distinct()
    way = h.select(F.col("parent").alias("resource_id"), F.col("child").alias("to")).unionByName(h.select(F.col("child").alias("resource_id"), F.col("parent").alias("to"))).distinct()
    moved = own.join(way, "resource_id").select(F.col("to").alias("resource_id"), "day", "start", "end", "label")
    merged = merge_intervals(own.unionByName(moved), ["resource_id", "day"])
    kept = own.select("*", F.lit(True).alias("own"))
    return kept.unionByName(merged.select("resource_id", "day", "start", "end", "label", F.lit(False).alias("own")))


def overlay_for_date(weekly: DataFrame, dated: DataFrame, date: Column, suspended: bool = False) -> DataFrame:
    """A date's busy rows: the weekly ones of its weekday (none if classes are suspended) and the date's own."""
    day = F.dayofweek(date) - 1
    own = dated.where(F.col("date") == date).select("resource_id", "start", "end", F.when(F.col("label") == "hold", "May be booked").otherwise(F.col("label")).alias("label"))
    live = weekly.where((F.col("day") == day) & (F.lit(not suspended))).select("resource_id", "start", "end", "label")
    return live.unionByName(own)


def feed_row_validity(df: DataFrame, known: DataFrame, codes: Sequence[str]) -> DataFrame:
    """``reason``: why a feed row is rejected (unknown-room, invalid-block, invalid-kind, invalid-event), null if it isn't."""
    good_block = (F.col("day").between(0, 6)) & (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= 1440)
    rows = df.join(known.select("resource_id").distinct().withColumn("_known", F.lit(True)), "resource_id", "left")
    digits = F.when(F.col("kind") == "event", F.col("source_id").rlike("^[0-9]{9}$")).otherwise(F.col("source_id").rlike("^[0-9]{1,9}$"))
    reason = (
        F.when(F.col("_known").isNull(), "unknown-room")
        .when(~F.coalesce(good_block, F.lit(False)), "invalid-block")
        .when(~F.coalesce(F.col("kind").isin("event", "block"), F.lit(False)), "invalid-kind")
        .when(~F.coalesce(digits, F.lit(False)) | (F.col("kind") == "event") & ~F.coalesce(F.col("code").isin(*codes), F.lit(False)), "invalid-event")
    )
    return rows.withColumn("reason", reason).drop("_known")


def dedupe_feed(df: DataFrame) -> DataFrame:
    """The first occurrence of each (resource, date, start, end, source)."""
    order = Window.partitionBy("resource_id", "date", "start", "end", "label").orderBy("event_id")
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def asof_snapshot(questions: DataFrame, weeks: DataFrame) -> DataFrame:
    """The snapshot of the week (from its Monday, ``week_start``) that holds each date, else the first one, with ``coverage``."""
    first = weeks.agg(F.min("week_start").alias("fallback"))
    own = weeks.select("week_start").distinct()
    out = questions.withColumn("_week", F.to_date(F.date_trunc("week", "date"))).join(own, F.col("_week") == F.col("week_start"), "left").crossJoin(F.broadcast(first))  # one row
    return out.withColumn("coverage", F.when(F.col("week_start").isNull(), "outside-snapshot").otherwise("inside")).withColumn("snapshot", F.coalesce("week_start", "fallback")).drop("_week")


def feed_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("resource_id").alias("resources"), F.countDistinct("event_id").alias("ids"))
