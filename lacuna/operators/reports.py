"""What goes with an operator's rows: what it dropped, what it could not resolve, how its counts split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repair_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key rows without a bound, which go, and rows that end at or before their start, which are repaired."""
    none = F.col("start").isNull() | F.col("end").isNull()
    return df.groupBy(*keys).agg(F.count_if(none).alias("dropped"), F.count_if(~none & (F.col("end") <= F.col("start"))).alias("malformed"))


def unresolved(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Keys of ``df`` that ``dim`` lacks, with how many rows have them."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).join(dim.select(key).distinct(), key, "left_anti")


def flag_allowed(df: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with whether a list of known cases holds its keys."""
    known = allowed.select(*keys).distinct().withColumn("_a", F.lit(True))
    return df.join(known, list(keys), "left").withColumn("allowed", F.col("_a").isNotNull()).drop("_a")


def parsed_of_requested(requested: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """One row: keys asked for, keys with rows, and whether all came."""
    asked = requested.select(key).distinct().withColumn("_r", F.lit(True))
    both = asked.join(parsed.select(key).distinct().withColumn("_p", F.lit(True)), key, "left")
    return both.agg(F.count(F.lit(1)).alias("requested"), F.count("_p").alias("parsed")).withColumn("complete", F.col("requested") == F.col("parsed"))


def pass_convergence(passes: DataFrame, quiet: int = 2, least: int = 3, most: int = 8) -> DataFrame:
    """Per pass (pass, added_with_room) whether the harvest ends there: ``quiet`` passes without a new real row, and ``least`` in all, or ``most``."""
    by = Window.orderBy("pass")  # a row a pass
    rows = passes.withColumn("n", F.row_number().over(by)).withColumn("busy", F.sum((F.col("added_with_room") > 0).cast("int")).over(by.rowsBetween(1 - quiet, 0)))
    return rows.select("pass", "added_with_room", ((F.col("n") >= quiet) & (F.col("busy") == 0) & (F.col("n") >= least) | (F.col("n") >= most)).alias("converged"))


def drift_counts(before: DataFrame, after: DataFrame, keys: Sequence[str], resource: str) -> DataFrame:
    """Added and removed pairs of keys, and the resources that they belong to."""
    a, b = (df.select(*keys).distinct() for df in (before, after))
    rows = b.join(a, list(keys), "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, list(keys), "left_anti").withColumn("change", F.lit("removed")))
    return rows.groupBy("change").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct(resource).alias("resources"))


def departures(before: DataFrame, after: DataFrame, key: str, today: Column) -> DataFrame:
    """Keys that left, and why: expired where ``before``'s ``until`` is past, else dropped early; without a date unknown."""
    gone = before.join(after.select(key).distinct(), key, "left_anti")
    return gone.select(key, F.when(F.col("until").isNull(), "unknown").when(F.col("until") < today, "expired").otherwise("dropped-early").alias("reason"))


def verdict_tally(claims: DataFrame, truth: DataFrame) -> DataFrame:
    """Claims (side, course, section, meeting, value) against later truth (course, section, meeting, value), counted by side and verdict.

    confirmed, stale (another value), or what of it is gone: meeting, section, course.
    """
    t = truth.select("course", "section", "meeting", F.col("value").alias("_v"))
    rows = claims.join(t, ["course", "section", "meeting"], "left")
    rows = rows.join(t.select("course", "section").distinct().withColumn("_s", F.lit(True)), ["course", "section"], "left").join(t.select("course").distinct().withColumn("_c", F.lit(True)), "course", "left")
    verdict = F.when(F.col("value") == F.col("_v"), "confirmed").when(F.col("_v").isNotNull(), "stale").when(F.col("_s"), "meeting-gone").when(F.col("_c"), "section-gone").otherwise("course-gone")
    return rows.groupBy("side", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def keep_first(df: DataFrame, key: str, order: str, values: Sequence[str], most: float = 1e-6) -> DataFrame:
    """The first row of each key with how many it stands for and whether they differ in one of the values."""
    by = Window.partitionBy(key)
    differs = [F.max(v).over(by) - F.min(v).over(by) > most for v in values]
    conflict = differs[0]
    for d in differs[1:]:
        conflict = conflict | d
    rows = df.withColumn("copies", F.count(F.lit(1)).over(by)).withColumn("conflict", conflict).withColumn("_n", F.row_number().over(by.orderBy(order)))
    return rows.where("_n = 1").drop("_n")


def day_edges(timeline: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``timeline`` (keys, start, end, kind) with an edge row where a window opens and where it closes, in order."""
    keys = list(keys)
    edges = windows.where("close > open").select(*keys, F.explode(F.array("open", "close")).alias("start")).select(*keys, "start", F.col("start").alias("end"), F.lit("edge").alias("kind"))
    rows = timeline.select(*keys, "start", "end", "kind").unionByName(edges)
    rank = F.when(F.col("kind") == "edge", F.when(F.col("start") == F.min("start").over(Window.partitionBy(*keys)), 0).otherwise(2)).otherwise(1)
    return rows.withColumn("_r", rank).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "_r", "end")).cast("long")).drop("_r")


def day_slots(slots: DataFrame, keys: Sequence[str], arrival: int, wait: int = 30) -> DataFrame:
    """Per key the run of free slots from the first one that starts within ``wait`` minutes of arrival to the last slot of the day; null if it doesn't reach it."""
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("start")
    last = F.max("end").over(Window.partitionBy(*keys))
    rows = slots.withColumn("_last", last).where(~F.col("taken") & (F.col("start") >= arrival))
    new = F.coalesce(F.lag("end").over(order) != F.col("start"), F.lit(True)).cast("int")
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order)).groupBy(*keys, "_run", "_last").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    good = runs.where((F.col("start") <= arrival + wait) & (F.col("end") == F.col("_last")))
    return good.select(*keys, "start", "end")


def subject_residue(df: DataFrame, failed: Column, subject: str, most: float, least: int = 2) -> DataFrame:
    """Subjects with more than ``most`` of their values unread, ``least`` at least: fatal."""
    agg = df.groupBy(subject).agg(F.count_if(failed).alias("failed"), F.count(F.lit(1)).alias("seen"))
    return agg.withColumn("level", F.when((F.col("failed") / F.col("seen") > most) & (F.col("failed") >= least), "fatal").otherwise("ok"))


def numbers_as_expected(df: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Rows whose number isn't the one expected for their key."""
    return df.join(expected.select(key, F.col("number").alias("expected")), key).where(~F.col("number").eqNullSafe(F.col("expected")))


def grid_back(gx: Column, gy: Column, west: float, south: float, east: float, north: float, size: int) -> Column:
    """The middle of a grid's cell as struct(lon, lat)."""
    return F.struct((west + (gx + 0.5) / size * (east - west)).alias("lon"), (north - (gy + 0.5) / size * (north - south)).alias("lat"))


def hour_label(minutes: Column) -> Column:
    """``8 am``, ``noon``, ``midnight``."""
    h = F.floor(minutes / 60).cast("int") % 24
    return F.when(h == 12, "noon").when(h == 0, "midnight").otherwise(F.concat((h % 12).cast("string"), F.when(h < 12, " am").otherwise(" pm")))


def spoken_dur(minutes: Column) -> Column:
    """``1 hour 5 minutes``."""
    h, m = F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int")
    part = lambda n, one: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s")))
    return F.concat_ws(" ", part(h, "hour"), part(m, "minute"))


def pad_digits(key: Column, width: int = 4) -> Column:
    """The last run of digits padded with zeros."""
    digits, tail = F.regexp_extract(key, r"([0-9]+)([^0-9]*)$", 1), F.regexp_extract(key, r"([0-9]+)([^0-9]*)$", 2)
    start = F.regexp_extract(key, r"^(.*?)[0-9]+[^0-9]*$", 1)
    return F.when(digits == "", key).otherwise(F.concat(start, F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits), tail))


def ready_report(report: DataFrame, previous: Column, floors_failed: Column) -> DataFrame:
    """A refusal report's state: not-ready where a floor failed and there is no run before, else refused or published."""
    return report.withColumn("state", F.when(~previous & floors_failed, "not-ready").when(F.col("refused"), "refused").otherwise("published"))
