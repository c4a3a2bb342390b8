"""Busy intervals: repair, merging, gaps, overlap. Minutes of a day; an interval is half-open."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.scalars import DAY


def repair_intervals(df: DataFrame) -> DataFrame:
    """Rows with both bounds; an end at or before its start runs to the end of the day, marked ``malformed``."""
    wrong = F.col("end") <= F.col("start")
    return df.where("start is not null and end is not null").withColumn("malformed", wrong).withColumn("end", F.when(wrong, F.lit(DAY)).otherwise(F.col("end")))


def clip_intervals(df: DataFrame, open_: str = "open", close: str = "close") -> DataFrame:
    """Intervals inside [open, close]; what has no minute there goes."""
    return df.withColumn("start", F.greatest("start", open_)).withColumn("end", F.least("end", close)).where("end > start")


def merge_intervals(df: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """Unions of overlapping intervals (touching ones too, unless ``strict``), with how many rows each merged.

    Islands by a running maximum of ends; a label stays if all rows of the island have it, else null and mixed.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end", F.col("label").asc_nulls_first())
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = reach.isNull() | ((F.col("start") >= reach) if strict else (F.col("start") > reach))
    marked = df.withColumn("new", new.cast("int")).withColumn("contained", (~new & (F.col("end") <= reach)).cast("int"))
    islands = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    same = (F.min("label") == F.max("label")) & (F.count("label") == F.count(F.lit(1)))
    return (
        islands.groupBy(*keys, "island")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.when(same, F.min("label")).alias("label"),
            F.count(F.lit(1)).alias("rows"),
            F.sum("contained").alias("dropped"),
        )
        .drop("island")
    )


def union_minutes(df: DataFrame, keys: Sequence[str], open_: int, close: int) -> DataFrame:
    """Minutes of [open, close] that the intervals cover, overlaps once."""
    inside = clip_intervals(df.withColumn("open", F.lit(open_)).withColumn("close", F.lit(close)))
    merged = merge_intervals(inside, keys)
    return merged.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("minutes"))


def free_gaps(busy: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Complement of the busy rows inside each window (keys, open, close): gaps in order.

    A window's close is one more row, so a key without busy rows has one gap.
    """
    windows = windows.where("close > open")
    rows = clip_intervals(repair_intervals(busy).join(windows, list(keys))).select(*keys, "start", "end", "open")
    ends = windows.select(*keys, F.col("close").alias("start"), F.col("close").alias("end"), "open")
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("open"))
    gaps = rows.unionByName(ends).withColumn("gap_start", reach).where("start > gap_start")
    return gaps.select(*keys, "gap_start", F.col("start").alias("gap_end"))


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str], bucket: int = 60) -> DataFrame:
    """Pairs that share a minute, by hour buckets; a pair is taken in the first bucket that both reach."""

    def placed(df: DataFrame, side: str) -> DataFrame:
        cells = F.sequence(F.floor(F.col("start") / bucket).cast("int"), F.floor((F.col("end") - 1) / bucket).cast("int"))
        return df.where("end > start").select(*keys, F.explode(cells).alias("cell"), *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in keys])

    out = placed(a, "a").join(placed(b, "b"), [*keys, "cell"]).where("a_start < b_end and a_end > b_start")
    return out.where(F.col("cell") == F.floor(F.greatest("a_start", "b_start") / bucket)).drop("cell")


def in_free_time(rows: DataFrame, busy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that overlap no busy row."""
    r, b = rows.alias("r"), busy.alias("b")
    on = [F.col(f"r.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("r.start") < F.col("b.end"), F.col("r.end") > F.col("b.start")]
    return r.join(b, on, "left_anti")


def contiguous_days(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of consecutive dates."""
    days = df.select(*keys, "date").where("date is not null").distinct()
    run = F.date_sub("date", F.row_number().over(Window.partitionBy(*keys).orderBy("date")))
    return days.withColumn("run", run).groupBy(*keys, "run").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("days")).drop("run")


def dedupe_keep(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """One row a key: the first in order, or the last."""
    by = [F.col(c).desc() if last else F.col(c).asc() for c in order]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_n = 1").drop("_n")


def day_timeline(busy: DataFrame, windows: DataFrame, keys: Sequence[str], seam: int = 20) -> DataFrame:
    """Busy and free rows of each window in order; a gap of less than ``seam`` minutes is a seam."""
    free = free_gaps(busy, windows, keys).select(*keys, F.col("gap_start").alias("start"), F.col("gap_end").alias("end"))
    free = free.withColumn("kind", F.when(F.col("end") - F.col("start") < seam, "seam").otherwise("free"))
    taken = clip_intervals(repair_intervals(busy).join(windows, list(keys)))
    taken = merge_intervals(taken.withColumn("label", F.lit("x")), keys, strict=True).select(*keys, "start", "end", F.lit("busy").alias("kind"))
    rows = free.unionByName(taken)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end")).cast("long"))


def slot_chain(slots: DataFrame, keys: Sequence[str], arrival: int, need: int, least: int = 30, longest: int = 240) -> DataFrame:
    """Per key the first run of bookable slots, each starting where the last ends, that is long enough from ``arrival`` on."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    free = slots.where(~F.col("taken") & (F.col("start") >= arrival))
    new = F.coalesce(F.lag("end").over(order) != F.col("start"), F.lit(True)).cast("int")
    runs = free.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    spans = runs.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.withColumn("end", F.least("end", F.col("start") + longest)).where(F.col("end") - F.col("start") >= max(need, least))
    return spans.groupBy(*keys).agg(F.min(F.struct("start", "end")).alias("s")).select(*keys, "s.start", "s.end")
