"""Decisions: safety classes, refusals, staleness, claims and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.scalars import PACKUP

FAR_M = 3000.0  #: metres from the centre beyond which a resource isn't shown
FLOORS = {"2": 250, "4": 200, "8": 250}  #: least resources by a term's last digit, 150 else


def classify_safety(df: DataFrame, preferred: tuple, secondary: tuple, thin: int = 3) -> DataFrame:
    """``reason`` that a resource is hidden (offCampus, type, restricted, far, noHours, thin: the first that holds), else
    ``visibility``. Rows: campus, type, restricted, metres, hours_known, weekly, listed. Hours that may be known don't hide.
    """
    reason = (
        F.when(~F.col("campus"), "offCampus")
        .when(~F.coalesce(F.col("type").isin(*preferred, *secondary), F.lit(False)), "type")
        .when(F.col("restricted"), "restricted")
        .when(F.col("metres") > FAR_M, "farFromCampus")
        .when(F.col("hours_known").eqNullSafe(F.lit(False)), "noHours")
        .when((F.col("weekly") < thin) & ~F.coalesce(F.col("listed"), F.lit(False)), "thin")
    )
    return df.withColumn("reason", reason).withColumn("visibility", F.when(F.col("reason").isNull(), F.when(F.col("type").isin(*preferred), "shown").otherwise("secondary")))


def safety_stats(classified: DataFrame) -> DataFrame:
    """Rows kept by visibility and dropped by reason, with the least id as an example."""
    return classified.groupBy(F.coalesce("reason", "visibility").alias("outcome")).agg(F.count(F.lit(1)).alias("rows"), F.min("resource_id").alias("example"))


def staleness(days: Column, gated: Column) -> Column:
    return F.when(gated, "gated").when(days >= 35, "banner").when(days >= 14, "line").otherwise("silent")


def refusal(now: Column, resources: Column, floor: Column, exams: Column, in_term: Column, closed: Column, share: Column) -> Column:
    """The first reason not to answer; null if there is none. A share that is unknown counts as no schedule."""
    return (
        F.when(~now.between(0, 1440), "clock")
        .when(resources < floor, "index-floor")
        .when(exams, "exams")
        .when(~in_term, "out-of-term")
        .when(closed, "closed")
        .when(share.isNull() | (share < 0.1), "no-schedule")
    )


def season_floor(term: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in FLOORS.items() for x in kv])[F.substring(term, -1, 1)], F.lit(150))


def window_class(wait: Column, known: Column, until: Column, close: Column, next_busy: Column) -> Column:
    """wait, unknown (a minute outside the day, or hours unknown), strong (a class ends it) or medium (free to close)."""
    odd = ~F.coalesce(until.between(0, 1440), F.lit(True)) | ~F.coalesce(close.between(0, 1440), F.lit(True))
    return F.when(wait > 0, "wait").when(~known | odd, "unknown").when(next_busy < close, "strong").otherwise("medium")


def room_claims(busy: DataFrame, asks: DataFrame, seam: int = 20) -> DataFrame:
    """State of each resource at ``now`` of a date, with ``until`` and ``next``, the start of the next free time.

    ``busy``: resource_id, date, start, end, merged; ``asks``: resource_id, date, now, known, open, close. Where hours are
    not ``known``, open and close are those of the schedule, and the state says no more than that classes haven't begun
    or are over. Gaps shorter than ``seam`` minutes are not free times. In this order: no-class-today without hours;
    opens (until: the opening) or before-first-class; closed-for-day or after-last-class (until: the close); in-class
    (until: its end); no-class-today without classes; nothing-free in a seam; free, until the next class less the time to
    pack up (null: none follows).
    """
    cut = busy.join(asks.select("resource_id", "date", "now", "open", "close").distinct(), ["resource_id", "date"])
    cut = cut.withColumn("start", F.greatest("start", "open")).withColumn("end", F.least("end", "close")).where("end > start")
    blocks = cut.groupBy("resource_id", "date", "now", "open", "close").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("b"))  # of one day's minutes
    keys = ["resource_id", "date", "now"]
    rows = asks.join(blocks.drop("open", "close"), keys, "left").withColumn("b", F.coalesce("b", F.array().cast("array<struct<start:int,end:int>>")))
    now, open_, close = F.col("now"), F.col("open"), F.col("close")
    begins = lambda i: F.when(i == 0, open_).otherwise(F.get("b", i - 1)["end"])
    gaps = F.transform(F.sequence(F.lit(0), F.size("b")), lambda i: F.struct(begins(i).cast("int").alias("start"), F.when(i == F.size("b"), close).otherwise(F.get("b", i)["start"]).cast("int").alias("end")))
    rows = rows.withColumn("free", F.filter(gaps, lambda g: g["end"] - g["start"] >= seam))
    rows = rows.withColumn("class", F.get(F.filter("b", lambda x: (x["start"] <= now) & (now < x["end"])), F.lit(0)))
    here = F.exists("free", lambda g: (g["start"] <= now) & (now < g["end"]))
    later = F.get(F.filter("b", lambda x: x["start"] >= now), F.lit(0))["start"]
    state = (
        F.when(open_.isNull() | close.isNull(), "no-class-today").when(now < open_, F.when(F.col("known"), "opens").otherwise("before-first-class"))
        .when(now >= close, F.when(F.col("known"), "closed-for-day").otherwise("after-last-class")).when(F.col("class").isNotNull(), "in-class")
        .when(F.size("b") == 0, "no-class-today").when(~here, "nothing-free").otherwise("free")
    )
    rows = rows.withColumn("state", state)
    is_ = lambda *names: F.col("state").isin(*names)
    until = F.when(is_("opens", "before-first-class"), open_).when(is_("closed-for-day", "after-last-class"), close).when(is_("in-class"), F.col("class.end")).when(is_("free"), later - PACKUP)
    after = F.when(is_("opens"), open_).when(is_("in-class"), F.col("class.end"))
    first = F.get(F.filter("free", lambda g: g["start"] >= after), F.lit(0))["start"]
    return rows.select(*keys, "state", until.cast("int").alias("until"), F.when(after.isNotNull(), first).cast("int").alias("next"))


def calendar_states(df: DataFrame) -> DataFrame:
    """Per date offices-closed, no-classes or none, the strictest of its events' texts."""
    text = F.lower("summary")
    level = F.when(text.rlike("offices? closed|university closed"), 2).when(text.rlike("no classes|break"), 1).otherwise(0)
    out = df.groupBy("date").agg(F.max(level).alias("level"))
    return out.select("date", F.element_at(F.array(F.lit("none"), F.lit("no-classes"), F.lit("offices-closed")), F.col("level") + 1).alias("state"))


def nearest_door(origins: DataFrame, doors: DataFrame) -> DataFrame:
    """Least planar distance from each origin (id, place_id, x, y) to its place's doors (east, north), else to its centre."""
    d = F.sqrt((F.col("x") - F.col("east")) * (F.col("x") - F.col("east")) + (F.col("y") - F.col("north")) * (F.col("y") - F.col("north")))
    best = origins.join(doors, "place_id", "left").groupBy("id", "place_id", "x", "y").agg(F.min(d).alias("door"))
    return best.select("id", "place_id", F.coalesce("door", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).alias("metres"))


def pick_versioned(table: DataFrame, term: str) -> DataFrame:
    """Rows of the least version whose slug starts with the term; none if there is no such version."""
    own = table.where(F.col("slug").startswith(term))
    least = own.agg(F.min("slug").alias("slug"))
    return own.join(F.broadcast(least), "slug", "left_semi")  # one row


def always_open(hours: DataFrame) -> DataFrame:
    """Places with published open hours on all seven days."""
    return hours.where("open is not null").groupBy("place_id").agg(F.countDistinct("day").alias("days")).where("days = 7").select("place_id")


def closing_chain(spans: DataFrame, days: int = 7) -> DataFrame:
    """When a place that is open across midnights closes, in minutes from its day's start; null if not within ``days``.

    ``spans``: place_id, day number, open, close, one a day; a span that ends at 1440 goes on if the next opens at 0.
    """
    by = Window.partitionBy("place_id").orderBy("n")
    nxt = F.lead(F.struct("n", "open")).over(by)
    goes_on = (F.col("close") == 1440) & F.coalesce((nxt["n"] == F.col("n") + 1) & (nxt["open"] == 0), F.lit(False))
    marked = spans.withColumn("ends", ~goes_on)
    end = F.min(F.when(F.col("ends"), F.struct("n", "close"))).over(by.rowsBetween(0, Window.unboundedFollowing))
    rows = marked.withColumn("e", end)
    span = (F.col("e.n") - F.col("n")) * 1440 + F.col("e.close")
    return rows.select("place_id", "n", F.when(F.col("e.n") - F.col("n") < days, span).alias("closes"))
