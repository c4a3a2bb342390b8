"""What is known of resources beside their bookings: features, doors, second sources, holds, and how answers fared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.intervals import clip_intervals, free_gaps, merge_intervals, overlap_join


def offerable(kind: Column, types: Sequence[str], strict: bool = False) -> Column:
    """Whether a type is offered; one that isn't known is trusted, unless ``strict`` (the filter of one rung of the ladder)."""
    unknown = kind.isNull() | (kind == "")
    return F.when(unknown, F.lit(not strict)).otherwise(kind.isin(*types))


def has_feature(codes: Column, code: int) -> Column:
    """Whether the codes hold one; null where nothing is known."""
    return F.when(codes.isNotNull(), F.array_contains(codes, code))


def attach_features(resources: DataFrame, features: DataFrame, term: str) -> DataFrame:
    """``resources`` (resource_id) with the distinct codes of the term's feature rows, in order; null without a row.

    ``features``: term, resource_id, codes. Codes that are no number of 0 to 999 are counted in ``invalid``.
    """
    good = F.filter("codes", lambda c: c.between(0, 999))
    own = features.where(F.col("term") == term).groupBy("resource_id").agg(F.flatten(F.collect_list("codes")).alias("codes"))  # a resource's own codes
    own = own.select("resource_id", F.array_sort(F.array_distinct(good)).alias("features"), (F.size("codes") - F.size(good)).cast("long").alias("invalid"))
    return resources.join(own, "resource_id", "left")


# fixed values: codes of the feature list, by what they say
BOLTED, LOOSE, TABLET, TABLE = (29, 31), (30, 32), (29, 30), (31, 32)
WINDOWS, NO_WINDOWS, CHALK, WHITE = 39, 40, 43, 44
ON_WHEELS = "Movable Tables and Chairs on Casters"
FAMILY = {"Fixed Tablet Arm": "tablet-arm", "Movable Tablet Arm": "tablet-arm", "Fixed Tables": "table-chair", "Movable Tables and Chairs": "table-chair", ON_WHEELS: "table-chair"}


def derive_attributes(codes: Column, furniture: Column, boards: Column | None = None) -> Column:
    """struct(family, mobility, basis, contested, windows, chalk, white) of a resource from two sources.

    The first source's codes go before the second's furniture, which alone can only tell that chairs have wheels. Both
    window codes at once tell nothing. Boards are those of the codes, and where a resource has none of these, those that
    the second source lists (``boards``, names; an empty list tells nothing).
    """
    some = lambda those: F.arrays_overlap(codes, F.array(*[F.lit(c) for c in those]))
    first = F.when(some(TABLET), "tablet-arm").when(some(TABLE), "table-chair")
    second = F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv])[furniture]
    wheels = furniture == ON_WHEELS
    mobility = F.when(some(BOLTED), "bolted").when(some(LOOSE), F.when(wheels, "casters").otherwise("freestanding")).when(wheels, "casters")
    basis = F.when(some(BOLTED), "first").when(some(LOOSE), F.when(furniture.isNotNull(), "both").otherwise("first")).when(wheels, "second")
    contested = F.coalesce((first != second) | some(BOLTED) & furniture.startswith("Movable") & first.isNotNull(), F.lit(False))
    yes, no = F.array_contains(codes, WINDOWS), F.array_contains(codes, NO_WINDOWS)
    listed = F.when(F.size(boards) > 0, boards) if boards is not None else F.lit(None).cast("array<string>")
    board = lambda code, name: F.when(codes.isNotNull(), F.array_contains(codes, code)).otherwise(F.array_contains(listed, name))
    return F.struct(
        F.coalesce(first, second).alias("family"), mobility.alias("mobility"), basis.alias("basis"), contested.alias("contested"), F.when(yes != no, yes).alias("windows"),
        board(CHALK, "Chalk").alias("chalk"), board(WHITE, "Dry Erase").alias("white"),
    )


def two_pass_match(cards: DataFrame, rooms: DataFrame) -> DataFrame:
    """``cards`` (card_id, group, place, room, title_room) with the key of ``rooms`` (key, place, room) and how it was found.

    First by the card's own place and room, then by its title's room in the place that most cards of its group name
    (of equal ones the smaller).
    """
    votes = cards.where("place is not null").groupBy("group", "place").agg(F.count(F.lit(1)).alias("n"))
    voted = votes.groupBy("group").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("place"))).alias("v")).select("group", F.col("v.place").alias("voted"))
    known = rooms.groupBy("place", "room").agg(F.min("key").alias("key"))
    first = cards.join(known.withColumnRenamed("key", "by_photo"), ["place", "room"], "left").join(voted, "group", "left")
    second = known.select(F.col("place").alias("voted"), F.col("room").alias("title_room"), F.col("key").alias("by_title"))
    both = first.join(second, ["voted", "title_room"], "left")
    how = F.when(F.col("by_photo").isNotNull(), "photo").when(F.col("by_title").isNotNull(), "title")
    return both.select("card_id", F.coalesce("by_photo", "by_title").alias("key"), how.alias("matched_by"))


def abbr_fanout(hours: DataFrame, codes: DataFrame) -> DataFrame:
    """``hours`` (abbr, ...) for each place that goes by the abbreviation; one without a place is kept with a null, a fault.

    ``codes``: abbr, place_id.
    """
    return hours.join(codes.select("abbr", "place_id").distinct(), "abbr", "left")


def learn_prefix(df: DataFrame) -> DataFrame:
    """Per place the start of its resources' ids: what stands before the room, its number padded to four digits.

    ``df``: place_id, resource_id, room. Of several the greatest.
    """
    pattern = r"^([A-Za-z]*)([0-9]*)(.*)$"
    part = lambda i: F.regexp_extract("room", pattern, i)
    number = F.when(part(2) == "", "").when(F.length(part(2)) < 4, F.lpad(part(2), 4, "0")).otherwise(part(2))
    rows = df.withColumn("_tail", F.concat(part(1), number, part(3))).where(F.endswith("resource_id", F.col("_tail")) & (F.col("room") != ""))
    prefix = F.expr("substring(resource_id, 1, length(resource_id) - length(_tail))")
    return rows.groupBy("place_id").agg(F.max(prefix).alias("prefix"))


def interval_tuples(df: DataFrame) -> DataFrame:
    """Distinct (place, room, day, start, end) of rows that have all of them. ``df``: place, room, days (7 flags), start, end."""
    days = F.array_compact(F.transform("days", lambda f, i: F.when(f, i)))
    rows = df.where("place is not null and room is not null and start is not null and end is not null and end > start")
    return rows.select(F.concat_ws(":", "place", "room").alias("room"), F.explode(days).alias("day"), "start", "end").distinct()


def door_funnel(doors: DataFrame, places: DataFrame, most: float) -> DataFrame:
    """``stage`` of each door, the first test that it fails: noBuildingCode, unknownBuilding, noCoordinate, notBuilt,
    duplicatePoint (of one place, to six decimals; the least door_id stays), tooFarFromBuilding; else kept. Kept ones
    have ``place``, their order by distance.

    ``doors``: door_id, place_id, lat, lon, status; ``places``: place_id, lat, lon; ``most``: metres.
    """
    from lacuna.functions.scalars import planar_m

    p = places.select("place_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")).withColumn("_known", F.lit(True))
    rows = doors.join(p, "place_id", "left").withColumn("metres", planar_m(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")))
    early = F.when(F.col("place_id").isNull(), "noBuildingCode").when(F.col("_known").isNull(), "unknownBuilding").when(F.col("lat").isNull() | F.col("lon").isNull(), "noCoordinate").when(F.col("status").isin("Planned", "Removed"), "notBuilt")
    rows = rows.withColumn("_early", early)
    point = [F.col("_early").isNull(), F.col("place_id"), F.round("lat", 6), F.round("lon", 6)]
    first = F.when(F.col("_early").isNull(), F.min("door_id").over(Window.partitionBy(*point)))
    rows = rows.withColumn("_first", first)
    stage = F.when(F.col("_early").isNotNull(), F.col("_early")).when(F.col("door_id") != F.col("_first"), "duplicatePoint").when(F.col("metres") > most, "tooFarFromBuilding").otherwise("kept")
    rows = rows.withColumn("stage", stage)
    kept = F.when(F.col("stage") == "kept", F.row_number().over(Window.partitionBy("place_id", "stage").orderBy("metres", "door_id")).cast("long"))
    return rows.withColumn("place", kept).select("door_id", "place_id", "stage", "metres", "place")


def farthest_vertex(rings: Column, x: Column, y: Column) -> Column:
    """Metres from a pin to the farthest vertex of an outline, an array of rings of struct(x, y); null without vertices."""
    away = lambda v: F.sqrt((v["x"] - x) * (v["x"] - x) + (v["y"] - y) * (v["y"] - y))
    return F.array_max(F.transform(F.flatten(rings), away))


def footprint_bias(outlines: DataFrame) -> DataFrame:
    """Over places the median, 90 % and most of the distance from the pin to the farthest corner, by rank floor(n * p).

    ``outlines``: place_id, x, y (the pin), rings (array of rings, arrays of struct(x, y)); rows of one place count
    together. Vertices are looked at inside their row.
    """
    far = outlines.select("place_id", farthest_vertex(F.col("rings"), F.col("x"), F.col("y")).alias("far")).where("far is not null").groupBy("place_id").agg(F.max("far").alias("far"))
    ordered = far.groupBy("far").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("far"))  # a row a place's distance
    ranked = ordered.withColumn("upto", upto).withColumn("all", F.sum("n").over(Window.partitionBy()))
    pick = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("all") - 1, F.floor(F.col("all") * p)), F.col("far")))
    return ranked.agg(F.sum("n").alias("places"), pick(0.5).alias("median"), pick(0.9).alias("p90"), F.max("far").alias("most"))


def trial_tally(visits: DataFrame) -> DataFrame:
    """How answers fared, by whether hours were known: picked, shown, visited, and the verdicts.

    ``visits``: hours_known, shown, outcome (null: not visited; empty, occupied, missing, locked-outer, locked-inner).
    """
    o = F.col("outcome")
    verdict = F.when(o == "empty", "confirmed").when(o.isin("occupied", "missing") | (o == "locked-outer") & F.col("hours_known"), "contradicted").when(o.isNotNull(), "unclaimed")
    rows = visits.withColumn("verdict", verdict)
    count = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return rows.groupBy("hours_known").agg(
        F.count(F.lit(1)).alias("picked"), F.count_if("shown").alias("shown"), F.count("outcome").alias("visited"), count("confirmed"), count("contradicted"), count("unclaimed"), F.count_if(o != "empty").alias("unusable")
    )


def free_window_analysis(busy: DataFrame, feed: DataFrame, resources: DataFrame, windows: Sequence[tuple[str, Sequence[int], int, int]]) -> DataFrame:
    """Per named window (name, days, from, to): its minutes over all resources, free ones, and those that feed rows take
    of it and of its free gaps, by kind.

    ``busy`` and ``feed``: resource_id, day, start, end, label (feed: kind); ``resources``: resource_id.
    """
    spark = busy.sparkSession
    keys = ["name", "resource_id", "day"]
    table = F.broadcast(spark.createDataFrame([(n, d, a, b) for n, days, a, b in windows for d in days], "name string, day int, open int, close int"))  # a row a window's day
    size = resources.select("resource_id").distinct().agg(F.count(F.lit(1)).alias("resources"))
    whole = table.crossJoin(F.broadcast(size)).groupBy("name").agg(F.sum((F.col("close") - F.col("open")) * F.col("resources")).alias("window_minutes"))  # one row each
    inside = clip_intervals(busy.where("end > start").select("resource_id", "day", "start", "end").join(table, "day")).withColumn("label", F.lit("x"))
    taken = merge_intervals(inside.select(*keys, "start", "end", "label"), keys).groupBy("name").agg(F.sum(F.col("end") - F.col("start")).alias("taken"))
    at = clip_intervals(feed.where("end > start").select("resource_id", "day", "start", "end", "kind").join(table, "day")).withColumn("label", F.lit("x"))
    merged = merge_intervals(at.select(*keys, "kind", "start", "end", "label"), [*keys, "kind"])
    some = merged.select(*keys).distinct()
    spans = some.join(table.drop("day").distinct(), "name")
    gaps = free_gaps(inside.select(*keys, "start", "end").join(some, keys, "left_semi"), spans, keys).select(*keys, F.col("gap_start").alias("start"), F.col("gap_end").alias("end"))
    both = overlap_join(merged.select(*keys, "kind", "start", "end"), gaps, keys)
    free = both.groupBy("name", F.col("a_kind").alias("kind")).agg(F.sum(F.least("a_end", "b_end") - F.greatest("a_start", "b_start")).alias("n"))
    total = merged.groupBy("name", "kind").agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    per = lambda df, kind, name: df.where(F.col("kind") == kind).select("name", F.col("n").alias(name))
    out = whole.join(taken, "name", "left")
    for df, kind, name in ((total, "event", "event_minutes"), (total, "block", "block_minutes"), (free, "event", "event_free"), (free, "block", "block_free")):
        out = out.join(per(df, kind, name), "name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("name", F.col("window_minutes").cast("long").alias("window_minutes"), (F.col("window_minutes") - F.coalesce("taken", F.lit(0))).cast("long").alias("free_minutes"), *[zero(c) for c in ("event_minutes", "block_minutes", "event_free", "block_free")])


def holds_on(holds: DataFrame, claims: DataFrame, packup: int = 10) -> DataFrame:
    """``claims`` (resource_id, date, now, state, until) with whether a hold is on now, and the minute from which a free one
    may be booked: that of a hold that starts where the free time ends. ``holds``: resource_id, date, start, end."""
    h = holds.select("resource_id", "date", "start", "end")
    rows = claims.join(h, ["resource_id", "date"], "left")
    held = F.coalesce(F.bool_or((F.col("start") <= F.col("now")) & (F.col("now") < F.col("end"))), F.lit(False))
    at = F.min(F.when((F.col("state") == "free") & (F.col("start") == F.col("until") + packup), F.col("start")))
    return rows.groupBy("resource_id", "date", "now", "state", "until").agg(held.alias("held_now"), at.alias("may_be_booked"), F.count("start").alias("holds"))


def circuity(routes: DataFrame) -> DataFrame:
    """Per source the mean, the median and the 90 % point of routed by straight metres. ``routes``: source, routed, straight."""
    ratio = F.col("routed") / F.col("straight")
    rows = routes.where("straight > 0")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ratio), 9).alias("mean"), F.round(F.percentile(ratio, 0.5), 9).alias("median"), F.round(F.percentile(ratio, 0.9), 9).alias("p90"))
