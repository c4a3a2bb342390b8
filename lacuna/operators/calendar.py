"""Dates of a term: what the calendar says of a day, what is answered on it, and whether sources agree."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.scalars import MONTHS, tokens_of
from lacuna.operators.graph import cut

DARK = 0.005  #: share of live rows below which a day's schedule counts as empty
WORKING_DAYS = ("mon", "tue", "wed", "thu", "fri")  #: how the names of days with exams begin
WEEKEND = (7 * 60, 23 * 60)  #: the hours that are searched at a weekend


def calendar_lookup(dates: DataFrame, closed: DataFrame, windows: DataFrame) -> DataFrame:
    """``dates`` (date) with the closure's state and name, and in_term, exams and low_confidence.

    ``closed``: date, state, name; ``windows``: kind (term, exams, low), first, last: some rows a term, spread by their days.
    """
    rows = dates.join(closed.groupBy("date").agg(F.min(F.struct("state", "name")).alias("c")), "date", "left")
    days = windows.select("kind", F.explode(F.sequence("first", "last")).alias("date")).groupBy("date").agg(F.collect_set("kind").alias("kinds"))
    has = lambda kind: F.coalesce(F.array_contains("kinds", kind), F.lit(False))
    return rows.join(days, "date", "left").select(*dates.columns, F.col("c.state").alias("state"), F.col("c.name").alias("name"), has("term").alias("in_term"), has("exams").alias("exams"), has("low").alias("low_confidence"))


def resolve_state(refusal: Column, state: Column, low: Column, day: Column) -> Column:
    """struct(kind, note, suspended): refused, or ranked with the first note that holds."""
    note = F.when(state == "no-classes", "suspended").when(low, "low-confidence").when(day.isin(0, 6), "weekend")
    return F.struct(F.when(refusal.isNotNull(), "REFUSED").otherwise("RANKED").alias("kind"), F.when(refusal.isNull(), note).alias("note"), F.coalesce(refusal.isNull() & (state == "no-classes"), F.lit(False)).alias("suspended"))


def schedule_covers(in_term: Column, state: Column, exams: Column, active: Column, share: Column) -> Column:
    """Whether a class schedule holds on a date: in term, open, no exams, an active weekday, and not dark."""
    return in_term & ~F.coalesce(state == "offices-closed", F.lit(False)) & ~exams & active & (F.coalesce(share, F.lit(0.0)) >= DARK)


def schedule_share_on(busy: DataFrame, sessions: DataFrame, dates: DataFrame) -> DataFrame:
    """Per date the share of its weekday's rows whose session is live (0 without rows), and whether the day is dark."""
    per = busy.groupBy("day", "session_id").agg(F.count(F.lit(1)).alias("rows")).join(sessions, "session_id", "left")  # a row a weekday and session
    both = dates.select("date").distinct().withColumn("day", F.dayofweek("date") - 1).join(per, "day", "left")
    live = F.col("first").isNull() | F.col("date").between(F.col("first"), F.col("last"))
    out = both.groupBy("date").agg(F.sum(F.when(live, F.col("rows")).otherwise(0)).alias("live"), F.sum("rows").alias("total"))
    return out.select("date", F.coalesce(F.col("live") / F.col("total"), F.lit(0.0)).alias("share")).withColumn("dark", F.col("share") < DARK)


def next_search_window(asks: DataFrame, days: DataFrame, ahead: int = 7) -> DataFrame:
    """The first day within a week whose search window is still to begin: ahead, day, at.

    ``asks``: ask_id, date, now; ``days``: date, ranked, covered, start (of the weekday's window).
    """
    rows = asks.withColumn("ahead", F.explode(F.sequence(F.lit(0), F.lit(ahead - 1)))).withColumn("date", F.date_add("date", F.col("ahead")))
    day = F.dayofweek("date") - 1
    rows = rows.join(days, "date").where("ranked").withColumn("day", day)
    at = F.when(F.col("day").isin(0, 6), WEEKEND[0]).when(F.col("covered"), F.col("start"))
    rows = rows.withColumn("at", at).where(F.col("at").isNotNull() & ((F.col("ahead") > 0) | (F.col("now") < F.col("at"))))
    return rows.groupBy("ask_id").agg(F.min(F.struct("ahead", "day", "at")).alias("n")).select("ask_id", "n.*")


def needed_minutes(need: Column, now: Column, latest: Column, whole_day: Column) -> Column:
    """What a question needs: for the whole day the time to the last end, half an hour at least."""
    return F.when(whole_day, F.greatest(F.lit(30), latest - now)).otherwise(need)


def day_claim(exams: Column, in_term: Column, state: Column, closed: Column, first: Column) -> Column:
    """The head of a day: finals, out-of-term, campus-closed, no-classes, closed, first-class or no-class."""
    return (
        F.when(exams, "finals").when(~in_term, "out-of-term").when(state == "offices-closed", "campus-closed").when(state == "no-classes", "no-classes")
        .when(closed, "closed").when(first.isNotNull(), "first-class").otherwise("no-class")
    )


def window_bounds(events: DataFrame, begins: str, ends: str, exams: str, keys: Sequence[str] = (), within: int = 60) -> DataFrame:
    """Per key the teaching window (first day that ``begins`` matches, last that ``ends`` does) and the exams' after it.

    ``events``: keys, summary, date. Exam days count up to ``within`` days after the last day of teaching.
    """
    keys = list(keys)
    term = events.groupBy(*keys).agg(F.min(F.when(F.col("summary").rlike(begins), F.col("date"))).alias("first"), F.max(F.when(F.col("summary").rlike(ends), F.col("date"))).alias("last"))
    term = term.where("first is not null and last is not null")
    late = events.where(F.col("summary").rlike(exams)).join(term, keys) if keys else events.where(F.col("summary").rlike(exams)).crossJoin(F.broadcast(term))  # one row
    found = late.where((F.col("date") > F.col("last")) & (F.col("date") <= F.date_add("last", within))).groupBy(*keys, "first", "last").agg(F.min("date").alias("exams_first"), F.max("date").alias("exams_last"))
    on = [*keys, "first", "last"]
    return term.join(found, on, "left")


def window_check(windows: DataFrame, slack: dict[str, int]) -> DataFrame:
    """Per key the window of the preferred source that has one, and the others' verdicts.

    ``windows``: key, source, first, last, term_last. ``slack``: days that each source may be off, in order of preference.
    """
    order = F.create_map(*[F.lit(x) for i, s in enumerate(slack) for x in (s, i)])
    allowed = F.create_map(*[F.lit(x) for s, n in slack.items() for x in (s, n)])
    best = windows.groupBy("key").agg(F.min(F.struct(order[F.col("source")].alias("o"), "first", "last")).alias("b"))
    both = windows.join(best, "key")
    slip = F.greatest(F.abs(F.datediff("first", "b.first")), F.abs(F.datediff("last", "b.last")))
    verdict = F.when(F.col("b.first") <= F.col("term_last"), "before-term-end").when(F.col("slip") > allowed[F.col("source")], "disagrees").when(F.col("slip") > 0, "slid").otherwise("agrees")
    return both.withColumn("slip", slip).select("key", "source", F.col("b.first").alias("exams_first"), F.col("b.last").alias("exams_last"), "slip", verdict.alias("verdict"))


def slid_dates(left: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """Days that one calendar has and the other doesn't, paired by state with the nearest within ``tolerance`` days.

    Both: key, date, state. The nearest pair of all is taken first, of equal ones that with the earlier days, and so on
    until none is left. That is done gap by gap: days that are ``gap`` apart and of alternating calendars form chains, and
    in a chain the best pairs are always the first two days, the next two, and so on. Returns key, left_date, right_date,
    state, gap; unpaired days have a null partner, a date with two states both its states' rows alone.
    """
    a, b = (df.select("key", "date", "state").distinct() for df in (left, right))
    only = lambda x, y, side: x.join(y.select("key", "date"), ["key", "date"], "left_anti").withColumn("side", F.lit(side))
    rest = only(a, b, "l").unionByName(only(b, a, "r"))
    pairs = []
    for gap in range(1, tolerance + 1):
        line = Window.partitionBy("key", "state", F.pmod(F.unix_date("date"), F.lit(gap))).orderBy("date")
        before = F.lag(F.struct("date", "side")).over(line)
        starts = F.when((F.datediff("date", before["date"]) == gap) & (before["side"] != F.col("side")), 0).otherwise(1)
        chains = rest.withColumn("_new", starts).withColumn("_chain", F.sum("_new").over(line))
        own = Window.partitionBy("key", "state", F.pmod(F.unix_date("date"), F.lit(gap)), "_chain").orderBy("date")
        placed = chains.withColumn("_at", F.row_number().over(own)).withColumn("_next", F.lead("date").over(own)).withColumn("_first", F.col("_at") % 2 == 1)
        placed = cut(placed.withColumn("_paired", ~F.col("_first") | F.col("_next").isNotNull()).select("key", "date", "state", "side", "_next", "_first", "_paired"))
        won = placed.where("_first and _paired")
        day = lambda side: F.when(F.col("side") == side, F.col("date")).otherwise(F.col("_next"))
        pairs.append(won.select("key", "state", day("l").alias("left_date"), day("r").alias("right_date"), F.lit(gap).alias("gap")))
        rest = placed.where("not _paired").select("key", "date", "state", "side")
    day = lambda side: F.when(F.col("side") == side, F.col("date"))
    alone = rest.select("key", "state", day("l").alias("left_date"), day("r").alias("right_date"), F.lit(None).cast("int").alias("gap"))
    two = a.join(b.withColumnRenamed("state", "other"), ["key", "date"]).where("state <> other").select("key", F.concat("state", F.lit("/"), "other").alias("state"), F.col("date").alias("left_date"), F.col("date").alias("right_date"), F.lit(None).cast("int").alias("gap"))
    return reduce(DataFrame.unionByName, [*pairs, alone, two])


def exam_dates_in_cells(df: DataFrame, key: str, column: str, year: Column) -> DataFrame:
    """Per key the first and last day that cells name: "Monday 12/14", or "Monday, Dec 14[, 2026]"; another year's are not read.

    A cell is read as tokens, commas and stops aside: a working day's name, then two numbers around a slash, or a month's
    name (its first three letters count) and a day, with or without the year.
    """
    t = F.filter(tokens_of(F.col(column)), lambda x: ~x.isin(",", "."))
    at = lambda i: F.get(t, F.lit(i))
    number = lambda x: x.try_cast("int")
    named = F.nullif(F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.left(at(1), F.lit(3))), F.lit(0)).cast("int")
    working = F.left(at(0), F.lit(3)).isin(*WORKING_DAYS)
    slash = (F.size(t) == 4) & (at(2) == "/")
    spelled = named.isNotNull() & ((F.size(t) == 3) | (F.size(t) == 4) & (number(at(3)) == year))
    date = F.when(working & slash, F.struct(number(at(1)).alias("m"), number(at(3)).alias("d"))).when(working & spelled, F.struct(named.alias("m"), number(at(2)).alias("d")))
    rows = df.withColumn("_p", date).withColumn("_d", F.format_string("%04d-%02d-%02d", year, F.col("_p.m"), F.col("_p.d")).try_cast("date"))
    return rows.where("_p.m is not null and _d is not null").groupBy(key).agg(F.min("_d").alias("first"), F.max("_d").alias("last"), F.countDistinct("_d").alias("days"))


def column_of(cells: DataFrame, header: str) -> DataFrame:
    """table_id, row and text of the column whose cell in row 0 is the header, case aside. ``cells``: table_id, row, col, text."""
    head = cells.where((F.col("row") == 0) & (F.lower(F.trim("text")) == header.lower())).select("table_id", "col").distinct()
    return cells.where("row > 0").join(head, ["table_id", "col"], "left_semi").select("table_id", "row", "text")


def date_cells(df: DataFrame, column: str) -> DataFrame:
    """The days of a cell "yyyy-mm-dd" or "yyyy-mm-dd to yyyy-mm-dd"."""
    pattern = r"^\s*([0-9]{4}-[0-9]{2}-[0-9]{2})(?:\s+to\s+([0-9]{4}-[0-9]{2}-[0-9]{2}))?\s*$"
    part = lambda i: F.to_date(F.nullif(F.regexp_extract(column, pattern, i), F.lit("")))
    return df.withColumn("_a", part(1)).withColumn("_b", F.coalesce(part(2), F.col("_a"))).where("_a <= _b").withColumn("day", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")


def term_bounds_guard(terms: DataFrame, closed: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """Per term (term, season, first, last, exams_first) the count of closed days in it and its fault: few, many, outside or exams.

    ``closed``: term, date. ``bounds``: closed days of a season, least and most.
    """
    inside = F.col("date").between(F.col("first"), F.col("last"))
    counts = terms.join(closed, "term", "left").groupBy("term", "season", "first", "last", "exams_first").agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))
    low, high = (F.create_map(*[F.lit(x) for s, b in bounds.items() for x in (s, b[i])])[F.col("season")] for i in (0, 1))
    fault = F.when(F.col("outside") > 0, "outside").when(F.col("inside") < low, "few").when(F.col("inside") > high, "many").when(F.col("exams_first") <= F.col("last"), "exams")
    return counts.select("term", "inside", "outside", fault.alias("fault"))


def feed_coverage(weeks: DataFrame, expected: DataFrame) -> DataFrame:
    """Per feed its weeks in order with what is wrong: wrong-week, gap (not the next one), partial, ids (not those expected).

    ``weeks``: feed, week_start, partial, resources (array); ``expected``: feed, week (that the first must be), resources.
    """
    by = Window.partitionBy("feed").orderBy("week_start")
    rows = weeks.withColumn("place", F.row_number().over(by)).withColumn("before", F.lag("week_start").over(by)).join(expected.withColumnRenamed("resources", "_want"), "feed")
    fault = (
        F.when((F.col("place") == 1) & (F.col("week_start") != F.col("week")), "wrong-week").when(F.col("before").isNotNull() & (F.datediff("week_start", "before") != 7), "gap")
        .when(F.col("partial"), "partial").when(F.array_sort("resources") != F.array_sort("_want"), "ids")
    )
    return rows.select("feed", "week_start", fault.alias("fault"))
