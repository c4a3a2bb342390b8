"""Opening hours as text and as dated spans: reading them, where a door stands at a minute, and which to go to."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.scalars import CAPITALS, DASHES, DAY, DIGITS, MONTHS, clock_to_minutes, tokens_of, words_of

CLOCK = r"[0-9]{1,2}(?::[0-9]{2})?\s*[AaPp]\.?\s*[Mm]\.?"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _close(text: Column) -> Column:
    """A closing time: one in the hour after midnight belongs to the day before."""
    at = clock_to_minutes(text)
    return F.when(at < 60, at + DAY).otherwise(at)


def range_to_span(text: Column, overnight: bool = False) -> Column:
    """``7am-10pm`` as struct(open, close, error): closed is a null pair without an error, what can't be read has one.

    The two times stand on either side of one dash of any length, or of the word "to". With ``overnight`` a close at or
    before the open is the next day's, else it is an error.
    """
    flat = F.rtrim(F.lower(F.trim(text)), F.lit("."))
    dashed = F.replace(F.translate(flat, DASHES, "---"), F.lit(" to "), F.lit("-"))

    def read(line: Column) -> Column:
        from_, until = F.trim(F.substring_index(line, "-", 1)), F.trim(F.substring_index(line, "-", -1))
        times = F.struct(clock_to_minutes(from_).alias("open"), (clock_to_minutes(until) if overnight else _close(until)).alias("close"))
        return let(times, lambda t: judged(line, t["open"], F.when(t["close"] <= t["open"], t["close"] + DAY).otherwise(t["close"]) if overnight else t["close"]))

    def judged(line: Column, open_: Column, close: Column) -> Column:
        dashes = F.length(line) - F.length(F.replace(line, F.lit("-"), F.lit("")))
        closed = line == "closed"
        error = F.when(line.isNull() | (line == ""), "empty").when(closed, None).when(dashes != 1, "separator").when(open_.isNull(), "open").when(close.isNull(), "close").when(close <= open_, "order")
        good = error.isNull() & ~closed
        return F.struct(F.when(good, open_).alias("open"), F.when(good, close).cast("int").alias("close"), error.alias("error"))

    return let(dashed, read)


def feed_day_hours(status: Column, hours: Column, text: Column) -> Column:
    """A feed's day as an array of spans: none when closed, null when nothing can be read from it.

    ``hours``: array of struct(from, to), used when open. Texts are read as 24 hours (to a "closed at") or one range.
    """
    span = lambda a, b: range_to_span(F.concat(a, F.lit("-"), b), True)
    pair = lambda s: F.struct(s["open"].alias("open"), s["close"].alias("close"))
    listed = let(F.transform(hours, lambda h: let(span(h["from"], h["to"]), pair)), lambda spans: F.when(F.forall(spans, lambda s: s["open"].isNotNull()) & (F.size(spans) > 0), spans))
    until = F.regexp_extract(text, rf"(?i)closed at\s*({CLOCK})", 1)
    end = F.when(until == "", DAY).otherwise(clock_to_minutes(until))
    whole = F.when(end.isNotNull(), F.array(F.struct(F.lit(0).alias("open"), end.cast("int").alias("close"))))
    one = let(range_to_span(F.regexp_extract(text, rf"^\s*({CLOCK}\s*[-–]\s*{CLOCK})", 1), True), lambda s: F.when(s["open"].isNotNull(), F.array(pair(s))))
    none = F.array().cast("array<struct<open:int,close:int>>")
    all_day = (status == "24hours") | (status == "text") & text.rlike(r"(?i)^\s*24 hours")
    return F.when(status == "closed", none).when(status == "open", listed).when(all_day, whole).when(status == "text", one)


def title_parts(title: Column) -> Column:
    """``Name (ABBR) | address`` as struct(name, abbr, address), null without an abbreviation.

    What comes before the bar is split at its last bracket, which holds up to four capitals and digits; what follows the
    bracket there, and the bar, is the address.
    """
    flat = F.array_join(words_of(title), " ")
    head, bar = F.substring_index(flat, "|", 1), F.instr(flat, "|")
    inside = F.substring_index(head, "(", -1)
    abbr, behind = F.substring_index(inside, ")", 1), F.substring(inside, F.instr(inside, ")") + 1, F.length(inside))
    name = F.trim(F.left(head, F.length(head) - F.length(inside) - 1))
    address = F.trim(F.concat(F.trim(behind), F.when(bar > 0, F.substring(flat, bar + 1, F.length(flat))).otherwise("")))
    good = (F.instr(head, "(") > 0) & (F.instr(inside, ")") > 0) & F.length(abbr).between(1, 4) & (F.translate(abbr, CAPITALS + DIGITS, "") == "")
    return F.when(good, F.struct(name.alias("name"), abbr.alias("abbr"), F.nullif(address, F.lit("")).alias("address")))


def _date(year: Column, month: Column, day: Column) -> Column:
    """The date, null where there is none such."""
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.format_string("%04d-%02d-%02d", year, month, day).try_cast("date"))


def dated_lines(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ranges (array of struct(first, last)) and early of each line such as "March 12-20, 2027".

    The line is read as tokens. A date is a month's name and a day, or a day behind a dash, with the year that follows a
    comma. Two dates with a dash between them are a range, any other named one is a day. A year or month that one end
    lacks is the other end's (a start in a later month than the end is in the year before); without any year a date is
    not read. A date behind the words "close on" is none of the ranges but an early close, in the year in which the last
    range starts.
    """
    number = lambda x: x.try_cast("int")
    month = lambda x: F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), x), F.lit(0)).cast("int")
    is_day = lambda x: (F.length(x) <= 2) & number(x).isNotNull()
    at = lambda i: F.get("_t", i)

    def atom(x: Column, i: Column) -> Column:
        """The date whose first token is the i-th, or null: where it stands, which token follows it, and what it says."""
        named = month(x).isNotNull() & is_day(at(i + 1))
        last = F.when(named, i + 1).when(is_day(x) & (i > 0) & (at(i - 1) == "-"), i)
        has_year = F.coalesce((at(last + 1) == ",") & (F.length(at(last + 2)) == 4) & number(at(last + 2)).isNotNull(), F.lit(False))
        early = F.coalesce(named & (i > 1) & (at(i - 1) == "on") & (at(i - 2) == "close"), F.lit(False))
        return F.when(last.isNotNull(), F.struct(i.alias("at"), month(x).alias("month"), number(at(last)).alias("day"), F.when(has_year, number(at(last + 2))).alias("year"), (last + F.when(has_year, 3).otherwise(1)).alias("next"), early.alias("early")))

    rows = df.withColumn("_t", tokens_of(F.col(column))).withColumn("_a", F.array_compact(F.transform("_t", atom)))
    rows = rows.withColumn("_e", F.get(F.filter("_a", lambda a: a["early"]), F.lit(0)))
    rows = rows.withColumn("_a", F.filter("_a", lambda a: F.col("_e").isNull() | (a["at"] < F.col("_e.at"))))
    # each date with the one that a dash joins to it
    joins = lambda a, b: (b["at"] == a["next"] + 1) & (at(a["next"]) == "-")
    rows = rows.withColumn("_p", F.transform("_a", lambda a, i: F.struct(a.alias("a"), F.when(joins(a, F.get("_a", i + 1)), F.get("_a", i + 1)).alias("b"), F.coalesce((i > 0) & joins(F.get("_a", i - 1), a), F.lit(False)).alias("second"))))
    rows = rows.withColumn("_p", F.transform(F.filter("_p", lambda p: p["a"]["month"].isNotNull() & ~p["second"]), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.coalesce(p["b"]["year"], p["a"]["year"]).alias("year"), F.coalesce(p["b"]["month"], p["a"]["month"]).alias("month"))))
    begins = lambda p: F.coalesce(p["a"]["year"], p["year"] - F.when(p["month"] < p["a"]["month"], 1).otherwise(0))
    ranges = F.transform("_p", lambda p: F.struct(_date(begins(p), p["a"]["month"], p["a"]["day"]).alias("first"), _date(p["year"], p["month"], F.coalesce(p["b"]["day"], p["a"]["day"])).alias("last")))
    rows = rows.withColumn("ranges", F.filter(ranges, lambda r: r["first"].isNotNull() & r["last"].isNotNull()))
    year = F.year(F.try_element_at("ranges", F.lit(-1))["first"])
    return rows.withColumn("early", F.when(year.isNotNull(), _date(year, F.col("_e.month"), F.col("_e.day")))).drop("_t", "_a", "_e", "_p")


def date_ranges(df: DataFrame, column: str, key: str) -> DataFrame:
    """key, first, last of each range in a line, and its early close (null: none); see dated_lines. Equal lines are read once."""
    rows = dated_lines(df.select(column).where(F.col(column).isNotNull()).distinct(), column)
    # outer: else Spark tests the array's size below all steps, where every step's expression stands inside the next one's
    rows = rows.select(column, F.explode_outer("ranges").alias("r"), "early").where("r is not null").select(column, "r.first", "r.last", "early")
    return df.select(key, column).join(rows, column).drop(column)


def rule_days(days: DataFrame, closed: DataFrame, breaks: DataFrame, tables: DataFrame, early: DataFrame, early_close: int = 1200) -> DataFrame:
    """Dated hours from rules: date with open and close (null: closed).

    ``days``: date; ``closed`` and ``breaks``: first, last, some rows a term; ``tables``: kind (regular, break), weekend,
    open, close, four rows; ``early``: date.
    """
    span = lambda table, name: table.select("first", "last").select(F.explode(F.sequence("first", "last")).alias("date")).distinct().withColumn(name, F.lit(True))
    rows = days.join(span(closed, "_closed"), "date", "left").join(span(breaks, "_break"), "date", "left").join(early.select("date").distinct().withColumn("_early", F.lit(True)), "date", "left")
    rows = rows.withColumn("kind", F.when(F.col("_break").isNotNull(), "break").otherwise("regular")).withColumn("weekend", F.dayofweek("date").isin(1, 7))
    rows = rows.join(tables, ["kind", "weekend"], "left")
    shut = F.col("_closed").isNotNull()
    close = F.when(F.col("_early").isNotNull(), F.least("close", F.lit(early_close))).otherwise(F.col("close"))
    return rows.select("date", F.when(~shut, F.col("open")).alias("open"), F.when(~shut, close).alias("close"))


def door_at(asks: DataFrame, spans: DataFrame, published: DataFrame) -> DataFrame:
    """``when`` a place's door stands at a minute: open (until ``closes``), before (``opens``), after, closed-today or unknown.

    ``asks``: place_id, date, now; ``spans``: place_id, date, open, close (past 1440: into the next day); ``published``:
    place_id, date of the days about which anything is known. A span that runs over midnight holds on the next day, of
    which else nothing needs to be known. Closes are minutes of the day asked about.
    """
    own = spans.select("place_id", "date", "open", "close")
    spill = spans.where(F.col("close") > DAY).select("place_id", F.date_add("date", 1).alias("date"), F.lit(0).alias("open"), (F.col("close") - DAY).alias("close"))
    rows = asks.join(own.unionByName(spill), ["place_id", "date"], "left")
    now = F.col("now")
    here = (F.col("open") <= now) & (now < F.col("close"))
    agg = rows.groupBy("place_id", "date", "now").agg(F.min(F.when(here, F.struct("open", "close"))).alias("h"), F.min(F.when(F.col("open") > now, F.col("open"))).alias("next"), F.count("open").alias("n"))
    agg = agg.join(published.select("place_id", "date").distinct().withColumn("_known", F.lit(True)), ["place_id", "date"], "left")
    when = F.when(F.col("h").isNotNull(), "open").when(F.col("_known").isNull(), "unknown").when(F.col("next").isNotNull(), "before").when(F.col("n") == 0, "closed-today").otherwise("after")
    agg = agg.withColumn("when", when)
    return agg.select("place_id", "date", "now", "when", F.col("h.close").alias("closes"), F.when(F.col("when") == "before", F.col("next")).alias("opens"))


def rank_dated_places(doors: DataFrame) -> DataFrame:
    """Open and shut places of each question in order of walk, metres and name; unknown ones are out.

    ``doors``: ask_id, place_id, name, walk, metres, when.
    """
    rows = doors.where("when <> 'unknown'").withColumn("group", F.when(F.col("when") == "open", "open").otherwise("closed"))
    by = Window.partitionBy("ask_id", "group").orderBy("walk", F.round("metres"), "name")
    return rows.withColumn("place", F.row_number().over(by).cast("long"))


def study_fallback(ranked: DataFrame, least: int = 30, limit: int = 2) -> DataFrame:
    """The nearest open places with ``least`` minutes left after the walk, ``limit`` for each question."""
    good = ranked.where("group = 'open'").where(F.col("closes").isNull() | (F.col("closes") - F.col("now") - F.col("walk") >= least))
    return good.withColumn("place", F.row_number().over(Window.partitionBy("ask_id").orderBy("place")).cast("long")).where(F.col("place") <= limit)


def slash_halves(ident: Column) -> Column:
    """The two ids that a slash form names: A123/45 stands for A123 and A145. Null for any other id.

    The digits behind the last slash take the place of as many at the end of the number before it.
    """
    tail = F.substring_index(ident, "/", -1)
    base = F.left(ident, F.length(ident) - F.length(tail) - 1)
    digits = F.length(base) - F.length(F.rtrim(base, F.lit(DIGITS)))
    form = (F.instr(ident, "/") > 0) & (tail != "") & (F.translate(tail, DIGITS, "") == "") & (digits > 0)
    other = F.concat(F.left(base, F.length(base) - F.least(digits, F.length(tail))), tail)
    return F.when(form, F.array_distinct(F.array(base, other)))


def group_halves(df: DataFrame, keys: Sequence[str] = ("place",)) -> DataFrame:
    """parent, child of split resources. ``df``: keys, id, group flag.

    A parent's halves are ids that go on from its own, or those that its slash form names, where these exist. Prefixes
    are sought among parents alone, by every length that a parent has, so ids meet by equality.
    """
    keys = list(keys)
    ids = df.select(*keys, "id").distinct()
    parents = df.where("group").select(*keys, F.col("id").alias("parent"), slash_halves(F.col("id")).alias("_halves")).distinct()
    named = parents.where("_halves is not null").select(*keys, "parent", F.explode("_halves").alias("id")).where("id <> parent").join(ids, [*keys, "id"], "left_semi")
    plain = parents.where("_halves is null").drop("_halves")
    lengths = plain.select(*keys, F.length("parent").alias("n")).distinct()
    starts = ids.join(lengths, keys).where(F.length("id") > F.col("n")).select(*keys, "id", F.left("id", F.col("n")).alias("parent"))
    return named.select(*keys, "parent", F.col("id").alias("child")).unionByName(starts.join(plain, [*keys, "parent"], "left_semi").select(*keys, "parent", F.col("id").alias("child")))
