"""Column functions: clocks, dates, distances, walks, keys and text. No Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the domain
EARTH_M = 6371008.8  #: mean radius, metres
DEGREE_M = 111320.0  #: metres of a degree of latitude on the plane
WALK_M_PER_MIN = 78.0
DETOUR = 1.3  #: walked metres for each straight one
PACKUP = 10  #: minutes that an answer leaves for packing up
DAY = 1440
DIGITS, CAPITALS, DASHES = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "-–—"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def words_of(text: Column) -> Column:
    """What white space separates."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens_of(text: Column) -> Column:
    """Runs of letters (lower case), runs of digits, and every other character alone; dashes are one kind."""
    return F.regexp_extract_all(F.lower(F.translate(text, DASHES, "---")), F.lit(r"[a-z]+|[0-9]+|[^a-z0-9\s]"), F.lit(0))


def clock_to_minutes(text: Column, is_close: bool = False) -> Column:
    """``h:mm am`` or ``h am`` as minutes since midnight, null if it is none; 12 am as a close is the end of the day."""
    pattern = r"^\s*(1[0-2]|0?[1-9])(?::([0-5][0-9]))?\s*([AaPp])\.?[Mm]\.?\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    hour = F.expr("0") + part(1).try_cast("int") % 12
    minute = F.coalesce(part(2).try_cast("int"), F.lit(0))
    total = hour * 60 + minute + F.when(F.lower(part(3)) == "p", 720).otherwise(0)
    if is_close:
        total = F.when(total == 0, DAY).otherwise(total)
    return F.when(part(1) != "", total.cast("int"))


def day_to_date(week_start: Column, day: Column) -> Column:
    """The date of a weekday (0 is Sunday, the last day) in the week that starts on Monday ``week_start``."""
    return F.date_add(week_start, ((day + 6) % 7).cast("int"))


def week_monday(date: Column) -> Column:
    """The Monday of a date's week; a Sunday goes forward to the next day."""
    dow = F.dayofweek(date) - 1
    return F.date_add(date, F.when(dow == 0, 1).otherwise(1 - dow))


def add_weeks(date: Column, weeks: int) -> Column:
    return F.date_add(date, 7 * weeks)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def planar_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance with the cosine of the mean latitude."""
    y = F.radians(lat2 - lat1)
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return EARTH_M * F.sqrt(x * x + y * y)


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def walk_metres(routed: Column, straight: Column) -> Column:
    return F.coalesce(F.when(F.abs(routed) < float("inf"), routed), straight * DETOUR)


def walk_minutes(metres: Column) -> Column:
    """Whole minutes, rounded up."""
    return F.ceil(metres / WALK_M_PER_MIN).cast("int")


def usable_minutes(now: Column, walk: Column, start: Column, end: Column, packup: int = PACKUP, dst_at: Column | None = None, dst_lost: Column | None = None) -> Column:
    """Minutes left of a gap after the walk and packing up; a clock change inside takes its loss."""
    begin = F.greatest(now + walk, start)
    out = end - F.lit(packup) - begin
    if dst_at is not None:
        out = out - F.when((begin < dst_at) & (dst_at < end), dst_lost).otherwise(0)
    return out


def leave_by(now: Column, start: Column, walk: Column) -> Column:
    return F.greatest(now, start - walk)


def fmt_clock(minutes: Column) -> Column:
    h = F.floor(minutes / 60).cast("int") % 24
    return F.concat(F.when(h % 12 == 0, 12).otherwise(h % 12).cast("string"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"), F.when(h < 12, " am").otherwise(" pm"))


def fmt_dur(minutes: Column) -> Column:
    """``45 min``, ``2h``, ``1h05``."""
    h, m = F.floor(minutes / 60).cast("string"), minutes % 60
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).when(m == 0, F.concat(h, F.lit("h"))).otherwise(F.concat(h, F.lit("h"), F.lpad(m.cast("string"), 2, "0")))


def term_name(code: Column) -> Column:
    """Season by the last digit, year 1900 plus the first three."""
    season = F.element_at(F.create_map(*[F.lit(x) for x in ("2", "Spring", "4", "Summer", "8", "Autumn")]), F.substring(code, -1, 1))
    return F.concat_ws(" ", season, (F.substring(code, 1, 3).try_cast("int") + 1900).cast("string"))


def unpad(key: Column) -> Column:
    """Without leading zeros; all zeros are one."""
    return F.regexp_replace(F.trim(key), r"^0+(?=.)", "")


def pad3(key: Column) -> Column:
    return F.when(F.length(key) < 3, F.lpad(key, 3, "0")).otherwise(key)


def norm_key(key: Column) -> Column:
    """Upper-case letters and digits, numbers without leading zeros."""
    return F.regexp_replace(F.regexp_replace(F.upper(key), "[^A-Z0-9]", ""), r"(^|[A-Z])0+(?=[0-9])", "$1")


def html_text(html: Column) -> Column:
    """Line breaks to spaces, tags out, then entities decoded, white space squashed."""
    out = F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", " "), r"<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\n\r]+", " "))


def tri_flag(text: Column) -> Column:
    """Yes, true and 1 are true, no, false and 0 false, anything else is unknown."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("yes", "true", "1"), True).when(t.isin("no", "false", "0"), False)


def short_name(name: Column) -> Column:
    """What follows the first " - ", of a name longer than 24."""
    at = F.instr(name, " - ")
    return F.when((F.length(name) > 24) & (at > 0), F.substring(name, at + 3, F.length(name))).otherwise(name)


def grid_xy(lon: Column, lat: Column, west: float, south: float, east: float, north: float, size: int) -> Column:
    """Whole cell numbers of a point in a bounding box's grid."""
    return F.struct(F.floor((lon - west) / (east - west) * size).cast("long").alias("gx"), F.floor((north - lat) / (north - south) * size).cast("long").alias("gy"))


def in_bounds(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    return lon.between(west, east) & lat.between(south, north)


def booking_kind(text: Column) -> Column:
    second = F.regexp_extract(text, r"^\S+\s+(\S+)", 1)
    return F.when(second.rlike("^[0-9]{9}$"), "event").when(text.rlike(r"ROOM\b.*\bBLOCK"), "block").otherwise("class")


def overlaps(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Half-open intervals that share a minute."""
    return (a1 < b2) & (a2 > b1)


def tier_of(known: Column, wait: Column, meets: Column, listed: Column) -> Column:
    base = F.when(known & (wait == 0), F.when(meets, 0).otherwise(2)).when(known, 4).otherwise(F.when(meets, 6).otherwise(8))
    return base + F.when(listed.eqNullSafe(F.lit(False)), 1).otherwise(0)


def score_of(walk: Column, usable: Column, need: Column) -> Column:
    """Smaller is better: minutes to walk, less a little for time to spare, more for time that lacks."""
    surplus = usable - need
    return (
        F.when(usable.isNull(), walk.cast("double"))
        .when((need > 0) & (surplus >= 0), walk - 0.001 * F.least(surplus, F.lit(60)))
        .otherwise(walk - 0.1 * F.least(surplus, F.lit(60)))
    )
