"""Query name -> callable(spark, sf_dir), and query name -> DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import scalars as S
from lacuna.operators import decide, graph, guards, intervals, places, rank, reconcile, schedule
from lacuna.plans import fixtures as X
from lacuna.plans.fixtures import ctes
from lacuna.sources import readers
from lacuna.streaming import fixes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def windows(spark, sf) -> DataFrame:
    """The window 8:00 to 22:00 of every resource and day that has events."""
    return X.busy(spark, sf).select("resource_id", "date").distinct().withColumn("open", F.lit(480)).withColumn("close", F.lit(1320))


KEYS = ["resource_id", "date"]
ISLANDS = """
 r AS (SELECT *, max("end") OVER (PARTITION BY resource_id, date ORDER BY start, "end", label NULLS FIRST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}),
 m AS (SELECT *, CASE WHEN reach IS NULL OR start {op} reach THEN 1 ELSE 0 END AS fresh FROM r),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY resource_id, date ORDER BY start, "end", label NULLS FIRST, event_id ROWS UNBOUNDED PRECEDING) AS island,
   CASE WHEN fresh = 0 AND "end" <= reach THEN 1 ELSE 0 END AS inside FROM m),
 merged AS (SELECT resource_id, date, min(start) AS start, max("end") AS "end", CASE WHEN min(label) = max(label) THEN min(label) END AS label, count(*) AS rows, sum(inside)::BIGINT AS dropped FROM i GROUP BY resource_id, date, island)
"""
FIXED = """fixed AS (SELECT * REPLACE (CASE WHEN "end" <= start THEN 1440 ELSE "end" END AS "end"), "end" <= start AS malformed FROM busy)"""
CLIPPED = """clipped AS (SELECT * REPLACE (greatest(start, 480) AS start, least("end", 1320) AS "end") FROM fixed WHERE least("end", 1320) > greatest(start, 480))"""
GAPS = (
    ctes("busy") + ", " + FIXED + ", " + CLIPPED + """, u AS (SELECT resource_id, date, start, "end" FROM clipped UNION ALL SELECT DISTINCT resource_id, date, 1320, 1320 FROM busy),
 g AS (SELECT *, coalesce(max("end") OVER (PARTITION BY resource_id, date ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 480) AS gap_start FROM u),
 gaps AS (SELECT resource_id, date, gap_start, start AS gap_end FROM g WHERE start > gap_start)"""
)


# -- intervals ---------------------------------------------------------------------------------


@query("w1_free_gaps", GAPS + " SELECT * FROM gaps")
def _(spark, sf):
    return intervals.free_gaps(X.busy(spark, sf), windows(spark, sf), KEYS)


@query("a1_merge_intervals", ctes("busy") + "," + ISLANDS.format(src="busy", op=">") + "SELECT * FROM merged")
def _(spark, sf):
    return intervals.merge_intervals(X.busy(spark, sf), KEYS)


@query("w11_merge_blocks_strict", ctes("busy") + "," + ISLANDS.format(src="busy", op=">=") + "SELECT * FROM merged")
def _(spark, sf):
    return intervals.merge_intervals(X.busy(spark, sf), KEYS, strict=True)


@query("p7_repair_intervals", ctes("busy") + ", " + FIXED + ' SELECT event_id, start, "end", malformed FROM fixed')
def _(spark, sf):
    return intervals.repair_intervals(X.busy(spark, sf)).select("event_id", "start", "end", "malformed")


@query("p6_clip_intervals", ctes("busy") + ', fixed AS (SELECT * FROM busy), ' + CLIPPED + ' SELECT event_id, start, "end" FROM clipped')
def _(spark, sf):
    rows = X.busy(spark, sf).withColumn("open", F.lit(480)).withColumn("close", F.lit(1320))
    return intervals.clip_intervals(rows).select("event_id", "start", "end")


@query("a3_union_minutes", ctes("busy") + ', fixed AS (SELECT * FROM busy), ' + CLIPPED + "," + ISLANDS.format(src="clipped", op=">") + 'SELECT resource_id, date, sum("end" - start)::BIGINT AS minutes FROM merged GROUP BY ALL')
def _(spark, sf):
    return intervals.union_minutes(X.busy(spark, sf), KEYS, 480, 1320)


@query(
    "j10_interval_overlap_join",
    ctes("busy") + 'SELECT a.resource_id, a.date, a.event_id AS a_event_id, b.event_id AS b_event_id FROM busy a JOIN busy b ON a.resource_id = b.resource_id AND a.date = b.date AND a.start < b."end" AND a."end" > b.start AND a.event_id < b.event_id',
)
def _(spark, sf):
    rows = X.busy(spark, sf).select(*KEYS, "event_id", "start", "end")
    return intervals.overlap_join(rows, rows, KEYS).where("a_event_id < b_event_id").select(*KEYS, "a_event_id", "b_event_id")


@query(
    "j11_lands_in_free_time",
    ctes("busy") + """SELECT label, count(*) AS rows FROM busy r WHERE label = 'click' AND NOT EXISTS (SELECT 1 FROM busy b WHERE b.label <> 'click' AND b.resource_id = r.resource_id AND b.date = r.date AND r.start < b."end" AND r."end" > b.start) GROUP BY label""",
)
def _(spark, sf):
    rows = X.busy(spark, sf)
    return intervals.in_free_time(rows.where("label = 'click'"), rows.where("label <> 'click'"), KEYS).groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "w6_contiguous_days",
    ctes("busy") + """, d AS (SELECT DISTINCT resource_id, date FROM busy), n AS (SELECT *, date - (row_number() OVER (PARTITION BY resource_id ORDER BY date))::INT AS run FROM d)
 SELECT resource_id, min(date) AS first, max(date) AS last, count(*) AS days FROM n GROUP BY resource_id, run""",
)
def _(spark, sf):
    return intervals.contiguous_days(X.busy(spark, sf), ["resource_id"])


@query("w10_dedupe_keep", ctes("busy") + "SELECT resource_id, date, max(event_id) AS event_id FROM busy GROUP BY ALL")
def _(spark, sf):
    return intervals.dedupe_keep(X.busy(spark, sf), KEYS, ["event_id"], last=True).select(*KEYS, "event_id")


@query("w12_distinct_day_entries", ctes("busy") + 'SELECT DISTINCT resource_id, date, start, "end", label FROM busy')
def _(spark, sf):
    return X.busy(spark, sf).select(*KEYS, "start", "end", "label").distinct()


@query(
    "w9_day_timeline",
    GAPS + "," + ISLANDS.format(src="clipped", op=">=") + """, t AS (SELECT resource_id, date, gap_start AS start, gap_end AS "end", CASE WHEN gap_end - gap_start < 20 THEN 'seam' ELSE 'free' END AS kind FROM gaps
 UNION ALL SELECT resource_id, date, start, "end", 'busy' FROM merged) SELECT *, row_number() OVER (PARTITION BY resource_id, date ORDER BY start, "end") AS place FROM t""",
)
def _(spark, sf):
    return intervals.day_timeline(X.busy(spark, sf), windows(spark, sf), KEYS)


@query(
    "w8_slot_chain",
    ctes("busy") + """, s AS (SELECT resource_id, date, (start // 30) * 30 AS start, (start // 30) * 30 + 30 AS "end", bool_or(label = 'purchase') AS taken FROM busy GROUP BY 1, 2, 3, 4),
 f AS (SELECT *, CASE WHEN lag("end") OVER (PARTITION BY resource_id, date ORDER BY start) = start THEN 0 ELSE 1 END AS fresh FROM s WHERE NOT taken AND start >= 480),
 n AS (SELECT *, sum(fresh) OVER (PARTITION BY resource_id, date ORDER BY start) AS run FROM f),
 p AS (SELECT resource_id, date, min(start) AS start, least(max("end"), min(start) + 240) AS "end" FROM n GROUP BY resource_id, date, run)
 SELECT resource_id, date, min(start) AS start, arg_min("end", start) AS "end" FROM p WHERE "end" - start >= 60 GROUP BY ALL""",
)
def _(spark, sf):
    begin = (F.floor(F.col("start") / 30) * 30).cast("int")
    slots = X.busy(spark, sf).groupBy(*KEYS, begin.alias("start"), (begin + 30).alias("end")).agg(F.bool_or(F.col("label") == "purchase").alias("taken"))
    return intervals.slot_chain(slots, KEYS, 480, 60)


# -- schedule ----------------------------------------------------------------------------------

STAGED = ctes("busy", "resources") + """, rows AS (SELECT b.event_id, CASE WHEN b.event_id % 11 <> 0 THEN CASE WHEN b.event_id % 13 = 0 THEN 'ONLINE' ELSE b.resource_id::VARCHAR END END AS resource_id,
 CASE WHEN b.event_id % 17 = 0 THEN 99 ELSE r.place_id END AS place_id, CASE WHEN b.event_id % 19 <> 0 THEN b.day END AS day, b.start, CASE WHEN b.event_id % 23 = 0 THEN b.start ELSE b."end" END AS "end"
 FROM busy b JOIN resources r USING (resource_id)),
 staged AS (SELECT *, CASE WHEN resource_id IS NULL THEN 'blankId' WHEN resource_id = 'ONLINE' THEN 'pseudo' WHEN place_id NOT IN (SELECT n_nationkey FROM nation) THEN 'unknownPlace' WHEN day IS NULL THEN 'noWeekday' WHEN "end" <= start THEN 'badTime' ELSE 'usable' END AS stage FROM rows)"""


def staged(spark, sf) -> DataFrame:
    e = F.col("event_id")
    rows = X.busy(spark, sf).join(X.resources(spark, sf).select("resource_id", "place_id"), "resource_id").select(
        "event_id", F.when(e % 11 != 0, F.when(e % 13 == 0, "ONLINE").otherwise(F.col("resource_id").cast("string"))).alias("resource_id"),
        F.when(e % 17 == 0, 99).otherwise(F.col("place_id")).cast("string").alias("place_id"), F.when(e % 19 != 0, F.col("day")).alias("day"), "start", F.when(e % 23 == 0, F.col("start")).otherwise(F.col("end")).alias("end"),
    )
    places = X.places(spark, sf).select(F.col("place_id").cast("string").alias("place_id"))
    return schedule.funnel_stage(rows, ["ONLINE", "OFFCAMPUS"], places)


@query("p1_funnel_stage", STAGED + " SELECT event_id, stage FROM staged")
def _(spark, sf):
    return staged(spark, sf).select("event_id", "stage")


@query("a2_funnel_counts", STAGED + ' SELECT stage, count(*) AS rows, count(*) FILTER (WHERE "end" > start) AS timed, count(*) / sum(count(*)) OVER () AS share FROM staged GROUP BY stage')
def _(spark, sf):
    return schedule.funnel_counts(staged(spark, sf))


@query("p3_is_unplaceable", STAGED + " SELECT event_id FROM staged WHERE stage = 'noWeekday' AND \"end\" > start")
def _(spark, sf):
    return staged(spark, sf).where("stage = 'noWeekday' and end > start").select("event_id")


@query("f4_expand_weekdays", "SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN l_quantity > 25 THEN 0 END, CASE WHEN l_discount > 0.05 THEN 1 END, CASE WHEN l_returnflag = 'R' THEN 2 END], lambda x: x IS NOT NULL)) AS day FROM lineitem")
def _(spark, sf):
    rows = X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 25).alias("a"), (F.col("l_discount") > 0.05).alias("b"), (F.col("l_returnflag") == "R").alias("c"))
    return schedule.expand_weekdays(rows, ["a", "b", "c"])


@query("j6_active_session_join", ctes("busy", "sessions") + "SELECT event_id, session_id FROM busy JOIN sessions USING (session_id) WHERE date BETWEEN first AND last")
def _(spark, sf):
    return schedule.active_sessions(X.busy(spark, sf), X.sessions(spark, sf), F.col("date")).select("event_id", "session_id")


@query("a5_schedule_coverage", ctes("busy", "sessions") + """, d AS (SELECT DISTINCT date FROM busy) SELECT d.date, count(*) FILTER (WHERE d.date BETWEEN first AND last) AS live, count(*) AS total,
 count(*) FILTER (WHERE d.date BETWEEN first AND last) / count(*) AS share FROM d, busy JOIN sessions USING (session_id) GROUP BY d.date""")
def _(spark, sf):
    rows = X.busy(spark, sf)
    return schedule.schedule_coverage(rows, X.sessions(spark, sf), rows.select("date").distinct())


@query("a7_busy_day_profile", ctes("busy") + """, r AS (SELECT * FROM busy WHERE "end" > start), s AS (SELECT list_sort(list(start)) AS a, list_sort(list("end")) AS b, count(*) AS n FROM r)
 SELECT day, count(*) AS rows, count(*) / n AS share, a[least(n - 1, floor(n * 0.005))::INT + 1] AS start_q, b[least(n - 1, floor(n * 0.995))::INT + 1] AS end_q, count(*) / n >= 0.01 AS on FROM r, s GROUP BY day, n, a, b""")
def _(spark, sf):
    return schedule.busy_day_profile(X.busy(spark, sf))


@query("a4_index_measure", ctes("busy") + ", m AS (SELECT count(DISTINCT resource_id) AS resources, count(*) AS blocks, sum(greatest(\"end\" - start, 0))::BIGINT AS minutes, " + ", ".join(f'sum(CASE WHEN day = {d} THEN greatest("end" - start, 0) ELSE 0 END)::BIGINT AS minutes_{d}' for d in range(7)) + ' FROM busy) SELECT *, least(minutes_1, minutes_2, minutes_3, minutes_4, minutes_5) / greatest(minutes_1, minutes_2, minutes_3, minutes_4, minutes_5) AS balance FROM m')
def _(spark, sf):
    return schedule.index_measure(X.busy(spark, sf))


@query("a8_resources_per_place", ctes("resources") + "SELECT place_id, count(*) AS n FROM resources GROUP BY place_id")
def _(spark, sf):
    return X.resources(spark, sf).groupBy("place_id").agg(F.count(F.lit(1)).alias("n"))


LAST = ctes("busy", "resources", "hours") + ', l AS (SELECT place_id, day, max("end") AS last_end FROM busy JOIN resources USING (resource_id) GROUP BY ALL)'


@query("a10_last_end_by_place_day", LAST + " SELECT * FROM l")
def _(spark, sf):
    return schedule.last_end_by_place_day(X.busy(spark, sf), X.resources(spark, sf))


@query("a11_overrun_check", LAST + " SELECT place_id, day, last_end, close, CASE WHEN open IS NULL THEN 'closed' ELSE 'after-close' END AS why FROM l JOIN hours USING (place_id, day) WHERE open IS NULL OR last_end > close")
def _(spark, sf):
    return schedule.overrun_check(schedule.last_end_by_place_day(X.busy(spark, sf), X.resources(spark, sf)), X.hours(spark, sf))


@query("a14_distinct_sessions", "SELECT first, last, row_number() OVER (ORDER BY first, last) - 1 AS session_id FROM (SELECT DISTINCT o_orderdate::DATE AS first, o_orderdate::DATE + 30 AS last FROM orders WHERE o_orderkey % 3 <> 0 UNION SELECT DISTINCT DATE '1995-01-01', DATE '1995-06-01' FROM orders WHERE o_orderkey % 3 = 0)")
def _(spark, sf):
    day = F.to_date("o_orderdate")
    rows = X.table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 3 != 0, day).alias("first"), F.when(F.col("o_orderkey") % 3 != 0, F.date_add(day, 30)).alias("last"), F.expr("date'1995-01-01'").alias("parent_first"), F.expr("date'1995-06-01'").alias("parent_last")
    )
    return schedule.distinct_sessions(rows)


@query("j7_label_dictionary", ctes("busy") + "SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT label FROM busy)")
def _(spark, sf):
    return schedule.label_dictionary(X.busy(spark, sf), "label")


@query("a15_prune_sessions", ctes("busy", "sessions") + "SELECT *, row_number() OVER (ORDER BY session_id) - 1 AS new_id FROM sessions WHERE session_id IN (SELECT session_id FROM busy WHERE label <> 'view')")
def _(spark, sf):
    return schedule.prune_sessions(X.sessions(spark, sf), X.busy(spark, sf).where("label <> 'view'"))


HALVES = """, ids AS (SELECT DISTINCT resource_id, resource_id::VARCHAR AS id FROM busy), h AS (SELECT p.resource_id AS parent, c.resource_id AS child FROM ids p JOIN ids c ON c.id <> p.id AND starts_with(c.id, p.id) WHERE p.resource_id % 3 = 1),
 w AS (SELECT parent AS a, child AS b FROM h UNION SELECT child, parent FROM h),
 src AS (SELECT resource_id, day AS date, start, "end", label, event_id FROM busy UNION ALL SELECT b, day, start, "end", label, event_id FROM busy JOIN w ON a = resource_id),"""


@query("j9_propagate_groups", ctes("busy") + HALVES + ISLANDS.format(src="src", op=">") + """ SELECT resource_id, date AS day, start, "end", label FROM merged""")
def _(spark, sf):
    """Halves as j8 finds them by prefix, propagated twice: the second run must change nothing."""
    rows = X.busy(spark, sf)
    ids = rows.select(F.lit("p").alias("place"), F.col("resource_id").cast("string").alias("id"), (F.col("resource_id") % 3 == 1).alias("group")).distinct()
    halves = places.group_halves(ids).select(F.col("parent").cast("long").alias("parent"), F.col("child").cast("long").alias("child"))
    once = schedule.propagate_groups(rows, halves)
    return schedule.propagate_groups(once, halves).where("not own").drop("own")


@query("j15_overlay_for_date", ctes("busy") + """SELECT resource_id, start, "end", label FROM busy WHERE day = 3 AND label <> 'purchase' UNION ALL
 SELECT resource_id, start, "end", CASE WHEN label = 'purchase' THEN 'May be booked' ELSE label END FROM busy WHERE date = DATE '2024-01-10' AND label = 'purchase'""")
def _(spark, sf):
    rows = X.busy(spark, sf)
    dated = rows.where("label = 'purchase'").withColumn("label", F.lit("hold"))
    return schedule.overlay_for_date(rows.where("label <> 'purchase'"), dated, F.expr("date'2024-01-10'"))


@query("p8_feed_row_validity", ctes("busy") + """SELECT event_id, CASE WHEN resource_id % 7 = 0 THEN 'unknown-room' WHEN NOT (start < "end") THEN 'invalid-block' WHEN label = 'view' THEN 'invalid-kind' WHEN label = 'click' AND (event_id % 5 = 0 OR event_id % 6 = 0) THEN 'invalid-event' END AS reason FROM busy""")
def _(spark, sf):
    rows = X.busy(spark, sf)
    feed = rows.select("event_id", "resource_id", "day", "start", "end", F.when(F.col("event_id") % 6 == 0, F.col("event_id").cast("string")).otherwise(F.lpad(F.col("event_id").cast("string"), 9, "1")).alias("source_id"), F.when(F.col("label") == "view", "other").when(F.col("label") == "click", "event").otherwise("block").alias("kind"), F.when(F.col("event_id") % 5 != 0, "MTG").alias("code"))
    return schedule.feed_row_validity(feed, rows.where("resource_id % 7 <> 0"), ["MTG", "TOUR", "INFO"]).select("event_id", "reason")


@query("x2_dedupe_feed", ctes("busy") + 'SELECT resource_id, date, start, "end", label, min(event_id) AS event_id FROM busy GROUP BY ALL')
def _(spark, sf):
    return schedule.dedupe_feed(X.busy(spark, sf)).select(*KEYS, "start", "end", "label", "event_id")


@query("a12_feed_counts", ctes("busy") + "SELECT label, count(*) AS rows, count(DISTINCT resource_id) AS resources, count(DISTINCT event_id) AS ids FROM busy GROUP BY label")
def _(spark, sf):
    return schedule.feed_counts(X.busy(spark, sf))


@query("j14_asof_snapshot", """WITH w AS (SELECT DISTINCT date_trunc('week', o_orderdate)::DATE AS week_start FROM orders WHERE o_orderkey % 4 = 0), q AS (SELECT o_orderkey, o_orderdate::DATE AS date FROM orders)
 SELECT o_orderkey, date, coalesce(week_start, (SELECT min(week_start) FROM w)) AS snapshot, CASE WHEN week_start IS NULL THEN 'outside-snapshot' ELSE 'inside' END AS coverage FROM q LEFT JOIN w ON date BETWEEN week_start AND week_start + 6""")
def _(spark, sf):
    orders = X.table(spark, sf, "orders")
    week = F.to_date(F.date_trunc("week", "o_orderdate"))
    weeks = orders.where("o_orderkey % 4 = 0").select(week.alias("week_start")).distinct()
    out = schedule.asof_snapshot(orders.select("o_orderkey", F.to_date("o_orderdate").alias("date")), weeks)
    return out.select("o_orderkey", "date", "snapshot", "coverage")


# -- geography ---------------------------------------------------------------------------------

METRES = "6371008.8 * sqrt(pow(radians({b}.lon - {a}.lon) * cos(radians(({a}.lat + {b}.lat) / 2)), 2) + pow(radians({b}.lat - {a}.lat), 2))"


@query("f11_planar_m", ctes("places", "asks") + f"SELECT ask_id, place_id, round({METRES.format(a='asks', b='places')}, 3) AS metres, ceil({METRES.format(a='asks', b='places')} * 1.3 / 78.0)::INT AS walk FROM asks, places WHERE {METRES.format(a='asks', b='places')} <= 600")
def _(spark, sf):
    return rank.ask_places(X.asks(spark, sf), X.places(spark, sf), 600.0).select("ask_id", "place_id", F.round("metres", 3).alias("metres"), "walk")


@query("f10_haversine_m", ctes("places", "asks") + """SELECT ask_id, place_id, round(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(p.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - a.lon) / 2), 2)))), 3) AS metres
 FROM asks a JOIN places p ON p.place_id = a.ask_id % 25""")
def _(spark, sf):
    a = X.asks(spark, sf).select("ask_id", F.col("lat").alias("y"), F.col("lon").alias("x"))
    p = X.places(spark, sf)
    return a.join(p, p.place_id == F.col("ask_id") % 25).select("ask_id", "place_id", F.round(S.haversine_m(F.col("y"), F.col("x"), F.col("lat"), F.col("lon")), 3).alias("metres"))


@query("f12_bearing_deg", ctes("places", "asks") + """, t AS (SELECT ask_id, degrees(atan2(sin(radians(p.lon - a.lon)) * cos(radians(p.lat)), cos(radians(a.lat)) * sin(radians(p.lat)) - sin(radians(a.lat)) * cos(radians(p.lat)) * cos(radians(p.lon - a.lon)))) AS d FROM asks a JOIN places p ON p.place_id = a.ask_id % 25)
 SELECT ask_id, round(CASE WHEN d < 0 THEN d + 360 ELSE d END, 6) AS bearing FROM t""")
def _(spark, sf):
    a = X.asks(spark, sf).select("ask_id", F.col("lat").alias("y"), F.col("lon").alias("x"))
    p = X.places(spark, sf)
    return a.join(p, p.place_id == F.col("ask_id") % 25).select("ask_id", F.round(S.bearing_deg(F.col("y"), F.col("x"), F.col("lat"), F.col("lon")), 6).alias("bearing"))


@query("p11_in_bounds", ctes("places") + "SELECT place_id, lon BETWEEN -83.018 AND -83.01 AND lat BETWEEN 39.991 AND 39.998 AS inside FROM places")
def _(spark, sf):
    return X.places(spark, sf).select("place_id", S.in_bounds(F.col("lon"), F.col("lat"), -83.018, 39.991, -83.01, 39.998).alias("inside"))


@query("f28_grid_xy", ctes("places") + "SELECT place_id, floor((lon + 83.03) / (-83.0 + 83.03) * 512)::BIGINT AS gx, floor((40.01 - lat) / (40.01 - 39.98) * 512)::BIGINT AS gy FROM places")
def _(spark, sf):
    return X.places(spark, sf).select("place_id", S.grid_xy(F.col("lon"), F.col("lat"), -83.03, 39.98, -83.0, 40.01, 512).alias("g")).select("place_id", "g.gx", "g.gy")


# -- answers -----------------------------------------------------------------------------------

RADIUS = 600.0
TYPES = {"BUILDING": 0, "MACHINERY": 1, "FURNITURE": 2}
ANSWERS = GAPS.replace(ctes("busy"), ctes("busy", "places", "asks", "resources", "hours")) + f""",
 near AS (SELECT a.*, p.place_id, ceil({METRES.format(a='a', b='p')} * 1.3 / 78.0)::INT AS walk FROM asks a, places p WHERE {METRES.format(a='a', b='p')} <= {RADIUS}),
 cand AS (SELECT n.ask_id, n.now, n.need, n.walk, n.place_id, r.resource_id, r.type, r.seats, h.day IS NOT NULL AS known, g.gap_start, g.gap_end, g.gap_end - 10 - greatest(n.now + n.walk, g.gap_start) AS usable
   FROM near n JOIN resources r USING (place_id) JOIN gaps g ON g.resource_id = r.resource_id AND g.date = n.date LEFT JOIN hours h ON h.place_id = n.place_id AND h.day = n.day WHERE h.day IS NULL OR h.open IS NOT NULL),
 ok AS (SELECT *, usable >= greatest(need, 1) AS meets FROM cand WHERE gap_end > now AND usable > 0 AND gap_start <= now + 1440),
 k AS (SELECT *, CASE WHEN meets AND gap_start <= now + walk THEN 0 WHEN meets THEN 1 ELSE 2 END AS klass FROM ok),
 one AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY ask_id, resource_id ORDER BY klass, CASE WHEN klass = 2 THEN -usable ELSE 0 END, gap_start) = 1),
 answers AS (SELECT ask_id, resource_id, place_id, type, seats, known, type = 'BUILDING' AS listed, gap_start, gap_end, usable, meets, walk, need, greatest(gap_start - (now + walk), 0) AS wait FROM one),
 scored AS (SELECT *, CASE WHEN known AND wait = 0 THEN CASE WHEN meets THEN 0 ELSE 2 END WHEN known THEN 4 WHEN meets THEN 6 ELSE 8 END + CASE WHEN listed THEN 0 ELSE 1 END AS tier,
   CASE WHEN usable >= need THEN walk - 0.001::DOUBLE * least(usable - need, 60) ELSE walk - 0.1::DOUBLE * least(usable - need, 60) END AS score FROM answers),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY tier, score, usable DESC, CASE type WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 WHEN 'FURNITURE' THEN 2 ELSE 3 END, seats, resource_id) AS place FROM scored)"""


def candidates(spark, sf, asks: DataFrame) -> DataFrame:
    """Resources near a question with their gaps of the day. Gaps are made for the days asked about alone, and meet questions
    by place and day, a resource's of a day in one row."""
    near = rank.ask_places(asks, X.places(spark, sf), RADIUS)
    near = rank.hours_tristate_join(near, X.hours(spark, sf)).where("state <> 'closed'")
    dates = asks.select("date").distinct()
    busy = X.busy(spark, sf).join(dates, "date", "left_semi")
    spans = busy.select("resource_id", "date").distinct().withColumn("open", F.lit(480)).withColumn("close", F.lit(1320))
    gaps = rank.gaps_by_day(intervals.free_gaps(busy, spans, KEYS), KEYS)
    near = near.drop("day", "lat", "lon", "metres", "open", "close")
    days = rank.dealt(X.resources(spark, sf).join(gaps, "resource_id"), "place_id", "date")  # each meets all questions near it
    cand = days.join(near, ["place_id", "date"])
    return cand.withColumn("known", F.col("state") == "open").withColumn("listed", F.col("type") == "BUILDING").drop("state")


def answered(spark, sf, found, soon: bool = False, many: bool = False) -> DataFrame:
    """``found`` (a function of the gap that each resource near a question offers; a row or more a question, with ask_id)
    for all questions. Those that ask the same are answered once. ``many``: a row for each resource stays."""
    once, same = rank.asked_once(X.asks(spark, sf))
    picked = rank.pick_gap_in_row(candidates(spark, sf, once), soon=soon).drop("now", "date")
    return rank.each_for_all(found(rank.dealt(picked, "ask_id")), same) if many else rank.for_all(found(picked), same)


@query("w2_pick_gap", ANSWERS + " SELECT ask_id, resource_id, gap_start, gap_end, usable, meets, walk, wait FROM answers")
def _(spark, sf):
    return answered(spark, sf, lambda a: a.select("ask_id", "resource_id", "gap_start", "gap_end", "usable", "meets", "walk", "wait"), many=True)


@query("w3_rank", ANSWERS + " SELECT ask_id, resource_id, tier, place FROM ranked")
def _(spark, sf):
    return answered(spark, sf, lambda a: rank.rank(a, TYPES).select("ask_id", "resource_id", "tier", "place"), many=True)


@query("a9_tally", ANSWERS + " SELECT ask_id, count(*) FILTER (WHERE meets AND wait = 0) AS meets, count(*) FILTER (WHERE NOT meets) AS shorter, count(*) FILTER (WHERE wait > 0) AS waiting, count(*) FILTER (WHERE known AND wait = 0) AS free, count(*) AS total FROM answers GROUP BY ask_id")
def _(spark, sf):
    return answered(spark, sf, rank.tally)


@query("w4_shape", ANSWERS + """, d AS (SELECT *, row_number() OVER (PARTITION BY ask_id, place_id ORDER BY place) - 1 AS depth FROM ranked WHERE walk <= 6),
 p AS (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY depth, place) AS position, count(*) OVER (PARTITION BY ask_id) AS n, count(*) FILTER (WHERE depth = 0) OVER (PARTITION BY ask_id) AS n0 FROM d),
 s AS (SELECT * FROM p WHERE position <= greatest(least(40, n0), least(10, n))) SELECT ask_id, resource_id, depth, row_number() OVER (PARTITION BY ask_id ORDER BY place) AS shown FROM s""")
def _(spark, sf):
    return answered(spark, sf, lambda a: rank.shape(a, TYPES, max_walk=6).select("ask_id", "resource_id", "depth", "shown"))


@query("w5_beyond_summary", ANSWERS + " SELECT ask_id, count(*) FILTER (WHERE known AND wait = 0) AS free, count(DISTINCT place_id) FILTER (WHERE known AND wait = 0) AS free_places, min(walk) FILTER (WHERE known AND wait = 0) AS free_walk, count(*) FILTER (WHERE NOT (known AND wait = 0)) AS waiting, min(walk) FILTER (WHERE NOT (known AND wait = 0)) AS waiting_walk FROM ranked WHERE walk > 6 GROUP BY ask_id")
def _(spark, sf):
    return answered(spark, sf, lambda a: rank.beyond_summary(a, max_walk=6))


OFFERABLE = ("BUILDING", "MACHINERY", "FURNITURE", "HOUSEHOLD")
PREFERRED = ("BUILDING", "MACHINERY")


def _ladder_sql() -> str:
    """Every rung of every question: the gap of each candidate by the rules of w2, what the rung asks of it, and counts."""
    relax = ", ".join(f"({2 + i}, 'shorter:{n}', {n}, 1, 20, false, 'here')" for i, n in enumerate(rank.RELAX))
    last = 2 + len(rank.RELAX)
    rungs = f"(VALUES (0, 'asked', NULL, 0, 0, false, 'here'), (1, 'any-type', NULL, 1, 0, false, 'here'), {relax}, ({last}, 'opens-at', NULL, 1, 20, true, 'here'), ({last + 1}, 'further', NULL, 1, 0, false, 'twice'), ({last + 2}, 'anywhere', NULL, 1, 0, true, 'any'), ({last + 3}, 'longest', 0, 1, 20, true, 'any')) r(ordinal, rung, fixed, wide, floor, waits, reach)"
    offer, prefer = (", ".join(f"'{t}'" for t in x) for x in (OFFERABLE, PREFERRED))
    return ANSWERS + f""", radii AS (SELECT ask_id, (3 + ask_id % 4)::INT AS radius FROM asks),
 g0 AS (SELECT c.ask_id, c.resource_id, c.type, c.seats, c.known, c.now, c.walk, c.need AS asked, gap_start, gap_end, usable, radius FROM cand c JOIN radii USING (ask_id) WHERE gap_end > now AND usable > 0),
 g1 AS (SELECT *, coalesce(fixed, asked) AS rn FROM g0, {rungs} WHERE (rung NOT LIKE 'shorter%' OR fixed < asked) AND (reach = 'any' OR walk <= radius * CASE reach WHEN 'twice' THEN 2 ELSE 1 END) AND type IN ({offer}) AND (wide = 1 OR type IN ({prefer}))),
 g2 AS (SELECT *, CASE WHEN usable >= greatest(rn, 1) AND gap_start <= now + walk THEN 0 WHEN usable >= greatest(rn, 1) THEN 1 ELSE 2 END AS k2 FROM g1),
 g3 AS (SELECT * FROM g2 WHERE rung <> 'opens-at' OR k2 < 2 QUALIFY row_number() OVER (PARTITION BY ask_id, resource_id, ordinal ORDER BY k2, CASE WHEN k2 = 2 THEN -usable ELSE 0 END, gap_start) = 1),
 h AS (SELECT *, greatest(gap_start - (now + walk), 0) AS w FROM g3 WHERE (waits OR gap_start <= now + walk) AND (NOT known OR usable >= floor) AND (rn = 0 OR NOT known OR k2 < 2)),
 n3 AS (SELECT ask_id, ordinal, count(*) AS total FROM h GROUP BY ALL), b AS (SELECT ask_id, coalesce(min(ordinal) FILTER (WHERE total >= 3), min(ordinal)) AS ordinal FROM n3 GROUP BY ask_id),
 t AS (SELECT h.*, CASE WHEN known AND w = 0 THEN CASE WHEN usable >= greatest(rn, 1) THEN 0 ELSE 2 END WHEN known THEN 4 WHEN usable >= greatest(rn, 1) THEN 6 ELSE 8 END + CASE WHEN type = 'BUILDING' THEN 0 ELSE 1 END AS tier2,
   CASE WHEN rn > 0 AND usable >= rn THEN walk - 0.001::DOUBLE * least(usable - rn, 60) ELSE walk - 0.1::DOUBLE * least(usable - rn, 60) END AS score2, total FROM h JOIN b USING (ask_id, ordinal) JOIN n3 USING (ask_id, ordinal)),
 o AS (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY tier2, score2, usable DESC, CASE type WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 WHEN 'FURNITURE' THEN 2 ELSE 3 END, seats, resource_id) AS place FROM t)
 SELECT ask_id, rung, rn AS rung_need, resource_id, gap_start, usable, place, total FROM o WHERE place <= CASE WHEN rung = 'longest' THEN 1 ELSE 40 END"""


@query("d3_fallback_ladder", _ladder_sql())
def _(spark, sf):
    once, same = rank.asked_once(X.asks(spark, sf).withColumn("radius", (3 + F.col("ask_id") % 4).cast("int")))
    best = rank.fallback_ladder(candidates(spark, sf, once), TYPES, PREFERRED, OFFERABLE)
    return rank.for_all(best.select("ask_id", "rung", "rung_need", "resource_id", "gap_start", "usable", "place", "total"), same)


@query("w2_pick_gap_soon", ANSWERS + " SELECT ask_id, resource_id, gap_start, gap_end, usable FROM (SELECT * FROM k WHERE klass < 2 QUALIFY row_number() OVER (PARTITION BY ask_id, resource_id ORDER BY klass, gap_start) = 1)")
def _(spark, sf):
    return answered(spark, sf, lambda a: a.select("ask_id", "resource_id", "gap_start", "gap_end", "usable"), soon=True, many=True)


@query("j5_hours_tristate_join", ctes("hours", "resources") + "SELECT resource_id, i::INT AS day, CASE WHEN h.day IS NULL THEN 'unknown' WHEN open IS NULL THEN 'closed' ELSE 'open' END AS state FROM resources r CROSS JOIN range(7) t(i) LEFT JOIN hours h ON h.place_id = r.place_id AND h.day = i")
def _(spark, sf):
    """The week of every resource."""
    week = X.resources(spark, sf).select("resource_id", "place_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("day"))
    return rank.hours_tristate_join(week, X.hours(spark, sf)).select("resource_id", "day", "state")


@query("t5_next_opening", ctes("hours", "asks") + """, n AS (SELECT ask_id, i AS ahead, open, count(*) AS places FROM asks a, range(7) t(i), hours h WHERE h.day = (a.day + i) % 7 AND open IS NOT NULL AND (i > 0 OR open > now) GROUP BY ALL)
 SELECT ask_id, ahead::INT AS ahead, open, places FROM n QUALIFY row_number() OVER (PARTITION BY ask_id ORDER BY ahead, open) = 1""")
def _(spark, sf):
    return rank.next_opening(X.asks(spark, sf), X.hours(spark, sf))


@query("t7_prefix_then_contains", "SELECT p_partkey, CASE WHEN lower(p_name) LIKE 're%' THEN 0 ELSE 1 END AS hit FROM part WHERE lower(p_name) LIKE '%re%'")
def _(spark, sf):
    return rank.prefix_then_contains(X.table(spark, sf, "part"), "p_name", "RE").select("p_partkey", "hit")


@query("a27_place_day_open_counts", ctes("hours") + "SELECT day, count(open) AS open, count(*) - count(open) AS closed FROM hours GROUP BY day")
def _(spark, sf):
    return X.hours(spark, sf).groupBy("day").agg(F.count("open").alias("open"), F.count_if(F.col("open").isNull()).alias("closed"))


# -- scalars over tables -----------------------------------------------------------------------


@query("f5_day_to_date", ctes("busy") + "SELECT event_id, date_trunc('week', date)::DATE + ((day + 6) % 7)::INT AS d, CASE WHEN day = 0 THEN date + 1 ELSE date - day + 1 END AS monday FROM busy")
def _(spark, sf):
    week = F.to_date(F.date_trunc("week", "date"))
    return X.busy(spark, sf).select("event_id", S.day_to_date(week, F.col("day")).alias("d"), S.week_monday(F.col("date")).alias("monday"))


CLOCK = ctes("busy") + """, c AS (SELECT event_id, start, (CASE WHEN (start // 60) % 12 = 0 THEN 12 ELSE (start // 60) % 12 END)::VARCHAR || ':' || lpad((start % 60)::VARCHAR, 2, '0') || CASE WHEN start < 720 THEN ' am' ELSE ' pm' END AS clock,
 CASE WHEN start < 60 THEN start::VARCHAR || ' min' WHEN start % 60 = 0 THEN (start // 60)::VARCHAR || 'h' ELSE (start // 60)::VARCHAR || 'h' || lpad((start % 60)::VARCHAR, 2, '0') END AS dur FROM busy)"""


@query("f19_fmt_clock", CLOCK + " SELECT event_id, clock, dur FROM c")
def _(spark, sf):
    return X.busy(spark, sf).select("event_id", S.fmt_clock(F.col("start")).alias("clock"), S.fmt_dur(F.col("start")).alias("dur"))


@query("f1_clock_to_minutes", CLOCK + " SELECT event_id, start AS minutes FROM c")
def _(spark, sf):
    return X.busy(spark, sf).select("event_id", S.clock_to_minutes(S.fmt_clock(F.col("start"))).alias("minutes"))


@query("f21_norm_key", "SELECT p_partkey, regexp_replace(trim(lpad(p_partkey::VARCHAR, 6, '0')), '^0+(.)', '\\1') AS unpadded, CASE WHEN length(p_partkey::VARCHAR) < 3 THEN lpad(p_partkey::VARCHAR, 3, '0') ELSE p_partkey::VARCHAR END AS padded FROM part")
def _(spark, sf):
    k = F.col("p_partkey").cast("string")
    return X.table(spark, sf, "part").select("p_partkey", S.unpad(F.lpad(k, 6, "0")).alias("unpadded"), S.pad3(k).alias("padded"))


@query("f24_tri_flag", "SELECT event_id, CASE WHEN event_type IN ('view') THEN NULL WHEN event_id % 2 = 0 THEN true ELSE false END AS flag FROM events")
def _(spark, sf):
    text = F.when(F.col("event_type") == "view", "maybe").when(F.col("event_id") % 2 == 0, " Yes").otherwise("0")
    return X.table(spark, sf, "events").select("event_id", S.tri_flag(text).alias("flag"))


@query("f20_term_name", "SELECT p_partkey, CASE p_partkey % 10 WHEN 2 THEN 'Spring ' WHEN 4 THEN 'Summer ' WHEN 8 THEN 'Autumn ' ELSE '' END || (1900 + (1000 + p_partkey % 9000) // 10)::VARCHAR AS name FROM part")
def _(spark, sf):
    return X.table(spark, sf, "part").select("p_partkey", S.term_name((1000 + F.col("p_partkey") % 9000).cast("string")).alias("name"))


# -- sources -----------------------------------------------------------------------------------

ENTITIES = "replace(replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&copy;', '©'), '&amp;', '&')"
TEXT = "trim(regexp_replace(" + ENTITIES.format("regexp_replace(regexp_replace({0}, '(?i)<br\\s*/?>', ' ', 'g'), '<[^>]*>', '', 'g')") + ", '[ \\t\\n\\r]+', ' ', 'g'), ' ')"


@query("f23_html_text", f"SELECT page_id, {TEXT.format('html')} AS text FROM pages")
def _(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", S.html_text(F.col("html")).alias("text"))


@query("s4_pages_to_list_items", f"WITH i AS (SELECT page_id, regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1) AS l FROM pages) SELECT page_id, (k - 1)::INT AS place, {TEXT.format('l[k]')} AS item FROM i, range(1, 1000) t(k) WHERE k <= len(l)")
def _(spark, sf):
    return readers.list_items(X.table(spark, sf, "pages"))


@query("s10_extract_links", "WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT *, regexp_extract(href, '([^/]*)/*$', 1) AS slug FROM l WHERE contains(href, '/')")
def _(spark, sf):
    return readers.extract_links(X.table(spark, sf, "pages"), "/")


@query("s11_extract_ids", "SELECT DISTINCT unnest(regexp_extract_all(html, 'track\\(([0-9]+)\\)', 1)) AS id FROM pages")
def _(spark, sf):
    return readers.extract_ids(X.table(spark, sf, "pages"), "html", r"track\(([0-9]+)\)")


@query("s9_launch_subset", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') OR c_custkey IN (1, 2, 3)")
def _(spark, sf):
    want = X.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    fixed = X.table(spark, sf, "customer").where("c_custkey in (1, 2, 3)").select("c_custkey")
    return X.table(spark, sf, "customer").join(want.union(fixed).distinct(), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("w13_split_blocks", """WITH b AS (SELECT doc_id, list_filter(string_split_regex(text, '\\n[ \\t]*(?:\\n[ \\t]*)+'), lambda x: trim(x, ' ') <> '') AS l FROM documents) SELECT doc_id, unnest(range(len(l)))::INT AS block, unnest(l) AS text FROM b""")
def _(spark, sf):
    return readers.split_blocks(X.table(spark, sf, "documents"), "doc_id", "text")


# -- joins and reconciliation ------------------------------------------------------------------


@query("j1_known_place_join", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def _(spark, sf):
    known = X.table(spark, sf, "nation").where("n_regionkey < 3")
    c = X.table(spark, sf, "customer")
    return c.join(known, c.c_nationkey == known.n_nationkey, "left_semi").select("c_custkey")


@query("j2_restricted_anti", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def _(spark, sf):
    denied = X.table(spark, sf, "nation").where("n_regionkey = 1")
    s = X.table(spark, sf, "supplier")
    return s.join(denied, s.s_nationkey == denied.n_nationkey, "left_anti").select("s_suppkey")


@query("j3_list_membership_flag", "SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS listed FROM part")
def _(spark, sf):
    listed = X.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("f", F.lit(True))
    return X.table(spark, sf, "part").join(listed, "p_partkey", "left").select("p_partkey", F.col("f").isNotNull().alias("listed"))


@query("j16_fallback_key_join", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN n.n_nationkey WHEN s_nationkey > 10 THEN s_nationkey END::VARCHAR AS matched, CASE WHEN s_suppkey % 2 = 0 THEN 'first' WHEN s_nationkey > 10 THEN 'second' END AS matched_by FROM supplier LEFT JOIN nation n ON n.n_nationkey = s_nationkey")
def _(spark, sf):
    s = X.table(spark, sf, "supplier")
    k = F.col("s_nationkey").cast("string")
    rows = s.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.lpad(k, 4, "0")).alias("a"), F.when(F.col("s_nationkey") > 10, k).alias("b"))
    dim = X.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("key"))
    return reconcile.fallback_key_join(rows, dim, "a", "b", "key").select("s_suppkey", "matched", "matched_by")


@query("j18_override_patch", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN CASE WHEN p_partkey % 20 = 0 THEN 1.0 END ELSE p_retailprice END AS price, p_partkey % 20 = 0 AS patched FROM part")
def _(spark, sf):
    p = X.table(spark, sf, "part")
    rows = p.select("p_partkey", F.when(F.col("p_partkey") % 10 != 0, F.col("p_retailprice")).alias("price"))
    over = p.where("p_partkey % 20 = 0").select("p_partkey", F.lit(1.0).alias("value"))
    return reconcile.override_patch(rows, over, ["p_partkey"], "price")


@query("j16_key_clashes", "SELECT unpadded, list_sort(list(DISTINCT key))::VARCHAR AS keys FROM (SELECT key, coalesce(nullif(ltrim(key, '0'), ''), '0') AS unpadded FROM (SELECT CASE WHEN s_suppkey % 3 = 0 THEN '0' ELSE '' END || (s_suppkey % 40) AS key FROM supplier)) GROUP BY 1 HAVING count(DISTINCT key) > 1")
def _(spark, sf):
    k = F.col("s_suppkey")
    dim = X.table(spark, sf, "supplier").select(F.concat(F.when(k % 3 == 0, "0").otherwise(""), (k % 40).cast("string")).alias("key"))
    return reconcile.key_clashes(dim, "key").select("unpadded", F.concat(F.lit("["), F.array_join("keys", ", "), F.lit("]")).alias("keys"))


@query("j18_override_report", "SELECT count(*) FILTER (WHERE p_partkey % 10 = 0 AND p_partkey % 20 = 0) AS patched, count(*) FILTER (WHERE p_partkey % 10 = 0 AND p_partkey % 20 <> 0) AS unresolved, count(*) FILTER (WHERE p_partkey % 20 = 5) AS unused, (SELECT count(*) FROM supplier WHERE s_suppkey % 4 = 0) AS without_cell, CASE WHEN count(*) FILTER (WHERE p_partkey % 20 = 10) > 0 THEN 'fatal' ELSE 'ok' END AS level FROM part")
def _(spark, sf):
    p = X.table(spark, sf, "part")
    rows = p.select("p_partkey", F.when(F.col("p_partkey") % 10 != 0, F.col("p_retailprice")).alias("price"))
    over = p.where("p_partkey % 20 in (0, 5)").select("p_partkey", F.lit(1.0).alias("value"))
    strange = X.table(spark, sf, "supplier").where("s_suppkey % 4 = 0").select((-1 - F.col("s_suppkey")).alias("p_partkey"), F.lit(1.0).alias("value"))
    return reconcile.override_report(rows, over.unionByName(strange), ["p_partkey"], "price")


@query("u7_source_counts", "SELECT count(*) FILTER (WHERE p_partkey % 6 NOT IN (0, 1)) AS read, count(*) FILTER (WHERE p_partkey % 6 IN (0, 1)) AS skipped, coalesce(sum(bit_count((p_size & 127)::INT)) FILTER (WHERE p_partkey % 6 NOT IN (0, 1)), 0)::BIGINT AS intervals FROM part")
def _(spark, sf):
    k = F.col("p_partkey") % 6
    bits = F.concat(*[(F.shiftright("p_size", i).bitwiseAND(F.lit(1))).cast("string") for i in range(7)])
    return reconcile.source_counts(X.table(spark, sf, "part").select(F.when(k != 0, bits).alias("pattern"), F.when(k == 1, "noon").otherwise("0800-0855").alias("time")))


@query("u1_harvest_union", "WITH p AS (SELECT event_id, event_id % 4 AS pass FROM events UNION ALL SELECT event_id, 3 FROM events WHERE event_id % 3 = 0), f AS (SELECT event_id, min(pass) AS pass FROM p GROUP BY 1), s AS (SELECT pass, count(DISTINCT event_id) AS saw FROM p GROUP BY 1), a AS (SELECT pass, count(*) AS added FROM f GROUP BY 1) SELECT pass, saw, coalesce(added, 0) AS added, (sum(coalesce(added, 0)) OVER (ORDER BY pass))::BIGINT AS union_after FROM s LEFT JOIN a USING (pass)")
def _(spark, sf):
    e = X.table(spark, sf, "events")
    rows = e.select("event_id", (F.col("event_id") % 4).alias("pass")).unionByName(e.where("event_id % 3 = 0").select("event_id", F.lit(3).cast("long").alias("pass")))
    return reconcile.harvest_union(rows, "event_id")


@query("u2_schedule_drift", ctes("busy") + """, a AS (SELECT DISTINCT day, resource_id FROM busy WHERE event_id % 2 = 0), b AS (SELECT DISTINCT day, resource_id FROM busy WHERE event_id % 2 = 1)
 SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def _(spark, sf):
    rows = X.busy(spark, sf)
    return reconcile.schedule_drift(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ["day", "resource_id"])


@query("u3_list_diff", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'left' WHEN p_partkey % 3 = 1 THEN 'appeared' ELSE 'kept' END AS change FROM part")
def _(spark, sf):
    p = X.table(spark, sf, "part")
    return reconcile.list_diff(p.where("p_partkey % 3 <> 1"), p.where("p_partkey % 3 <> 0"), "p_partkey")


@query("u4_never_saw", "SELECT p_partkey::VARCHAR AS key FROM part WHERE p_partkey % 4 = 3")
def _(spark, sf):
    p, k = X.table(spark, sf, "part"), F.col("p_partkey").cast("string")
    other = p.where("p_partkey % 4 <> 3").select(F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("00"), k)).otherwise(k).alias("key"))
    return reconcile.never_saw(p.select(k.alias("key")), other, "key")


@query("u5_keyset_equal", "SELECT count(*) FILTER (WHERE k % 3 = 0) AS only_a, count(*) FILTER (WHERE k % 3 = 1) AS only_b, count(*) FILTER (WHERE k % 3 = 2) AS both, false AS equal FROM (SELECT p_partkey AS k FROM part)")
def _(spark, sf):
    p = X.table(spark, sf, "part")
    return reconcile.keyset_equal(p.where("p_partkey % 3 <> 1"), p.where("p_partkey % 3 <> 0"), "p_partkey")


@query("u6_carried_forward", "WITH r AS (SELECT o_custkey, year(o_orderdate) AS y FROM orders), p AS (SELECT o_custkey, max(y) AS last_seen, count(DISTINCT y) AS periods FROM r GROUP BY 1) SELECT *, CASE WHEN periods >= 3 THEN 'strong' WHEN periods = 2 THEN 'medium' ELSE 'weak' END AS strength FROM p WHERE last_seen < (SELECT max(y) FROM r)")
def _(spark, sf):
    return reconcile.carried_forward(X.table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").cast("long").alias("y")), "o_custkey", "y")


@query("u7_source_intervals", "WITH r AS (SELECT p_partkey, p_size FROM part), d AS (SELECT p_partkey, p_size, i FROM r, range(7) t(i) WHERE (p_size >> i) & 1 = 1) SELECT p_partkey, ((i + 1) % 7)::INT AS day, 480 AS start, 535 AS \"end\" FROM d")
def _(spark, sf):
    bits = F.concat(*[(F.shiftright("p_size", i).bitwiseAND(F.lit(1))).cast("string") for i in range(7)])
    rows = X.table(spark, sf, "part").select("p_partkey", bits.alias("pattern"), F.lit("0800-0855").alias("time"))
    return reconcile.source_intervals(rows).select("p_partkey", "day", "start", "end")


@query("u8_answer_changing_diff", ctes("busy") + ", src AS (SELECT * FROM busy WHERE label <> 'click')," + ISLANDS.format(src="src", op=">") + """, own AS (SELECT DISTINCT resource_id, date, start, "end" FROM busy WHERE label = 'click' AND "end" > start)
 SELECT o.resource_id, o.date, o.start, o."end", (o."end" - o.start - coalesce(sum(least(o."end", m."end") - greatest(o.start, m.start)), 0))::BIGINT AS lacking FROM own o LEFT JOIN merged m ON o.resource_id = m.resource_id AND o.date = m.date AND o.start < m."end" AND o."end" > m.start GROUP BY o.resource_id, o.date, o.start, o."end" HAVING lacking > 0""")
def _(spark, sf):
    rows = X.busy(spark, sf)
    return reconcile.uncovered(rows.where("label = 'click'"), rows.where("label <> 'click'"), KEYS)


@query("u9_adjudicate", """WITH t AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS l, CASE WHEN l_linenumber = 2 THEN l_quantity + 1 ELSE l_quantity END AS v FROM lineitem WHERE l_orderkey % 5 <> 0 AND l_linenumber <> 3)
 SELECT l_orderkey AS "order", l_linenumber AS line, CASE WHEN v = l_quantity THEN 'confirmed' WHEN v IS NOT NULL THEN 'stale' WHEN l_orderkey IN (SELECT o FROM t) THEN 'part-gone' ELSE 'whole-gone' END AS verdict FROM lineitem LEFT JOIN t ON o = l_orderkey AND l = l_linenumber""")
def _(spark, sf):
    li = X.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("value"))
    truth = li.where("order % 5 <> 0 and line <> 3").withColumn("value", F.when(F.col("line") == 2, F.col("value") + 1).otherwise(F.col("value")))
    return reconcile.adjudicate(li, truth).select("order", "line", "verdict")


@query("u12_dedupe_conflict", "SELECT o_custkey, count(*) AS rows, max(o_totalprice) - min(o_totalprice) > 1e-6 AS conflict FROM orders GROUP BY 1")
def _(spark, sf):
    return reconcile.dedupe_conflict(X.table(spark, sf, "orders"), "o_custkey", ["o_totalprice"])


@query("a17_source_coverage", "SELECT count(*) FILTER (WHERE l) AS in_a, count(*) FILTER (WHERE e) AS in_b, count(*) FILTER (WHERE l AND e) AS in_both, count(*) FILTER (WHERE l OR e) AS in_either, count(*) FILTER (WHERE NOT l AND NOT e) AS in_none FROM (SELECT doc_id IN (SELECT doc_id FROM labels) AS l, doc_id IN (SELECT page_id FROM pages) AS e FROM documents)")
def _(spark, sf):
    pages = X.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"))
    return reconcile.source_coverage(X.table(spark, sf, "documents"), X.table(spark, sf, "labels"), pages, "doc_id")


@query("a18_value_agreement", "SELECT doc_id, quality IS NULL OR toxic IS NULL OR quality = toxic AS agree FROM labels")
def _(spark, sf):
    return reconcile.value_agreement(X.table(spark, sf, "labels"), "doc_id", ["quality", "toxic"])


@query("a19_majority_vote", ctes("busy") + "SELECT resource_id, label, votes FROM (SELECT resource_id, label, count(*) AS votes FROM busy GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY resource_id ORDER BY votes DESC, label) = 1")
def _(spark, sf):
    return reconcile.majority_vote(X.busy(spark, sf), ["resource_id"], "label")


@query("a20_contingency", "SELECT p_brand, p_type, count(*) AS rows FROM part GROUP BY ALL")
def _(spark, sf):
    return reconcile.contingency(X.table(spark, sf, "part"), "p_brand", "p_type")


@query("a21_order_inversions", "SELECT a.s_nationkey, count(*) AS pairs, count(*) FILTER (WHERE sign(a.s_acctbal - b.s_acctbal) * sign((a.s_suppkey * 37 % 101) - (b.s_suppkey * 37 % 101)) < 0) AS flipped FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey GROUP BY 1")
def _(spark, sf):
    s = X.table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal", (F.col("s_suppkey") * 37 % 101).alias("other"))
    return reconcile.order_inversions(s, "s_nationkey", "s_suppkey", "s_acctbal", "other")


@query("a22_delta_distribution", "SELECT round(avg(l_discount - l_tax), 9) AS mean, round(quantile_cont(l_discount - l_tax, 0.5), 9) AS median, round(quantile_cont(l_discount - l_tax, 0.9), 9) AS p90, count(*) FILTER (WHERE l_discount > l_tax) AS up, count(*) FILTER (WHERE l_discount < l_tax) AS down FROM lineitem")
def _(spark, sf):
    d = F.col("l_discount") - F.col("l_tax")
    return X.table(spark, sf, "lineitem").agg(
        F.round(F.avg(d), 9).alias("mean"), F.round(F.percentile(d, 0.5), 9).alias("median"), F.round(F.percentile(d, 0.9), 9).alias("p90"), F.count_if(F.col("l_discount") > F.col("l_tax")).alias("up"), F.count_if(F.col("l_discount") < F.col("l_tax")).alias("down")
    )


# -- guards ------------------------------------------------------------------------------------


@query("g1_count_guard", "SELECT 'count:resources' AS guard, CASE WHEN n < 10 THEN 'fatal' WHEN n < ceil(p * 0.95) THEN 'forceable' ELSE 'ok' END AS level, n::VARCHAR AS detail FROM (SELECT count(DISTINCT user_id) FILTER (WHERE event_id % 2 = 0) AS n, count(DISTINCT user_id) AS p FROM events)")
def _(spark, sf):
    rows = X.busy(spark, sf)
    return guards.count_guard(schedule.index_measure(rows.where("event_id % 2 = 0")), "resources", 10, schedule.index_measure(rows))


@query("g2_residue_guard", ctes("busy") + "SELECT 'residue:end' AS guard, CASE WHEN count(*) FILTER (WHERE \"end\" <= start) / count(*) > 0.01 THEN 'fatal' ELSE 'ok' END AS level, (count(*) FILTER (WHERE \"end\" <= start))::VARCHAR AS detail FROM busy")
def _(spark, sf):
    return guards.residue_guard(X.busy(spark, sf), F.col("end") <= F.col("start"), "end", 0.01)


@query("g4_unresolved_guard", "SELECT 'unresolved:k' AS guard, CASE WHEN count(*) > 0 THEN 'fatal' ELSE 'ok' END AS level, count(*)::VARCHAR AS detail FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2))")
def _(spark, sf):
    c = X.table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    return guards.unresolved_guard(c, X.table(spark, sf, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("k")), "k")


@query("g6_pii_guard", "SELECT 'pii:' || c AS guard, CASE WHEN n > 0 THEN 'fatal' ELSE 'ok' END AS level, n::VARCHAR AS detail FROM (SELECT unnest(['text', 'lang', 'source']) AS c, unnest([count(*) FILTER (WHERE {0}), 0, 0]) AS n FROM documents)".replace("{0}", f"regexp_matches(text, '{guards.EMAIL}') OR regexp_matches(text, '{guards.PHONE}')"))
def _(spark, sf):
    return guards.pii_guard(X.table(spark, sf, "documents"))


@query("g8_field_shape", "SELECT f AS field, m AS missing, b AS malformed FROM (SELECT unnest(['o_orderkey', 'o_orderstatus']) AS f, unnest([count(*) FILTER (WHERE o_orderkey IS NULL), count(*) FILTER (WHERE o_orderstatus IS NULL)]) AS m, unnest([0, count(*) FILTER (WHERE NOT regexp_matches(o_orderstatus, '^[FO]$'))]) AS b FROM orders)")
def _(spark, sf):
    return guards.field_shape(X.table(spark, sf, "orders"), ("o_orderkey",), {"o_orderstatus": "^[FO]$"})


@query("g10_freshness_guard", "SELECT event_id, CASE WHEN d < -1 / 24 THEN 'future' WHEN d > 10 THEN 'stale' ELSE 'ok' END AS state, CASE WHEN d >= 0 THEN floor(d / 7)::BIGINT ELSE 0 END AS missed FROM (SELECT event_id, epoch(TIMESTAMP '2024-01-20' - date_trunc('second', ts)) / 86400 AS d FROM events)")
def _(spark, sf):
    rows = X.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("generated"))
    return guards.freshness_guard(rows, F.expr("timestamp'2024-01-20 00:00:00'")).select("event_id", "state", "missed")


@query("g18_archive_completeness", "SELECT source, expected, items, ceil(items / 20)::BIGINT AS pages, CASE WHEN expected >= 10000 THEN 'CAPPED' WHEN items < expected THEN 'SHORT' ELSE 'ok' END AS status FROM (SELECT source, count(*) AS expected, count(*) FILTER (WHERE doc_id % 50 <> 0) AS items FROM documents GROUP BY source)")
def _(spark, sf):
    d = X.table(spark, sf, "documents")
    return guards.archive_completeness(d.where("doc_id % 50 <> 0"), "source", d.groupBy("source").agg(F.count(F.lit(1)).alias("expected")), page=20)


@query("g15_location_consistency", "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS labels FROM customer GROUP BY 1 HAVING labels > 1")
def _(spark, sf):
    return guards.location_consistency(X.table(spark, sf, "customer"), "c_nationkey", "c_mktsegment")


# -- graph -------------------------------------------------------------------------------------


@query("n2_component_labels", ctes("edges").replace("WITH ", "WITH RECURSIVE ") + ", r(node, o) AS (SELECT src, src FROM edges UNION SELECT e.dst, r.o FROM r JOIN edges e ON e.src = r.node) SELECT node, min(o) AS label FROM r GROUP BY node")
def _(spark, sf):
    return graph.component_labels(X.edges(spark, sf))


@query("n4_bounded_distances", ctes("edges").replace("WITH ", "WITH RECURSIVE ") + ", r(source, node, dist) AS (SELECT src, src, 0 FROM edges UNION SELECT r.source, e.dst, r.dist + e.w FROM r JOIN edges e ON e.src = r.node WHERE r.dist + e.w <= 600) SELECT source, node, min(dist)::BIGINT AS dist FROM r GROUP BY ALL")
def _(spark, sf):
    e = X.edges(spark, sf)
    sources = e.select(F.col("src").alias("source"), F.col("src").alias("node"), F.lit(0).cast("long").alias("cost")).distinct()
    return graph.bounded_distances(e, sources, 600)


@query("n7_graph_funnel", ctes("edges") + "SELECT degree, count(*) AS nodes FROM (SELECT src, count(*) AS degree FROM edges GROUP BY src) GROUP BY degree")
def _(spark, sf):
    return graph.graph_funnel(X.edges(spark, sf))


@query("j13_nearest_node", """WITH n AS (SELECT p_partkey AS node, ((p_partkey % 100) * 60)::DOUBLE AS x, ((p_partkey // 100) * 60)::DOUBLE AS y FROM part), p AS (SELECT s_suppkey AS id, ((s_suppkey * 91) % 7000)::DOUBLE AS x, ((s_suppkey * 53) % 1500)::DOUBLE AS y FROM supplier)
 SELECT p.id, n.node, sqrt((p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y)) AS metres FROM p LEFT JOIN n ON sqrt((p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y)) <= 150 QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY metres, node) = 1""")
def _(spark, sf):
    k = F.col("p_partkey")
    nodes = X.table(spark, sf, "part").select(k.alias("node"), ((k % 100) * 60).cast("double").alias("x"), (F.floor(k / 100) * 60).cast("double").alias("y"))
    s = F.col("s_suppkey")
    points = X.table(spark, sf, "supplier").select(s.alias("id"), (s * 91 % 7000).cast("double").alias("x"), (s * 53 % 1500).cast("double").alias("y"))
    return graph.nearest_node(points, nodes).select("id", "node", "metres")


# -- streams -----------------------------------------------------------------------------------


X1_SQL = """WITH RECURSIVE f AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS "at", value * 10 AS x, (event_id % 97)::DOUBLE AS y, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM events),
 walk AS (SELECT user_id, event_id, "at", x, y, n, true AS kept, "at" AS last_at, x AS last_x, y AS last_y FROM f WHERE n = 1
 UNION ALL SELECT user_id, event_id, "at", x, y, n, kept, CASE WHEN kept THEN "at" ELSE last_at END, CASE WHEN kept THEN x ELSE last_x END, CASE WHEN kept THEN y ELSE last_y END
 FROM (SELECT f.*, w.last_at, w.last_x, w.last_y, coalesce(sqrt((f.x - w.last_x) * (f.x - w.last_x) + (f.y - w.last_y) * (f.y - w.last_y)) >= 40 AND f."at" - w.last_at >= 15, false) AS kept FROM f JOIN walk w ON f.user_id = w.user_id AND f.n = w.n + 1))
 SELECT user_id, event_id, "at", x, y FROM walk WHERE kept"""


def position_fixes(spark, sf) -> DataFrame:
    return X.table(spark, sf, "events").select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), (F.col("value") * 10).alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))


def as_stream(spark, rows: DataFrame, name: str, parts: int = 3) -> DataFrame:
    """The rows as a stream over files, read ``parts`` batches long."""
    path = f"{graph.scratch(spark)}/{name}-{uuid.uuid4().hex}"
    rows.repartition(parts).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("x1_throttle_fixes", X1_SQL)
def _(spark, sf):
    return fixes.throttle_fixes(position_fixes(spark, sf))


@query("x1_throttle_stream", X1_SQL)
def _(spark, sf):
    """The same over a stream of shuffled files; a last file moves the watermark past all fixes."""
    rows = position_fixes(spark, sf)
    path = f"{graph.scratch(spark)}/fixes-{uuid.uuid4().hex}"
    rows.repartition("event_id").write.parquet(path)
    read = lambda: fixes.throttle_fix_stream(spark.readStream.schema(rows.schema).parquet(path), delay="60 days")
    folder = f"{path}-out"
    fixes.run_to_end(read(), "fixes", folder)
    rows.agg(F.max("at").alias("at")).select(F.lit(-1).cast("long").alias("user_id"), F.lit(0).cast(rows.schema["event_id"].dataType).alias("event_id"), (F.col("at") + 61 * 86_400).alias("at"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).write.mode("append").parquet(path)
    return fixes.run_to_end(read(), "fixes", folder)


@query("x2_dedupe_stream", ctes("busy") + 'SELECT DISTINCT resource_id, date, start, "end", label FROM busy')
def _(spark, sf):
    rows = X.busy(spark, sf).select(*KEYS, "start", "end", "label", F.col("date").cast("timestamp").alias("ts"))
    keys = [*KEYS, "start", "end", "label"]
    return fixes.run_to_end(fixes.dedupe_feed_stream(as_stream(spark, rows, "feed"), keys, delay="60 days").select(*keys), "feed-once")


@query("x3_stale_feed_drop", "SELECT event_id FROM events WHERE (ts - INTERVAL 5 HOUR)::DATE = ts::DATE")
def _(spark, sf):
    """A row states the date by UTC; it is stale where the local date, five hours behind in January, is another."""
    rows = X.table(spark, sf, "events").select("event_id", "ts", F.to_date("ts").alias("date"))
    return fixes.stale_feed_stream(rows, "America/New_York").select("event_id")


@query("x3_stale_feed_stream", "SELECT event_id FROM events WHERE (ts - INTERVAL 5 HOUR)::DATE = ts::DATE")
def _(spark, sf):
    rows = X.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("date"))
    return fixes.run_to_end(fixes.stale_feed_stream(as_stream(spark, rows, "stale"), "America/New_York", delay="60 days").select("event_id"), "fresh")


# -- decisions ---------------------------------------------------------------------------------

SAFETY = """WITH c AS (SELECT p_partkey AS resource_id, p_partkey % 17 <> 0 AS campus, p_brand AS type, p_partkey % 23 = 0 AS restricted, (p_partkey * 7 % 3300)::DOUBLE AS metres, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey % 9 <> 0 END AS hours_known,
 p_size AS weekly, CASE WHEN p_partkey % 3 = 0 THEN true END AS listed FROM part),
 s AS (SELECT *, CASE WHEN NOT campus THEN 'offCampus' WHEN type NOT IN ('Brand#1', 'Brand#2', 'Brand#11', 'Brand#12', 'Brand#13') THEN 'type' WHEN restricted THEN 'restricted' WHEN metres > 3000 THEN 'farFromCampus' WHEN hours_known = false THEN 'noHours' WHEN weekly < 3 AND listed IS NULL THEN 'thin' END AS reason FROM c),
 v AS (SELECT *, CASE WHEN reason IS NULL THEN CASE WHEN type IN ('Brand#1', 'Brand#11') THEN 'shown' ELSE 'secondary' END END AS visibility FROM s)"""


def classified(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    rows = X.table(spark, sf, "part").select(
        k.alias("resource_id"), (k % 17 != 0).alias("campus"), F.col("p_brand").alias("type"), (k % 23 == 0).alias("restricted"), (k * 7 % 3300).cast("double").alias("metres"),
        F.when(k % 4 != 0, k % 9 != 0).alias("hours_known"), F.col("p_size").alias("weekly"), F.when(k % 3 == 0, True).alias("listed"),
    )
    return decide.classify_safety(rows, ("Brand#1", "Brand#11"), ("Brand#2", "Brand#12", "Brand#13"))


@query("p4_classify_safety", SAFETY + " SELECT resource_id, reason, visibility FROM v")
def _(spark, sf):
    return classified(spark, sf).select("resource_id", "reason", "visibility")


@query("a16_safety_stats", SAFETY + " SELECT coalesce(reason, visibility) AS outcome, count(*) AS rows, min(resource_id) AS example FROM v GROUP BY 1")
def _(spark, sf):
    return decide.safety_stats(classified(spark, sf))


@query("d6_staleness", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'gated' WHEN o_orderkey % 50 >= 35 THEN 'banner' WHEN o_orderkey % 50 >= 14 THEN 'line' ELSE 'silent' END AS state FROM orders")
def _(spark, sf):
    k = F.col("o_orderkey")
    return X.table(spark, sf, "orders").select("o_orderkey", decide.staleness(k % 50, k % 7 == 0).alias("state"))


@query("d1_refusal", """SELECT o_orderkey, CASE WHEN o_orderkey % 1500 > 1440 THEN 'clock' WHEN o_orderkey % 400 < 150 THEN 'index-floor' WHEN o_orderkey % 5 = 0 THEN 'exams' WHEN o_orderkey % 7 = 0 THEN 'out-of-term' WHEN o_orderkey % 11 = 0 THEN 'closed'
 WHEN o_orderkey % 13 = 0 OR o_orderkey % 100 / 100 < 0.1 THEN 'no-schedule' END AS reason FROM orders""")
def _(spark, sf):
    k = F.col("o_orderkey")
    reason = decide.refusal(k % 1500, k % 400, decide.season_floor(F.lit("1261")), k % 5 == 0, k % 7 != 0, k % 11 == 0, F.when(k % 13 != 0, k % 100 / 100))
    return X.table(spark, sf, "orders").select("o_orderkey", reason.alias("reason"))


@query("g19_season_floor", "SELECT p_partkey, CASE p_partkey % 10 WHEN 2 THEN 250 WHEN 4 THEN 200 WHEN 8 THEN 250 ELSE 150 END AS least FROM part")
def _(spark, sf):
    return X.table(spark, sf, "part").select("p_partkey", decide.season_floor(F.col("p_partkey").cast("string")).alias("least"))


@query("f17_room_claim", ctes("busy", "hours", "resources") + "," + ISLANDS.format(src="busy", op=">") + """, ends AS (SELECT resource_id, date, min(start) AS first, max("end") AS last FROM merged GROUP BY ALL),
 q AS (SELECT DISTINCT b.resource_id, b.date, (400 + (b.resource_id * 37 + b.day * 211) % 1030)::INT AS now, h.day IS NOT NULL AS known, CASE WHEN h.day IS NULL THEN first ELSE h.open END AS open, CASE WHEN h.day IS NULL THEN last ELSE h.close END AS close
  FROM busy b JOIN ends USING (resource_id, date) JOIN resources r ON r.resource_id = b.resource_id LEFT JOIN hours h ON h.place_id = r.place_id AND h.day = b.day),
 bl AS (SELECT q.*, greatest(k.start, open) AS s, least(k."end", close) AS e FROM q JOIN merged k USING (resource_id, date) WHERE least(k."end", close) > greatest(k.start, open)),
 gp AS (SELECT resource_id, date, s AS a, e AS z FROM bl UNION ALL SELECT resource_id, date, close, close FROM q WHERE open IS NOT NULL),
 fr AS (SELECT resource_id, date, coalesce(lag(z) OVER w, open) AS s, a AS e FROM gp JOIN (SELECT resource_id, date, open FROM q) USING (resource_id, date) WINDOW w AS (PARTITION BY resource_id, date ORDER BY a, z)),
 st AS (SELECT q.*, (SELECT max(e) FROM bl WHERE bl.resource_id = q.resource_id AND bl.date = q.date AND s <= q.now AND q.now < e) AS class_end, (SELECT count(*) FROM bl WHERE bl.resource_id = q.resource_id AND bl.date = q.date) AS n,
   (SELECT min(s) FROM bl WHERE bl.resource_id = q.resource_id AND bl.date = q.date AND s >= q.now) AS later, (SELECT count(*) FROM fr WHERE fr.resource_id = q.resource_id AND fr.date = q.date AND e - s >= 20 AND s <= q.now AND q.now < e) AS here FROM q),
 t AS (SELECT *, CASE WHEN open IS NULL THEN 'no-class-today' WHEN now < open THEN CASE WHEN known THEN 'opens' ELSE 'before-first-class' END WHEN now >= close THEN CASE WHEN known THEN 'closed-for-day' ELSE 'after-last-class' END WHEN class_end IS NOT NULL THEN 'in-class' WHEN n = 0 THEN 'no-class-today' WHEN here = 0 THEN 'nothing-free' ELSE 'free' END AS state FROM st),
 u AS (SELECT *, CASE state WHEN 'opens' THEN open WHEN 'before-first-class' THEN open WHEN 'closed-for-day' THEN close WHEN 'after-last-class' THEN close WHEN 'in-class' THEN class_end WHEN 'free' THEN later - 10 END AS until, CASE state WHEN 'opens' THEN open WHEN 'in-class' THEN class_end END AS after FROM t)
 SELECT resource_id, date, now, state, until::INT AS until, (SELECT min(s) FROM fr WHERE fr.resource_id = u.resource_id AND fr.date = u.date AND e - s >= 20 AND s >= u.after)::INT AS next FROM u""")
def _(spark, sf):
    rows = X.busy(spark, sf)
    merged = intervals.merge_intervals(rows, KEYS).select(*KEYS, "start", "end")
    ends = merged.groupBy(*KEYS).agg(F.min("start").alias("first"), F.max("end").alias("last"))
    now = (400 + (F.col("resource_id") * 37 + F.col("day") * 211) % 1030).cast("int")
    asks = rows.select(*KEYS, "day", now.alias("now")).distinct().join(ends, KEYS).join(X.resources(spark, sf).select("resource_id", "place_id"), "resource_id")
    asks = rank.hours_tristate_join(asks, X.hours(spark, sf)).withColumn("known", F.col("state") != "unknown")
    own = lambda a, b: F.when(F.col("known"), F.col(a)).otherwise(F.col(b)).cast("int").alias(a)
    return decide.room_claims(merged, asks.select(*KEYS, "now", "known", own("open", "first"), own("close", "last")))


@query("u10_calendar_states", """WITH e AS (SELECT o_orderdate::DATE AS date, CASE WHEN o_orderkey % 40 = 0 THEN 2 WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS l FROM orders) SELECT date, CASE max(l) WHEN 2 THEN 'offices-closed' WHEN 1 THEN 'no-classes' ELSE 'none' END AS state FROM e GROUP BY date""")
def _(spark, sf):
    k = F.col("o_orderkey")
    summary = F.when(k % 40 == 0, "Offices closed: holiday").when(k % 9 == 0, "Autumn Break").otherwise("First day")
    return decide.calendar_states(X.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), summary.alias("summary")))


@query("j12_nearest_door", """WITH d AS (SELECT n_nationkey AS place_id, (i * 37 % 90)::DOUBLE AS east, (i * 53 % 70 + n_nationkey)::DOUBLE AS north FROM nation, range(4) t(i) WHERE i < n_nationkey % 4), o AS (SELECT s_suppkey AS id, s_nationkey AS place_id, (s_suppkey % 101)::DOUBLE AS x, (s_suppkey % 77)::DOUBLE AS y FROM supplier)
 SELECT id, o.place_id, coalesce(min(sqrt((x - east) * (x - east) + (y - north) * (y - north))), sqrt(x * x + y * y)) AS metres FROM o LEFT JOIN d ON d.place_id = o.place_id GROUP BY id, o.place_id, x, y""")
def _(spark, sf):
    k, i = F.col("n_nationkey"), F.col("i")
    doors = X.table(spark, sf, "nation").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).where(i < k % 4).select(k.alias("place_id"), (i * 37 % 90).cast("double").alias("east"), (i * 53 % 70 + k).cast("double").alias("north"))
    s = F.col("s_suppkey")
    origins = X.table(spark, sf, "supplier").select(s.alias("id"), F.col("s_nationkey").alias("place_id"), (s % 101).cast("double").alias("x"), (s % 77).cast("double").alias("y"))
    return decide.nearest_door(origins, doors)


@query("t4_rank_places", ctes("hours", "asks", "places") + f""", n AS (SELECT a.*, p.place_id, {METRES.format(a='a', b='p')} AS metres, ceil({METRES.format(a='a', b='p')} * 1.3 / 78.0)::INT AS walk FROM asks a, places p WHERE {METRES.format(a='a', b='p')} <= {RADIUS}),
 s AS (SELECT n.ask_id, n.place_id, walk, metres, CASE WHEN h.day IS NULL THEN 'unknown' WHEN open <= now AND now < close THEN 'open' ELSE 'closed' END AS status, CASE WHEN open > now THEN open ELSE 1441 END AS opens FROM n LEFT JOIN hours h ON h.place_id = n.place_id AND h.day = n.day)
 SELECT ask_id, place_id, status, row_number() OVER (PARTITION BY ask_id, status ORDER BY CASE WHEN status = 'closed' THEN opens ELSE 0 END, walk, metres, place_id) AS place FROM s""")
def _(spark, sf):
    near = rank.hours_tristate_join(rank.ask_places(X.asks(spark, sf), X.places(spark, sf), RADIUS), X.hours(spark, sf))
    return rank.rank_places(near).select("ask_id", "place_id", "status", F.col("place").cast("long").alias("place"))


@query("a28_available_per_place", ANSWERS + " SELECT ask_id, place_id, count(*) AS free FROM answers WHERE known AND wait = 0 GROUP BY ask_id, place_id")
def _(spark, sf):
    return answered(spark, sf, lambda a: a.where("known and wait = 0").groupBy("ask_id", "place_id").agg(F.count(F.lit(1)).alias("free")))


@query("t8_soonest_opening", ANSWERS + " SELECT ask_id, min(gap_start) AS opens FROM answers WHERE wait > 90 GROUP BY ask_id")
def _(spark, sf):
    return answered(spark, sf, lambda a: a.where("wait > 90").groupBy("ask_id").agg(F.min("gap_start").alias("opens")))


@query("a25_visibility_counts", ANSWERS + " SELECT ask_id, count(*) AS ranked, count(*) FILTER (WHERE place <= 40) AS shown, count(*) FILTER (WHERE place > 40) AS below FROM ranked GROUP BY ask_id")
def _(spark, sf):
    """Places are numbers from 1 without gaps, so counts tell how many lie past 40."""
    counts = answered(spark, sf, lambda a: a.groupBy("ask_id").agg(F.count(F.lit(1)).alias("ranked")))
    return counts.select("ask_id", "ranked", F.least("ranked", F.lit(40)).alias("shown"), F.greatest(F.col("ranked") - 40, F.lit(0)).alias("below"))


NODES = "nodes AS (SELECT p_partkey AS node, ((p_partkey % 100) * 60)::DOUBLE AS x, ((p_partkey // 100) * 60)::DOUBLE AS y FROM part)"


def nodes(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    return X.table(spark, sf, "part").select(k.alias("node"), ((k % 100) * 60).cast("double").alias("x"), (F.floor(k / 100) * 60).cast("double").alias("y"))


@query("n5_prune_to_reach", ctes("edges").replace("WITH ", "WITH RECURSIVE ") + ", " + NODES + """, d AS (SELECT DISTINCT ((s_suppkey * 977) % 20000 - 5000)::DOUBLE AS x, ((s_suppkey * 531) % 9000 - 3000)::DOUBLE AS y FROM supplier WHERE s_suppkey % 4 = 1),
 s AS (SELECT node FROM d, nodes n QUALIFY row_number() OVER (PARTITION BY d.x, d.y ORDER BY sqrt((d.x - n.x) * (d.x - n.x) + (d.y - n.y) * (d.y - n.y)), node) = 1),
 r(node, dist) AS (SELECT DISTINCT node, 0 FROM s UNION SELECT e.dst, r.dist + e.w FROM r JOIN edges e ON e.src = r.node WHERE r.dist + e.w <= 300), k AS (SELECT DISTINCT node FROM r) SELECT src, dst, w FROM edges WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)""")
def _(spark, sf):
    k = F.col("s_suppkey")
    doors = X.table(spark, sf, "supplier").where("s_suppkey % 4 = 1").select((k * 977 % 20000 - 5000).cast("double").alias("x"), (k * 531 % 9000 - 3000).cast("double").alias("y"))
    return graph.prune_to_reach(X.edges(spark, sf), nodes(spark, sf), doors, 300).select("src", "dst", "w")


@query("g13_refusal_report", ctes("busy") + """, f AS (SELECT (SELECT count(*) > 0 FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2))::BIGINT
 + (SELECT count(DISTINCT source) <= 1 OR count(*) FILTER (WHERE source = 'src0') = 0 FROM documents)::BIGINT + (SELECT count(*) FILTER (WHERE event_id % 10 = 0) / count(*) > 0.05 FROM busy)::BIGINT AS fatal,
 (SELECT min(m) / max(m) < 0.3 FROM (SELECT sum(greatest("end" - start, 0)) AS m FROM busy WHERE day BETWEEN 1 AND 5 GROUP BY day))::BIGINT AS forceable) SELECT *, fatal > 0 OR forceable > 0 AS refused FROM f""")
def _(spark, sf):
    c = X.table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    rows = X.busy(spark, sf)
    found = [
        guards.unresolved_guard(c, X.table(spark, sf, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("k")), "k"),
        guards.coordinate_guard(X.places(spark, sf)),
        guards.bucket_guard(X.table(spark, sf, "documents"), "source", "src0"),
        guards.balance_guard(schedule.index_measure(rows)),
        guards.residue_guard(rows, F.col("event_id") % 10 == 0, "tenth", 0.05),
    ]
    return guards.refusal_report(found)


@query("p10_off_range", ctes("places") + f"SELECT place_id, {METRES.format(a='places', b='c')} > 900 AS off FROM places, (SELECT 39.995::DOUBLE AS lat, -83.013::DOUBLE AS lon) c")
def _(spark, sf):
    return X.places(spark, sf).select("place_id", (S.planar_m(F.col("lat"), F.col("lon"), F.lit(39.995), F.lit(-83.013)) > 900).alias("off"))


@query("f26_short_name", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'wing ' || s_suppkey ELSE s_name END AS name FROM supplier")
def _(spark, sf):
    k = F.col("s_suppkey")
    name = F.when(k % 2 == 0, F.concat("s_name", F.lit(" annex - wing "), k.cast("string"))).otherwise(F.col("s_name"))
    return X.table(spark, sf, "supplier").select("s_suppkey", S.short_name(name).alias("name"))
