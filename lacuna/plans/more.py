"""More registered queries: sources, functions, hours, calendar, features, doors, sweeps and routes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import scalars as S
from lacuna.operators import calendar, decide, features, graph, guards, intervals, places, rank, schedule
from lacuna.plans import fixtures as X
from lacuna.plans.fixtures import ctes
from lacuna.plans.registry import ANSWERS, GAPS, KEYS, METRES, NODES, RADIUS, nodes, query, windows
from lacuna.sources import readers

T = X.table


def fresh(spark, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{graph.scratch(spark)}/{name}-{uuid.uuid4().hex}"


# -- sources -----------------------------------------------------------------------------------


def archive(spark, sf) -> str:
    """A page for each order: a course, its flags as sections, its lines as meetings with persons."""
    li = T(spark, sf, "lineitem").select(
        "l_orderkey", "l_returnflag",
        F.struct(
            F.col("l_partkey").cast("string").alias("facilityId"), F.col("l_linestatus").alias("buildingCode"), F.lit("8:00 am").alias("startTime"), (F.col("l_quantity") > 25).alias("monday"),
            F.array(F.struct(F.col("l_suppkey").cast("string").alias("name"))).alias("instructors"),
        ).alias("m"),
    )
    sections = li.groupBy("l_orderkey", "l_returnflag").agg(F.collect_list("m").alias("meetings"))  # an order's lines
    sections = sections.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("classNumber"), F.lit("2026-08-25").alias("startDate"), "meetings")).alias("sections"))
    path = fresh(spark, "archive")
    sections.select(F.struct(F.array(F.struct(F.col("l_orderkey").cast("string").alias("subject"), "sections")).alias("courses")).alias("data")).write.option("compression", "gzip").json(path)
    return path


@query("s1_read_page_archive", """SELECT l_orderkey::VARCHAR AS subject, l_returnflag AS "classNumber", DATE '2026-08-25' AS "startDate", l_partkey::VARCHAR AS "facilityId", l_linestatus AS "buildingCode", l_quantity > 25 AS monday FROM lineitem""")
def _(spark, sf):
    return readers.read_page_archive(spark, archive(spark, sf)).select("subject", "classNumber", "startDate", "facilityId", "buildingCode", "monday")


@query("p12_drop_personal_fields", """SELECT l_orderkey::VARCHAR AS subject, '{"facilityId":"' || l_partkey || '","buildingCode":"' || l_linestatus || '"}' AS meeting, 1 AS removed FROM lineitem""")
def _(spark, sf):
    person = "array<struct<name: string>>"
    schema = f"data struct<courses: array<struct<subject: string, sections: array<struct<meetings: array<struct<facilityId: string, buildingCode: string, instructors: {person}>>>>>>>"
    pages = spark.read.schema(schema).json(archive(spark, sf))
    rows = pages.select(F.explode("data.courses").alias("c")).select("c.subject", F.explode("c.sections.meetings").alias("meetings"))
    removed = rows.withColumn("n", F.transform("meetings", lambda m: F.size(m["instructors"]))).withColumn("meetings", F.transform("meetings", lambda m: m.dropFields("instructors")))
    return removed.select("subject", F.explode(F.arrays_zip("meetings", "n")).alias("z")).select("subject", F.to_json("z.meetings").alias("meeting"), F.col("z.n").alias("removed"))


@query("s2_read_keyed_dim", "SELECT s_suppkey::VARCHAR AS id, s_name AS name, s_nationkey AS nation FROM supplier")
def _(spark, sf):
    path = fresh(spark, "keyed")
    entry = F.struct(F.col("s_suppkey").cast("string"), F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))
    T(spark, sf, "supplier").groupBy(F.floor(F.col("s_suppkey") / 100)).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).select("value").write.text(path)  # a hundred to an object
    return readers.read_keyed_dim(spark, path, "name: string, nation: int", lines=True)


@query("s3_read_id_list", "SELECT DISTINCT c_custkey::VARCHAR AS id, DATE '2024-01-01' + c_nationkey::INT AS pulled FROM customer")
def _(spark, sf):
    path = fresh(spark, "ids")
    lists = T(spark, sf, "customer").groupBy("c_nationkey", F.floor(F.col("c_custkey") / 1000)).agg(F.collect_list(F.col("c_custkey").cast("string")).alias("ids"))
    lists.select(F.expr("date_add(date'2024-01-01', c_nationkey)").alias("pulled"), "ids").write.json(path)
    return readers.read_id_list(spark, path, "ids", lines=True)


@query("s5_calendar_events", "SELECT 'Order ' || o_orderkey || ', ' || o_orderstatus AS summary, unnest(generate_series(o_orderdate::DATE, o_orderdate::DATE + (o_orderkey % 3)::INT, INTERVAL 1 DAY))::DATE AS day FROM orders")
def _(spark, sf):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    stamp = lambda d: F.date_format(d, "yyyyMMdd")
    end = F.when(k % 3 > 0, F.concat(F.lit("DTEND;VALUE=DATE:"), stamp(F.date_add(day, (k % 3 + 1).cast("int"))), F.lit("\r\n"))).otherwise("")
    text = F.concat(F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:Or\r\n der "), k.cast("string"), F.lit("\\, "), F.col("o_orderstatus"), F.lit("\r\nDTSTART;VALUE=DATE:"), stamp(day), F.lit("\r\n"), end, F.lit("END:VEVENT\r\nEND:VCALENDAR\r\n"))
    return readers.calendar_events(T(spark, sf, "orders").select(text.alias("text")), "text")


@query("s6_five_year_column", "SELECT o_orderkey AS table_id, unnest(generate_series(o_orderdate::DATE + 1, o_orderdate::DATE + 1 + (o_orderkey % 2)::INT, INTERVAL 1 DAY))::DATE AS day FROM orders")
def _(spark, sf):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    cells = T(spark, sf, "orders").select(k.alias("table_id"), day.alias("d"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("col")).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(1))))
    first, last = F.date_add("d", F.col("col")), F.date_add("d", (F.col("col") + F.col("table_id") % 2).cast("int"))
    text = F.when(F.col("row") == 0, F.concat(F.lit(" Term "), F.col("col").cast("string"))).when(F.col("table_id") % 2 == 0, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit(" to "), last.cast("string")))
    cells = cells.select("table_id", "row", "col", text.alias("text"))
    return calendar.date_cells(calendar.column_of(cells, "TERM 1"), "text").select("table_id", "day")


@query("s7_write_index", ctes("busy") + 'SELECT session_id AS term, resource_id, (row_number() OVER (PARTITION BY session_id, resource_id ORDER BY day, start, "end", session_id, label) - 1)::INT AS place, day, start, "end", label FROM busy')
def _(spark, sf):
    """Two versions; read through the pointer, which the second one moved."""
    root, rows = fresh(spark, "index"), X.busy(spark, sf).withColumn("term", F.col("session_id"))
    readers.write_index(rows.where("day = 1"), root, "first")
    readers.write_index(rows, root, "second")
    found = readers.read_index(spark, root).select("term", "resource_id", F.posexplode("busy").alias("place", "b"))
    return found.select("term", "resource_id", "place", "b.day", "b.start", "b.end", "b.label")


@query("s8_write_guard_report", ctes("busy") + """SELECT 'a' AS run, 'residue:end' AS guard, CASE WHEN count(*) FILTER (WHERE "end" <= start) > 0.01 * count(*) THEN 'fatal' ELSE 'ok' END AS level, (count(*) FILTER (WHERE "end" <= start))::VARCHAR AS detail FROM busy
 UNION ALL SELECT 'b', 'residue:start', CASE WHEN count(*) FILTER (WHERE start < 60) > 0.01 * count(*) THEN 'fatal' ELSE 'ok' END, (count(*) FILTER (WHERE start < 60))::VARCHAR FROM busy""")
def _(spark, sf):
    path, rows = fresh(spark, "report"), X.busy(spark, sf)
    readers.write_report(guards.residue_guard(rows, F.col("end") <= F.col("start"), "end", 0.01), path, "a")
    readers.write_report(guards.residue_guard(rows, F.col("start") < 60, "start", 0.01), path, "b")
    return spark.read.parquet(path)


# -- scalars -----------------------------------------------------------------------------------


@query("f2_range_to_span", ctes("hours") + """, t AS (SELECT place_id, day, CASE WHEN open IS NULL THEN 'closed' WHEN place_id % 6 = 1 THEN 'noon' WHEN place_id % 6 = 2 THEN '7am-10' WHEN place_id % 6 = 3 THEN '9pm-8pm' ELSE 'ok' END AS kind, 420 + 30 * (place_id % 4) AS o, 1320 + 15 * (place_id % 5) AS c FROM hours)
 SELECT place_id, day, CASE WHEN kind = 'ok' THEN o END AS open, CASE WHEN kind = 'ok' THEN c END AS close, CASE kind WHEN 'noon' THEN 'separator' WHEN '7am-10' THEN 'close' WHEN '9pm-8pm' THEN 'order' END AS error FROM t""")
def _(spark, sf):
    k = F.col("place_id")
    text = F.when(F.col("open").isNull(), " Closed.").when(k % 6 == 1, "noon").when(k % 6 == 2, "7am-10").when(k % 6 == 3, "9pm-8pm").otherwise(F.concat(S.fmt_clock(F.col("open")), F.when(k % 2 == 0, " to ").otherwise(" – "), S.fmt_clock(F.col("close"))))
    return X.hours(spark, sf).select("place_id", "day", places.range_to_span(text).alias("s")).select("place_id", "day", "s.*")


@query("f3_feed_day_hours", """WITH t AS (SELECT o_orderkey, o_orderkey % 7 AS k, 60 * (6 + o_orderkey % 5) AS o, 60 * (13 + o_orderkey % 12) AS c FROM orders)
 SELECT o_orderkey, CASE k WHEN 0 THEN 0 WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE 1 END AS spans, CASE WHEN k IN (1, 4) THEN o WHEN k IN (2, 3) THEN 0 END AS open, CASE WHEN k IN (1, 4) THEN c WHEN k = 2 THEN 1440 WHEN k = 3 THEN 1439 END AS close FROM t""")
def _(spark, sf):
    k = F.col("o_orderkey")
    a, b = S.fmt_clock(60 * (6 + k % 5)), S.fmt_clock(60 * (13 + k % 12))
    status = F.element_at(F.array(*[F.lit(x) for x in ("closed", "open", "24hours", "text", "text", "text", "not-set")]), (k % 7 + 1).cast("int"))
    text = F.when(k % 7 == 3, "24 Hours (ID after dark)(Closed at 11:59PM)").when(k % 7 == 4, F.concat(a, F.lit(" - "), b, F.lit(", ask at the desk"))).when(k % 7 == 5, "By appointment")
    hours = F.array(F.struct(a.alias("from"), b.alias("to")))
    day = places.feed_day_hours(status, hours, F.coalesce(text, F.lit("")))
    rows = T(spark, sf, "orders").select("o_orderkey", day.alias("d"))
    return rows.select("o_orderkey", F.when(F.col("d").isNotNull(), F.size("d")).alias("spans"), F.get("d", F.lit(0))["open"].alias("open"), F.get("d", F.lit(0))["close"].alias("close"))


@query("f6_current_week_monday", "SELECT o_orderkey, CASE WHEN dayofweek(o_orderdate) = 0 THEN o_orderdate::DATE + 1 ELSE date_trunc('week', o_orderdate)::DATE END AS monday, CASE WHEN dayofweek(o_orderdate) = 0 THEN o_orderdate::DATE + 15 ELSE date_trunc('week', o_orderdate)::DATE + 14 END AS in_two_weeks FROM orders")
def _(spark, sf):
    monday = S.week_monday(F.to_date("o_orderdate"))
    return T(spark, sf, "orders").select("o_orderkey", monday.alias("monday"), S.add_weeks(monday, 2).alias("in_two_weeks"))


@query("f7_date_ranges", """SELECT o_orderkey, o_orderdate::DATE AS first, o_orderdate::DATE + (o_orderkey % 40)::INT AS last,
 CASE WHEN o_orderkey % 40 <> 0 THEN make_date(year(o_orderdate), month(o_orderdate::DATE - 1), day(o_orderdate::DATE - 1)) END AS early FROM orders WHERE o_orderkey % 5 <> 0""")
def _(spark, sf):
    k, a = F.col("o_orderkey"), F.to_date("o_orderdate")
    b = F.date_add(a, (k % 40).cast("int"))
    day = lambda d: F.date_format(d, "MMMM d")
    same_month, same_year = F.month(a) == F.month(b), F.year(a) == F.year(b)
    end = F.when(same_month & same_year, F.date_format(b, "d, yyyy")).otherwise(F.date_format(b, "MMMM d, yyyy"))
    text = F.when(k % 5 == 0, day(a)).when(k % 40 == 0, F.date_format(a, "MMMM d, yyyy")).otherwise(F.concat(F.lit("Break ("), day(a), F.when(same_year & (k % 2 == 0), "").otherwise(F.date_format(a, ", yyyy")), F.lit(" - "), end, F.lit("), 8 p.m. close on "), day(F.date_sub(a, 1))))
    return places.date_ranges(T(spark, sf, "orders").select("o_orderkey", text.alias("text")), "text", "o_orderkey")


@query("f13_walk_metres", "SELECT p_partkey, round(CASE WHEN p_partkey % 3 = 0 THEN p_retailprice ELSE p_size * 1.3::DOUBLE END, 6) AS metres FROM part")
def _(spark, sf):
    k = F.col("p_partkey")
    routed = F.when(k % 3 == 0, F.col("p_retailprice")).when(k % 3 == 1, F.lit(float("inf")))
    return T(spark, sf, "part").select("p_partkey", F.round(S.walk_metres(routed, F.col("p_size")), 6).alias("metres"))


@query("f14_walk_minutes", "SELECT p_partkey, ceil(p_retailprice / 78.0::DOUBLE)::INT AS walk FROM part")
def _(spark, sf):
    return T(spark, sf, "part").select("p_partkey", S.walk_minutes(F.col("p_retailprice")).alias("walk"))


@query("f15_usable_minutes", ctes("busy") + """, b AS (SELECT *, greatest(start - 30 + event_id % 20, start) AS begins FROM busy) SELECT event_id, ("end" - 10 - begins - CASE WHEN begins < 120 AND 120 < "end" THEN 60 ELSE 0 END)::INT AS usable FROM b""")
def _(spark, sf):
    return X.busy(spark, sf).select("event_id", S.usable_minutes(F.col("start") - 30, F.col("event_id") % 20, F.col("start"), F.col("end"), dst_at=F.lit(120), dst_lost=F.lit(60)).cast("int").alias("usable"))


@query("f16_leave_by", ctes("busy") + "SELECT event_id, greatest(480, start - event_id % 20)::INT AS leave FROM busy")
def _(spark, sf):
    return X.busy(spark, sf).select("event_id", S.leave_by(F.lit(480), F.col("start"), F.col("event_id") % 20).cast("int").alias("leave"))


@query("f18_window_class", ctes("busy") + """SELECT event_id, CASE WHEN event_id % 5 > 2 THEN 'wait' WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN 'unknown' WHEN "end" < 1320 THEN 'strong' ELSE 'medium' END AS class FROM busy""")
def _(spark, sf):
    e = F.col("event_id")
    wait, until = F.when(e % 5 > 2, 30).otherwise(0), F.when(e % 11 == 0, 2000).otherwise(F.col("start"))
    return X.busy(spark, sf).select("event_id", decide.window_class(wait, e % 7 != 0, until, F.lit(1320), F.col("end")).alias("class"))


@query("f22_learn_prefix", "SELECT s_nationkey AS place_id, 'B' || s_nationkey || '-' AS prefix FROM supplier GROUP BY 1 HAVING count(*) FILTER (WHERE s_suppkey % 3 <> 0) > 0")
def _(spark, sf):
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    room = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "A").otherwise(""), k, F.lit("C"))
    padded = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "A").otherwise(""), F.when(F.length(k) < 4, F.lpad(k, 4, "0")).otherwise(k), F.lit("C"))
    ident = F.when(F.col("s_suppkey") % 3 == 0, F.lit("other")).otherwise(F.concat(F.lit("B"), n, F.lit("-"), padded))
    return features.learn_prefix(T(spark, sf, "supplier").select(F.col("s_nationkey").alias("place_id"), ident.alias("resource_id"), room.alias("room")))


@query("f25_derive_attributes", """WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, p_size % 3 AS f FROM part) SELECT p_partkey, CASE WHEN k IN (0, 1) THEN 'tablet-arm' WHEN k IN (2, 3) THEN 'table-chair' WHEN f = 1 THEN 'tablet-arm' WHEN f = 2 THEN 'table-chair' END AS family,
 CASE WHEN k IN (0, 2) THEN 'bolted' WHEN k IN (1, 3) THEN CASE WHEN f = 2 THEN 'casters' ELSE 'freestanding' END WHEN f = 2 THEN 'casters' END AS mobility,
 CASE WHEN k IN (0, 2) THEN 'first' WHEN k IN (1, 3) THEN CASE WHEN f = 0 THEN 'first' ELSE 'both' END WHEN f = 2 THEN 'second' END AS basis,
 CASE WHEN f = 0 OR k > 3 THEN false WHEN k IN (0, 1) AND f = 2 THEN true WHEN k IN (2, 3) AND f = 1 THEN true WHEN k IN (0, 2) AND f = 2 THEN true ELSE false END AS contested, CASE WHEN k < 2 THEN true WHEN k = 2 THEN false END AS windows,
 CASE WHEN k = 5 THEN CASE f WHEN 0 THEN true WHEN 1 THEN false END ELSE k = 4 END AS chalk, CASE WHEN k = 5 THEN CASE f WHEN 0 THEN true WHEN 1 THEN true END ELSE false END AS white FROM p""")
def _(spark, sf):
    k, f = F.col("p_partkey") % 6, F.col("p_size") % 3
    codes = F.when(k == 0, F.array(F.lit(29), F.lit(39))).when(k == 1, F.array(F.lit(30), F.lit(39))).when(k == 2, F.array(F.lit(31), F.lit(40))).when(k == 3, F.array(F.lit(32), F.lit(39), F.lit(40))).when(k == 4, F.array(F.lit(43)))
    kind = F.when(f == 1, "Fixed Tablet Arm").when(f == 2, features.ON_WHEELS)
    listed = F.when(f == 0, F.array(F.lit("Chalk"), F.lit("Dry Erase"))).when(f == 1, F.array(F.lit("Dry Erase"))).otherwise(F.array().cast("array<string>"))
    return T(spark, sf, "part").select("p_partkey", features.derive_attributes(codes, kind, listed).alias("a")).select("p_partkey", "a.family", "a.mobility", "a.basis", "a.contested", "a.windows", "a.chalk", "a.white")


@query("f27_booking_kind", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'event' WHEN 1 THEN 'block' ELSE 'class' END AS kind FROM events")
def _(spark, sf):
    e = F.col("event_id")
    text = F.when(e % 3 == 0, F.concat(F.lit("MTG "), F.lpad(e.cast("string"), 9, "1"))).when(e % 3 == 1, F.lit("ROOM 12 BLOCK")).otherwise(F.concat(F.lit("CSE "), e.cast("string")))
    return T(spark, sf, "events").select("event_id", S.booking_kind(text).alias("kind"))


@query("f29_title_parts", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS name, CASE WHEN s_suppkey % 4 <> 0 THEN 'S' || s_suppkey % 100 END AS abbr, CASE WHEN s_suppkey % 4 > 1 THEN s_nationkey || ' High St' END AS address FROM supplier")
def _(spark, sf):
    k = F.col("s_suppkey")
    title = F.when(k % 4 == 0, F.col("s_name")).otherwise(F.concat(F.col("s_name"), F.lit("  (S"), (k % 100).cast("string"), F.lit(")"), F.when(k % 4 > 1, F.concat(F.lit(" | "), F.col("s_nationkey").cast("string"), F.lit(" High St"))).otherwise("")))
    return T(spark, sf, "supplier").select("s_suppkey", places.title_parts(title).alias("t")).select("s_suppkey", "t.name", "t.abbr", "t.address")


@query("f30_exam_dates", "SELECT o_custkey, min(d) AS first, max(d) AS last, count(DISTINCT d) AS days FROM (SELECT o_custkey, o_orderdate::DATE AS d FROM orders WHERE o_orderkey % 5 <> 4) GROUP BY 1")
def _(spark, sf):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    cell = F.when(k % 5 == 0, F.concat(F.lit("Monday "), F.date_format(d, "M/d"))).when(k % 5 < 3, F.concat(F.lit("Tues, "), F.date_format(d, "MMM d"))).when(k % 5 == 3, F.date_format(d, "'Friday' MMMM d, yyyy")).otherwise(F.concat(F.lit("Wed "), F.date_format(d, "MMM d"), F.lit(", 1901")))
    rows = T(spark, sf, "orders").select("o_custkey", cell.alias("cell"), F.year(d).alias("y"))
    return calendar.exam_dates_in_cells(rows, "o_custkey", "cell", F.col("y"))


# -- predicates and order ----------------------------------------------------------------------


@query("p2_is_real_resource", "SELECT event_id, event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AS real FROM events")
def _(spark, sf):
    e = F.col("event_id")
    rows = T(spark, sf, "events").select("event_id", F.when(e % 11 != 0, F.when(e % 13 == 0, "ONLINE").otherwise(F.col("user_id").cast("string"))).alias("resource_id"), F.when(e % 17 == 0, "OFFCAMPUS").when(e % 3 == 0, "x").alias("place_id"))
    return rows.select("event_id", schedule.is_real_resource(rows, ["ONLINE", "OFFCAMPUS"]).alias("real"))


@query("p5_offerable_types", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN true ELSE p_brand IN ('Brand#1', 'Brand#2') END AS swept, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN false ELSE p_brand IN ('Brand#1', 'Brand#2') END AS laddered FROM part")
def _(spark, sf):
    k = F.col("p_partkey")
    kind = F.when(k % 5 == 0, "").when(k % 7 != 0, F.col("p_brand"))
    return T(spark, sf, "part").select("p_partkey", features.offerable(kind, ["Brand#1", "Brand#2"]).alias("swept"), features.offerable(kind, ["Brand#1", "Brand#2"], strict=True).alias("laddered"))


@query("p9_feature_filter", "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_size % 8 = 3 OR p_size % 5 = 3 END AS has FROM part")
def _(spark, sf):
    codes = F.when(F.col("p_partkey") % 4 != 0, F.array(F.col("p_size") % 8, F.col("p_size") % 5))
    return T(spark, sf, "part").select("p_partkey", features.has_feature(codes, 3).alias("has"))


DOORS = ctes("places") + """, d AS (SELECT c_custkey AS door_id, CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 23 = 0 THEN 99 ELSE c_nationkey END AS place_id, CASE WHEN c_custkey % 19 <> 0 THEN p.lat + (c_custkey * 7 % 40) / 10000.0::DOUBLE END AS lat, p.lon + (c_custkey * 7 % 40) / 10000.0::DOUBLE AS lon,
 CASE WHEN c_custkey % 17 = 0 THEN 'Planned' ELSE 'Built' END AS status FROM customer JOIN places p ON p.place_id = c_nationkey),
 m AS (SELECT d.*, p.place_id IS NOT NULL AS known, """ + METRES.format(a="d", b="p") + """ AS metres FROM d LEFT JOIN places p USING (place_id)),
 e AS (SELECT *, CASE WHEN place_id IS NULL THEN 'noBuildingCode' WHEN NOT known THEN 'unknownBuilding' WHEN lat IS NULL THEN 'noCoordinate' WHEN status = 'Planned' THEN 'notBuilt' END AS early FROM m),
 f AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN door_id <> min(door_id) OVER (PARTITION BY early IS NULL, place_id, round(lat, 6), round(lon, 6)) THEN 'duplicatePoint' WHEN metres > 300 THEN 'tooFarFromBuilding' ELSE 'kept' END AS stage FROM e)"""


def doors(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    at = X.places(spark, sf).select(F.col("place_id").alias("c_nationkey"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    off = (k * 7 % 40) / 10000.0
    return T(spark, sf, "customer").join(at, "c_nationkey").select(
        k.alias("door_id"), F.when(k % 29 == 0, None).when(k % 23 == 0, 99).otherwise(F.col("c_nationkey")).alias("place_id"), F.when(k % 19 != 0, F.col("p_lat") + off).alias("lat"), (F.col("p_lon") + off).alias("lon"),
        F.when(k % 17 == 0, "Planned").otherwise("Built").alias("status"),
    )


@query("p13_door_funnel", DOORS + " SELECT door_id, stage, CASE WHEN stage = 'kept' THEN row_number() OVER (PARTITION BY place_id, stage ORDER BY metres, door_id) END AS place FROM f")
def _(spark, sf):
    return features.door_funnel(doors(spark, sf), X.places(spark, sf), 300.0).select("door_id", "stage", "place")


@query("g14_max_distance_guard", ctes("places") + """, d AS (SELECT c_custkey AS door_id, c_nationkey AS place_id, p.lat + (c_custkey * 7 % 40) / 10000.0::DOUBLE AS lat, p.lon AS lon, p.lat AS a, p.lon AS b FROM customer JOIN places p ON p.place_id = c_nationkey),
 m AS (SELECT *, 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(a - lat) / 2), 2) + cos(radians(lat)) * cos(radians(a)) * pow(sin(radians(b - lon) / 2), 2)))) AS metres FROM d) SELECT door_id, round(metres, 3) AS metres FROM m WHERE metres > 200""")
def _(spark, sf):
    k = F.col("c_custkey")
    at = X.places(spark, sf)
    kids = T(spark, sf, "customer").join(at.withColumnRenamed("place_id", "c_nationkey"), "c_nationkey").select(k.alias("door_id"), F.col("c_nationkey").alias("place_id"), (F.col("lat") + (k * 7 % 40) / 10000.0).alias("lat"), "lon")
    return guards.max_distance_guard(kids, at, "place_id", 200.0).select("door_id", F.round("metres", 3).alias("metres"))


@query("t1_total_order", """SELECT p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey % 3, p_retailprice % 10, coalesce(CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 90 END, 0) DESC, CASE p_brand WHEN 'Brand#1' THEN 0 WHEN 'Brand#2' THEN 1 ELSE 3 END, CASE WHEN p_partkey % 6 > 0 THEN p_partkey % 7 END, p_partkey) AS place FROM part""")
def _(spark, sf):
    k = F.col("p_partkey")
    rows = T(spark, sf, "part").select(F.col("p_size").alias("ask_id"), k.alias("resource_id"), (k % 3).alias("tier"), (F.col("p_retailprice") % 10).alias("score"), F.when(k % 4 > 0, k % 90).alias("usable"), F.col("p_brand").alias("type"), F.when(k % 6 > 0, k % 7).alias("seats"))
    return rank.total_order(rows, {"Brand#1": 0, "Brand#2": 1}).select(F.col("resource_id").alias("p_partkey"), "place")


@query("t2_tier_of", "SELECT l_orderkey, l_linenumber, (CASE WHEN l_quantity > 20 THEN CASE WHEN l_tax <= 0.04 THEN CASE WHEN l_discount > 0.05 THEN 0 ELSE 2 END ELSE 4 END WHEN l_discount > 0.05 THEN 6 ELSE 8 END + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::INT AS tier FROM lineitem")
def _(spark, sf):
    wait, listed = F.when(F.col("l_tax") > 0.04, 20).otherwise(0), F.when(F.col("l_returnflag") == "R", False).when(F.col("l_returnflag") == "A", True)
    return T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.tier_of(F.col("l_quantity") > 20, wait, F.col("l_discount") > 0.05, listed).cast("int").alias("tier"))


@query("t3_score_of", """SELECT p_partkey, round(CASE WHEN p_partkey % 5 = 0 THEN w WHEN n > 0 AND u >= n THEN w - 0.001::DOUBLE * least(u - n, 60) ELSE w - 0.1::DOUBLE * least(u - n, 60) END, 9) AS score FROM (SELECT p_partkey, (p_size % 20)::DOUBLE AS w, p_partkey % 300 AS u, p_partkey % 4 * 30 AS n FROM part)""")
def _(spark, sf):
    k = F.col("p_partkey")
    return T(spark, sf, "part").select("p_partkey", F.round(S.score_of(F.col("p_size") % 20, F.when(k % 5 != 0, k % 300), k % 4 * 30), 9).alias("score"))


# -- joins -------------------------------------------------------------------------------------

SWEPT = GAPS.replace(ctes("busy"), ctes("busy", "places", "asks", "resources", "hours")) + """, r AS (SELECT resource_id, CASE WHEN resource_id % 31 = 0 THEN 99 ELSE place_id END AS place_id, CASE WHEN resource_id % 8 = 0 THEN '' ELSE type END AS type FROM resources),
 p AS (SELECT place_id, CASE WHEN place_id % 9 <> 4 THEN lat END AS lat FROM places), q AS (SELECT ask_id, date, day, CASE WHEN ask_id % 10 <> 3 THEN lat END AS lat FROM asks),
 w AS (SELECT DISTINCT resource_id, date FROM busy EXCEPT SELECT resource_id, date FROM gaps),
 s AS (SELECT ask_id, CASE WHEN p.place_id IS NULL THEN 'noBuilding' WHEN p.lat IS NULL THEN 'noCoordinate' WHEN q.lat IS NULL THEN 'badOrigin' WHEN type NOT IN ('', 'BUILDING', 'MACHINERY') THEN 'notOfferable' WHEN h.day IS NOT NULL AND h.open IS NULL THEN 'closed'
   WHEN w.resource_id IS NOT NULL THEN 'noWindow' ELSE 'candidate' END AS reason FROM q CROSS JOIN r LEFT JOIN p ON p.place_id = r.place_id LEFT JOIN hours h ON h.place_id = r.place_id AND h.day = q.day LEFT JOIN w ON w.resource_id = r.resource_id AND w.date = q.date)"""


@query("j4_sweep_join", SWEPT + " SELECT ask_id, reason, count(*) AS n FROM s GROUP BY ALL")
def _(spark, sf):
    k = F.col("resource_id")
    found = X.resources(spark, sf).select("resource_id", F.when(k % 31 == 0, 99).otherwise(F.col("place_id")).alias("place_id"), F.when(k % 8 == 0, "").otherwise(F.col("type")).alias("type"))
    at = X.places(spark, sf).select("place_id", F.when(F.col("place_id") % 9 != 4, F.col("lat")).alias("lat"), "lon")
    asks = X.asks(spark, sf).select("ask_id", "date", "day", F.when(F.col("ask_id") % 10 != 3, F.col("lat")).alias("lat"), "lon")
    spans = windows(spark, sf)
    full = spans.select(*KEYS).join(intervals.free_gaps(X.busy(spark, sf), spans, KEYS).select(*KEYS).distinct(), KEYS, "left_anti")
    return rank.sweep_counts(asks, found, at, X.hours(spark, sf), full, ["BUILDING", "MACHINERY"])


@query("j8_group_halves", """WITH r AS (SELECT s_nationkey AS place, 'R' || s_suppkey AS id, s_suppkey % 2 = 0 AS g FROM supplier UNION ALL SELECT s_nationkey, 'R' || s_suppkey || 'A', false FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_nationkey, 'X' || (100 + s_suppkey) || '/9', true FROM supplier WHERE s_suppkey % 4 = 0
 UNION ALL SELECT s_nationkey, 'X' || (100 + s_suppkey), false FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT s_nationkey, 'X' || ((100 + s_suppkey) // 10) || '9', false FROM supplier WHERE s_suppkey % 4 = 0)
 SELECT DISTINCT a.place, a.id AS parent, b.id AS child FROM r a JOIN r b ON a.place = b.place AND a.g AND a.id NOT LIKE '%/%' AND b.id <> a.id AND starts_with(b.id, a.id)
 UNION SELECT s_nationkey, 'X' || (100 + s_suppkey) || '/9', unnest(['X' || (100 + s_suppkey), 'X' || ((100 + s_suppkey) // 10) || '9']) FROM supplier WHERE s_suppkey % 4 = 0""")
def _(spark, sf):
    k, s = F.col("s_suppkey"), T(spark, sf, "supplier")
    row = lambda df, i, g: df.select(F.col("s_nationkey").alias("place"), i.alias("id"), g.alias("group"))
    name = F.concat(F.lit("R"), k.cast("string"))
    fourth, no = s.where("s_suppkey % 4 = 0"), F.lit(False)
    x = F.concat(F.lit("X"), (100 + k).cast("string"))
    rows = row(s, name, k % 2 == 0).unionByName(row(s.where("s_suppkey % 3 = 0"), F.concat(name, F.lit("A")), no)).unionByName(row(fourth, F.concat(x, F.lit("/9")), F.lit(True)))
    rows = rows.unionByName(row(fourth, x, no)).unionByName(row(fourth, F.concat(F.lit("X"), F.floor((100 + k) / 10).cast("string"), F.lit("9")), no))
    return places.group_halves(rows).distinct()


@query("j17_two_pass_match", """WITH c AS (SELECT s_suppkey AS card_id, s_nationkey AS "group", CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey + CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END END AS place, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 40 END AS room, s_suppkey % 20 AS title_room FROM supplier),
 r AS (SELECT c_nationkey AS place, c_custkey % 30 AS room, min(c_custkey) AS key FROM customer GROUP BY 1, 2), v AS (SELECT "group", place AS voted FROM (SELECT "group", place, count(*) AS n FROM c WHERE place IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY "group" ORDER BY n DESC, place) = 1)
 SELECT card_id, coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NOT NULL THEN 'photo' WHEN b.key IS NOT NULL THEN 'title' END AS matched_by FROM c LEFT JOIN v USING ("group") LEFT JOIN r a ON a.place = c.place AND a.room = c.room LEFT JOIN r b ON b.place = v.voted AND b.room = c.title_room""")
def _(spark, sf):
    k = F.col("s_suppkey")
    cards = T(spark, sf, "supplier").select(k.alias("card_id"), F.col("s_nationkey").alias("group"), F.when(k % 3 != 0, F.col("s_nationkey") + F.when(k % 7 == 0, 1).otherwise(0)).alias("place"), F.when(k % 3 != 0, k % 40).alias("room"), (k % 20).alias("title_room"))
    rooms = T(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("place"), (F.col("c_custkey") % 30).alias("room"))
    return features.two_pass_match(cards, rooms)


SLID = """WITH a AS (SELECT c_custkey AS key, DATE '2026-01-01' + (c_custkey % 300)::INT AS date, CASE WHEN c_custkey % 2 = 0 THEN 'closed' ELSE 'no-classes' END AS state FROM customer),
 b AS (SELECT key, date + CASE key % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN -2 WHEN 3 THEN 9 ELSE 0 END AS date, CASE WHEN key % 5 = 4 THEN 'other' ELSE state END AS state FROM a)"""


@query("j19_slid_dates", SLID + """ SELECT a.key, a.state, a.date AS left_date, b.date AS right_date, abs(a.date - b.date)::INT AS gap FROM a JOIN b USING (key) WHERE key % 5 IN (1, 2) UNION ALL SELECT key, state, date, NULL, NULL FROM a WHERE key % 5 = 3
 UNION ALL SELECT key, state, NULL, date, NULL FROM b WHERE key % 5 = 3 UNION ALL SELECT key, a.state || '/other', date, date, NULL FROM a WHERE key % 5 = 4""")
def _(spark, sf):
    k = F.col("c_custkey")
    a = T(spark, sf, "customer").select(k.alias("key"), F.expr("date_add(date'2026-01-01', cast(c_custkey % 300 as int))").alias("date"), F.when(k % 2 == 0, "closed").otherwise("no-classes").alias("state"))
    by = F.col("key") % 5
    b = a.select("key", F.date_add("date", F.when(by == 1, 1).when(by == 2, -2).when(by == 3, 9).otherwise(0)).alias("date"), F.when(by == 4, "other").otherwise(F.col("state")).alias("state"))
    return calendar.slid_dates(a, b, 2).select("key", "state", "left_date", "right_date", "gap")


TIMES, NEEDS = (550, 730, 910, 1090), (30, 60)


@query("j20_origins_x_resources", ANSWERS + f""", grid AS (SELECT t, n FROM (VALUES {", ".join(f"({t})" for t in TIMES)}) a(t), (VALUES {", ".join(f"({n})" for n in NEEDS)}) b(n)),
 nearby AS (SELECT DISTINCT ask_id AS source, date, place_id, walk FROM near),
 ways AS (SELECT source, nearby.date, t, n, walk, resource_id, gap_start <= t + walk AND gap_end - 10 - n >= t + walk AS ok FROM nearby, grid LEFT JOIN resources r ON r.place_id = nearby.place_id LEFT JOIN gaps g USING (resource_id) WHERE g.date = nearby.date OR g.date IS NULL)
 SELECT s.source, s.date, s.t AS time, s.n AS need, coalesce(count(DISTINCT resource_id) FILTER (WHERE ok), 0) AS resources, min(walk) FILTER (WHERE ok) AS nearest
 FROM (SELECT DISTINCT source, date, t, n FROM nearby, grid) s LEFT JOIN ways w USING (source, date, t, n) GROUP BY ALL""")
def _(spark, sf):
    asks, dates = X.asks(spark, sf), X.asks(spark, sf).select("date").distinct()
    near = rank.ask_places(asks, X.places(spark, sf), RADIUS).select(F.col("ask_id").alias("source"), "date", "place_id", "walk")
    busy = X.busy(spark, sf).join(dates, "date", "left_semi")
    spans = busy.select("resource_id", "date").distinct().withColumn("open", F.lit(480)).withColumn("close", F.lit(1320))
    gaps = intervals.free_gaps(busy, spans, KEYS).join(X.resources(spark, sf).select("resource_id", "place_id"), "resource_id")
    return rank.replay(near, rank.free_steps(gaps, NEEDS), TIMES, NEEDS)


@query("j21_attach_features", """WITH f AS (SELECT l_partkey AS k, list_sort(list_distinct(list(CASE WHEN l_quantity < 45 THEN (l_quantity * 20)::INT END))) AS features, count(*) FILTER (WHERE l_quantity >= 45 OR l_quantity IS NULL) AS invalid FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
 SELECT p_partkey AS resource_id, features::VARCHAR AS features, invalid FROM part LEFT JOIN f ON k = p_partkey""")
def _(spark, sf):
    codes = F.array(F.when(F.col("l_quantity") < 45, F.round(F.col("l_quantity") * 20).cast("int")).otherwise(5000))
    table = T(spark, sf, "lineitem").select(F.col("l_returnflag").alias("term"), F.col("l_partkey").alias("resource_id"), codes.alias("codes"))
    out = features.attach_features(T(spark, sf, "part").select(F.col("p_partkey").alias("resource_id")), table, "R")
    return out.select("resource_id", F.when(F.col("features").isNotNull(), F.concat(F.lit("["), F.array_join("features", ", "), F.lit("]"))).alias("features"), "invalid")


@query("j22_pick_versioned", "SELECT p_partkey, p_brand AS slug FROM part WHERE p_brand = (SELECT min(p_brand) FROM part WHERE starts_with(p_brand, 'Brand#1'))")
def _(spark, sf):
    return decide.pick_versioned(T(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("slug")), "Brand#1")


@query("j23_abbr_fanout", "SELECT n_name AS abbr, n_regionkey AS region, s_suppkey AS place_id FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey % 6 <> 0) ON s_nationkey = n_nationkey")
def _(spark, sf):
    nation = T(spark, sf, "nation")
    codes = T(spark, sf, "supplier").where("s_nationkey % 6 <> 0").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("abbr"), F.col("s_suppkey").alias("place_id"))
    return features.abbr_fanout(nation.select(F.col("n_name").alias("abbr"), F.col("n_regionkey").alias("region")), codes)


@query("u13_interval_tuples", """SELECT DISTINCT l_suppkey || ':' || l_partkey % 10 AS room, unnest(list_filter([CASE WHEN l_quantity > 25 THEN 0 END, CASE WHEN l_discount > 0.05 THEN 1 END], lambda x: x IS NOT NULL))::INT AS day, (480 + l_linenumber * 60)::INT AS start, (530 + l_linenumber * 60)::INT AS "end" FROM lineitem WHERE l_returnflag <> 'A'""")
def _(spark, sf):
    n = F.col("l_linenumber")
    rows = T(spark, sf, "lineitem").select(F.col("l_suppkey").alias("place"), F.when(F.col("l_returnflag") != "A", F.col("l_partkey") % 10).alias("room"), F.array(F.col("l_quantity") > 25, F.col("l_discount") > 0.05).alias("days"), (480 + n * 60).alias("start"), (530 + n * 60).alias("end"))
    return features.interval_tuples(rows)


# -- aggregates --------------------------------------------------------------------------------


@query("a6_schedule_share_on", ctes("busy", "sessions") + """, d AS (SELECT DISTINCT date FROM busy) SELECT d.date, coalesce(count(*) FILTER (WHERE s.session_id IS NOT NULL AND d.date BETWEEN first AND last) / count(b.event_id), 0.0) AS share, coalesce(count(*) FILTER (WHERE s.session_id IS NOT NULL AND d.date BETWEEN first AND last) / count(b.event_id), 0.0) < 0.005 AS dark
 FROM d LEFT JOIN busy b ON b.day = dayofweek(d.date) LEFT JOIN sessions s USING (session_id) GROUP BY d.date""")
def _(spark, sf):
    rows = X.busy(spark, sf)
    return calendar.schedule_share_on(rows, X.sessions(spark, sf), rows.select("date"))


def _free_window_sql() -> str:
    named = "(SELECT * FROM (VALUES ('evening', 1, 600, 900), ('evening', 2, 600, 900), ('evening', 3, 600, 900), ('late', 6, 480, 1320)) t(name, d, a, z))"
    return f"""{ctes("busy")}, w AS {named}, f AS (SELECT *, CASE WHEN label = 'click' THEN 'event' WHEN label = 'purchase' THEN 'block' END AS kind FROM busy), n AS (SELECT count(DISTINCT resource_id) AS n FROM busy),
 m AS (SELECT name, resource_id, day, kind, unnest(range(greatest(start, a), least("end", z))) AS x FROM f JOIN w ON d = day WHERE least("end", z) > greatest(start, a)),
 own AS (SELECT DISTINCT name, resource_id, day, x FROM m WHERE kind IS NULL), fed AS (SELECT DISTINCT name, resource_id, day, kind, x FROM m WHERE kind IS NOT NULL),
 un AS (SELECT fed.*, own.x IS NULL AS open FROM fed LEFT JOIN own USING (name, resource_id, day, x)), c AS (SELECT name, kind, count(*) AS n, count(*) FILTER (WHERE open) AS o FROM un GROUP BY ALL)
 SELECT w.name, (sum(z - a) * any_value(n.n))::BIGINT AS window_minutes, (sum(z - a) * any_value(n.n) - (SELECT count(*) FROM own WHERE own.name = w.name))::BIGINT AS free_minutes,
  coalesce((SELECT n FROM c WHERE c.name = w.name AND kind = 'event'), 0)::BIGINT AS event_minutes, coalesce((SELECT n FROM c WHERE c.name = w.name AND kind = 'block'), 0)::BIGINT AS block_minutes,
  coalesce((SELECT o FROM c WHERE c.name = w.name AND kind = 'event'), 0)::BIGINT AS event_free, coalesce((SELECT o FROM c WHERE c.name = w.name AND kind = 'block'), 0)::BIGINT AS block_free FROM w, n GROUP BY w.name"""


@query("a13_free_window_analysis", _free_window_sql())
def _(spark, sf):
    rows = X.busy(spark, sf)
    kind = F.when(F.col("label") == "click", "event").when(F.col("label") == "purchase", "block")
    feed = rows.withColumn("kind", kind)
    return features.free_window_analysis(feed.where("kind is null"), feed.where("kind is not null"), rows, [("evening", [1, 2, 3], 600, 900), ("late", [6], 480, 1320)])


@query("a23_footprint_bias", """WITH v AS (SELECT l_suppkey AS k, sqrt((l_quantity - l_suppkey % 50) * (l_quantity - l_suppkey % 50) + (l_partkey % 70 - l_suppkey % 30) * (l_partkey % 70 - l_suppkey % 30)) AS d FROM lineitem),
 f AS (SELECT k, max(d) AS far FROM v GROUP BY 1), s AS (SELECT list_sort(list(far)) AS a, count(*) AS n FROM f)
 SELECT n AS places, round(a[least(n - 1, floor(n * 0.5))::INT + 1], 9) AS median, round(a[least(n - 1, floor(n * 0.9))::INT + 1], 9) AS p90, round(a[n], 9) AS most FROM s""")
def _(spark, sf):
    """Each supplier's lines are the corners of its outline, a ring for each return flag."""
    k = F.col("l_suppkey")
    corner = F.struct(F.col("l_quantity").cast("double").alias("x"), (F.col("l_partkey") % 70).cast("double").alias("y"))
    rings = T(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.collect_list(corner).alias("ring"))
    outlines = rings.groupBy("l_suppkey").agg(F.collect_list("ring").alias("rings")).select(k.alias("place_id"), (k % 50).cast("double").alias("x"), (k % 30).cast("double").alias("y"), "rings")
    return features.footprint_bias(outlines).select("places", *[F.round(c, 9).alias(c) for c in ("median", "p90", "most")])


@query("a24_field_trial_tally", """WITH v AS (SELECT event_id % 2 = 0 AS hours_known, event_id % 3 = 0 AS shown, CASE event_id % 7 WHEN 0 THEN 'empty' WHEN 1 THEN 'occupied' WHEN 2 THEN 'missing' WHEN 3 THEN 'locked-outer' WHEN 4 THEN 'locked-inner' END AS o FROM events)
 SELECT hours_known, count(*) AS picked, count(*) FILTER (WHERE shown) AS shown, count(o) AS visited, count(*) FILTER (WHERE o = 'empty') AS confirmed, count(*) FILTER (WHERE o IN ('occupied', 'missing') OR o = 'locked-outer' AND hours_known) AS contradicted,
 count(*) FILTER (WHERE o = 'locked-inner' OR o = 'locked-outer' AND NOT hours_known) AS unclaimed, count(*) FILTER (WHERE o <> 'empty') AS unusable FROM v GROUP BY 1""")
def _(spark, sf):
    e = F.col("event_id")
    outcome = F.when(e % 7 == 0, "empty").when(e % 7 == 1, "occupied").when(e % 7 == 2, "missing").when(e % 7 == 3, "locked-outer").when(e % 7 == 4, "locked-inner")
    return features.trial_tally(T(spark, sf, "events").select((e % 2 == 0).alias("hours_known"), (e % 3 == 0).alias("shown"), outcome.alias("outcome")))


EVENTS = """WITH e AS (SELECT o_custkey AS key, o_orderdate::DATE AS date, CASE o_orderkey % 4 WHEN 0 THEN 'Autumn classes begin' WHEN 1 THEN 'Last day of regularly scheduled classes' WHEN 2 THEN 'Final examinations for semester' ELSE 'Other' END AS summary FROM orders),
 t AS (SELECT key, min(date) FILTER (WHERE summary LIKE '%classes begin') AS first, max(date) FILTER (WHERE summary LIKE 'Last day%') AS last FROM e GROUP BY key), k AS (SELECT * FROM t WHERE first IS NOT NULL AND last IS NOT NULL)"""


def events(spark, sf) -> DataFrame:
    k = F.col("o_orderkey") % 4
    summary = F.when(k == 0, "Autumn classes begin").when(k == 1, "Last day of regularly scheduled classes").when(k == 2, "Final examinations for semester").otherwise("Other")
    return T(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("date"), summary.alias("summary"))


@query("a26_window_bounds", EVENTS + " SELECT k.key, first, last, min(e.date) AS exams_first, max(e.date) AS exams_last FROM k LEFT JOIN e ON e.key = k.key AND summary LIKE 'Final%' AND e.date > last AND e.date <= last + 60 GROUP BY ALL")
def _(spark, sf):
    return calendar.window_bounds(events(spark, sf), "(?i)classes begin$", "(?i)^Last day of regularly scheduled", "(?i)^Final examinations for (semester|Summer Term)", ["key"])


@query("a29_always_open_places", ctes("hours") + ", h AS (SELECT * FROM hours UNION ALL SELECT place_id, day, 600, 900 FROM hours WHERE open IS NULL AND place_id % 3 = 1) SELECT place_id FROM h WHERE open IS NOT NULL GROUP BY place_id HAVING count(DISTINCT day) = 7")
def _(spark, sf):
    """Of every third place a second source publishes hours for its closed day."""
    h = X.hours(spark, sf)
    second = h.where("open is null and place_id % 3 = 1").select("place_id", "day", F.lit(600).alias("open"), F.lit(900).alias("close"))
    return decide.always_open(h.unionByName(second))


@query("u11_window_check", """WITH w AS (SELECT o_orderkey AS key, unnest(['finals', 'five-year', 'ics']) AS source, o_orderdate::DATE AS d FROM orders),
 v AS (SELECT key, source, d + CASE WHEN source = 'five-year' AND key % 3 = 0 THEN 1 WHEN source = 'ics' THEN (key % 5)::INT ELSE 0 END AS first, d FROM w WHERE NOT (source = 'finals' AND key % 4 = 0)),
 b AS (SELECT *, CASE WHEN key % 4 = 0 THEN CASE WHEN key % 3 = 0 THEN d + 1 ELSE d END ELSE d END AS best, d + CASE WHEN key % 11 = 0 THEN 3 ELSE -5 END AS term_last FROM v)
 SELECT key, source, best AS exams_first, best + 6 AS exams_last, abs(first - best)::INT AS slip, CASE WHEN best <= term_last THEN 'before-term-end' WHEN abs(first - best) > CASE source WHEN 'ics' THEN 3 ELSE 0 END THEN 'disagrees' WHEN first <> best THEN 'slid' ELSE 'agrees' END AS verdict FROM b""")
def _(spark, sf):
    k, d = F.col("key"), F.col("d")
    rows = T(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.to_date("o_orderdate").alias("d"), F.explode(F.array(F.lit("finals"), F.lit("five-year"), F.lit("ics"))).alias("source"))
    off = F.when((F.col("source") == "five-year") & (k % 3 == 0), 1).when(F.col("source") == "ics", (k % 5).cast("int")).otherwise(0)
    rows = rows.where("not (source = 'finals' and key % 4 = 0)").withColumn("first", F.date_add(d, off)).withColumn("last", F.date_add("first", 6)).withColumn("term_last", F.date_add(d, F.when(k % 11 == 0, 3).otherwise(-5)))
    return calendar.window_check(rows, {"finals": 0, "five-year": 0, "ics": 3})


# -- hours and doors ---------------------------------------------------------------------------

SPANS = """spans AS (SELECT s_suppkey AS place_id, DATE '2026-03-01' + i::INT AS date, CASE WHEN s_suppkey % 6 = 0 THEN 0 ELSE 420 + 10 * (s_suppkey % 9) END AS open, CASE WHEN s_suppkey % 6 = 0 THEN 1440 WHEN s_suppkey % 4 = 0 THEN 1560 ELSE 1200 + 10 * (s_suppkey % 9) END AS close
  FROM supplier, range(7) t(i) WHERE (s_suppkey + i) % 5 <> 0), known AS (SELECT s_suppkey AS place_id, DATE '2026-03-01' + i::INT AS date FROM supplier, range(7) t(i) WHERE (s_suppkey + i) % 10 <> 5)"""
DOOR = "WITH " + SPANS + """, q AS (SELECT s_suppkey AS place_id, DATE '2026-03-01' + i::INT AS date, ((s_suppkey * 37 + i * 211) % 1440)::INT AS now FROM supplier, range(8) t(i)),
 every AS (SELECT * FROM spans UNION ALL SELECT place_id, date + 1, 0, close - 1440 FROM spans WHERE close > 1440),
 g AS (SELECT q.place_id, q.date, q.now, count(e.open) AS n, arg_min(close, open) FILTER (WHERE open <= now AND now < close) AS closes, min(open) FILTER (WHERE open > now) AS next, bool_or(k.place_id IS NOT NULL) AS known FROM q LEFT JOIN every e ON e.place_id = q.place_id AND e.date = q.date LEFT JOIN known k ON k.place_id = q.place_id AND k.date = q.date GROUP BY ALL),
 door AS (SELECT place_id, date, now, CASE WHEN closes IS NOT NULL THEN 'open' WHEN NOT known THEN 'unknown' WHEN next IS NOT NULL THEN 'before' WHEN n = 0 THEN 'closed-today' ELSE 'after' END AS "when", closes, next FROM g)"""


def spans(spark, sf) -> DataFrame:
    k, i = F.col("s_suppkey"), F.col("i")
    rows = T(spark, sf, "supplier").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(6)))).where((k + i) % 5 != 0)
    close = F.when(k % 6 == 0, 1440).when(k % 4 == 0, 1560).otherwise(1200 + 10 * (k % 9))
    return rows.select(k.alias("place_id"), F.expr("date_add(date'2026-03-01', i)").alias("date"), F.when(k % 6 == 0, 0).otherwise(420 + 10 * (k % 9)).cast("int").alias("open"), close.cast("int").alias("close"))


def doors_at(spark, sf) -> DataFrame:
    k, i = F.col("s_suppkey"), F.col("i")
    s = T(spark, sf, "supplier")
    known = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(6)))).where((k + i) % 10 != 5).select(k.alias("place_id"), F.expr("date_add(date'2026-03-01', i)").alias("date"))
    asks = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7)))).select(k.alias("place_id"), F.expr("date_add(date'2026-03-01', i)").alias("date"), ((k * 37 + i * 211) % 1440).cast("int").alias("now"))
    return places.door_at(asks, spans(spark, sf), known)


@query("f9_door_at", DOOR + """ SELECT place_id, date, now, "when", closes, CASE WHEN "when" = 'before' THEN next END AS opens FROM door""")
def _(spark, sf):
    return doors_at(spark, sf)


DATED = DOOR + """, n AS (SELECT date::VARCHAR AS ask_id, place_id, 'n' || place_id AS name, (place_id * 13 % 30)::INT AS walk, (place_id * 13 % 30 * 78)::DOUBLE AS metres, "when", closes, now FROM door),
 ranked AS (SELECT *, CASE WHEN "when" = 'open' THEN 'open' ELSE 'closed' END AS "group", row_number() OVER (PARTITION BY ask_id, CASE WHEN "when" = 'open' THEN 'open' ELSE 'closed' END ORDER BY walk, round(metres), name) AS place FROM n WHERE "when" <> 'unknown')"""


def ranked_doors(spark, sf) -> DataFrame:
    k = F.col("place_id")
    rows = doors_at(spark, sf).select(F.col("date").cast("string").alias("ask_id"), k.alias("place_id"), F.concat(F.lit("n"), k.cast("string")).alias("name"), (k * 13 % 30).cast("int").alias("walk"), (k * 13 % 30 * 78).cast("double").alias("metres"), "when", "closes", "now")
    return places.rank_dated_places(rows)


@query("t6_rank_dated_places", DATED + ' SELECT ask_id, place_id, "group", place FROM ranked')
def _(spark, sf):
    return ranked_doors(spark, sf).select("ask_id", "place_id", "group", "place")


@query("t9_study_fallback", DATED + """, o AS (SELECT ask_id, place_id, row_number() OVER (PARTITION BY ask_id ORDER BY place) AS place FROM ranked WHERE "group" = 'open' AND closes - now - walk >= 30) SELECT * FROM o WHERE place <= 2""")
def _(spark, sf):
    return places.study_fallback(ranked_doors(spark, sf)).select("ask_id", "place_id", "place")


@query("w7_closing_chain", "WITH RECURSIVE " + SPANS + """, s AS (SELECT place_id, (date - DATE '2026-03-01')::INT AS n, open, least(close, 1440) AS close FROM spans), c(place_id, n, m, close) AS (SELECT place_id, n, n, close FROM s UNION ALL SELECT c.place_id, c.n, s.n, s.close FROM c JOIN s ON s.place_id = c.place_id AND s.n = c.m + 1 AND s.open = 0 AND c.close = 1440)
 SELECT place_id, n, max((m - n) * 1440 + close)::INT AS closes FROM c GROUP BY 1, 2""")
def _(spark, sf):
    rows = spans(spark, sf).select("place_id", F.datediff("date", F.expr("date'2026-03-01'")).alias("n"), "open", F.least("close", F.lit(1440)).alias("close"))
    return decide.closing_chain(rows)


@query("f8_rule_days", """WITH d AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders), c AS (SELECT DISTINCT o_orderdate::DATE + i::INT AS date FROM orders, range(2) t(i) WHERE o_orderkey % 97 = 0), b AS (SELECT DISTINCT o_orderdate::DATE + i::INT AS date FROM orders, range(4) t(i) WHERE o_orderkey % 89 = 0), e AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders WHERE o_orderkey % 31 = 0),
 t AS (SELECT *, dayofweek(date) IN (0, 6) AS we, date IN (SELECT date FROM b) AS br FROM d)
 SELECT date, CASE WHEN date IN (SELECT date FROM c) THEN NULL WHEN br THEN CASE WHEN we THEN 600 ELSE 480 END ELSE CASE WHEN we THEN 540 ELSE 420 END END AS open,
 CASE WHEN date IN (SELECT date FROM c) THEN NULL WHEN br THEN CASE WHEN we THEN 1080 WHEN date IN (SELECT date FROM e) THEN 1200 ELSE 1260 END ELSE CASE WHEN date IN (SELECT date FROM e) THEN 1200 WHEN we THEN 1320 ELSE 1440 END END AS close FROM t""")
def _(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    span = lambda m, n: o.where(f"o_orderkey % {m} = 0").select(F.col("date").alias("first"), F.date_add("date", n).alias("last"))
    tables = spark.createDataFrame([("regular", False, 420, 1440), ("regular", True, 540, 1320), ("break", False, 480, 1260), ("break", True, 600, 1080)], "kind string, weekend boolean, open int, close int")
    return places.rule_days(o.select("date").distinct(), span(97, 1), span(89, 3), tables, o.where("o_orderkey % 31 = 0").select("date"))


HELD = ctes("busy") + """, h AS (SELECT resource_id, date, start, "end" FROM busy WHERE label = 'purchase'), m AS (SELECT resource_id, date, start, "end" FROM busy WHERE label <> 'purchase' AND "end" > start),
 q AS (SELECT DISTINCT resource_id, date, (480 + (resource_id * 7) % 700)::INT AS now FROM busy),
 g AS (SELECT q.*, min(start) AS first, max("end") FILTER (WHERE start <= now AND now < "end") AS class_end, min(start) FILTER (WHERE start > now) AS next FROM q LEFT JOIN m USING (resource_id, date) GROUP BY ALL),
 c AS (SELECT resource_id, date, now, CASE WHEN first IS NULL THEN 'no-class-today' WHEN class_end IS NOT NULL THEN 'in-class' WHEN now < first THEN 'before-first-class' WHEN next IS NULL THEN 'after-last-class' ELSE 'free' END AS state, next FROM g)
 SELECT c.resource_id, c.date, c.now, state, coalesce(bool_or(start <= now AND now < "end"), false) AS held_now, min(start) FILTER (WHERE state = 'free' AND start >= next - 5 AND start <= next) AS may_be_booked, count(start) AS holds FROM c LEFT JOIN h USING (resource_id, date) GROUP BY c.resource_id, c.date, c.now, state"""


@query("w14_holds_on", HELD.replace("start >= next - 5 AND start <= next", "start = next"))
def _(spark, sf):
    rows = X.busy(spark, sf)
    asks = rows.select(*KEYS, (480 + F.col("resource_id") * 7 % 700).cast("int").alias("now")).distinct()
    merged = intervals.merge_intervals(rows.where("label <> 'purchase' and end > start"), KEYS).select(*KEYS, "start", "end")
    ends = merged.groupBy(*KEYS).agg(F.min("start").alias("open"), F.max("end").alias("close"))
    claims = decide.room_claims(merged, asks.join(ends, KEYS, "left").withColumn("known", F.lit(False)), seam=1)
    return features.holds_on(rows.where("label = 'purchase'"), claims).drop("until")


# -- decisions ---------------------------------------------------------------------------------

LOOKUP = """WITH d AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders), c AS (SELECT o_orderdate::DATE AS date, min(ROW(CASE WHEN o_orderkey % 2 = 0 THEN 'no-classes' ELSE 'offices-closed' END, 'Holiday ' || o_orderkey % 5)) AS c FROM orders WHERE o_orderkey % 37 = 0 GROUP BY 1),
 l AS (SELECT d.date, c.c[1] AS state, c.c[2] AS name, year(d.date) % 2 = 0 AS in_term, month(d.date) = 12 AND day(d.date) BETWEEN 5 AND 15 AS exams, month(d.date) = 10 AND day(d.date) <= 7 AS low FROM d LEFT JOIN c USING (date))"""


def looked_up(spark, sf) -> DataFrame:
    o = T(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    closed = o.where("o_orderkey % 37 = 0").select("date", F.when(F.col("o_orderkey") % 2 == 0, "no-classes").otherwise("offices-closed").alias("state"), F.concat(F.lit("Holiday "), (F.col("o_orderkey") % 5).cast("string")).alias("name"))
    years = o.select(F.year("date").alias("y")).distinct()
    span = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), F.make_date("y", *a).alias("first"), F.make_date("y", *b).alias("last"))
    lit = lambda *x: tuple(F.lit(v) for v in x)
    spans = span(years.where("y % 2 = 0"), "term", lit(1, 1), lit(12, 31)).unionByName(span(years, "exams", lit(12, 5), lit(12, 15))).unionByName(span(years, "low", lit(10, 1), lit(10, 7)))
    return calendar.calendar_lookup(o.select("date").distinct(), closed, spans)


@query("d9_calendar_lookup", LOOKUP + " SELECT date, state, name, in_term, exams, low AS low_confidence FROM l")
def _(spark, sf):
    return looked_up(spark, sf)


@query("d2_resolve_state", LOOKUP + """, r AS (SELECT *, CASE WHEN exams THEN 'exams' WHEN NOT in_term THEN 'out-of-term' WHEN state = 'offices-closed' THEN 'closed' END AS reason FROM l) SELECT date, CASE WHEN reason IS NULL THEN 'RANKED' ELSE 'REFUSED' END AS kind,
 CASE WHEN reason IS NULL THEN CASE WHEN state = 'no-classes' THEN 'suspended' WHEN low THEN 'low-confidence' WHEN dayofweek(date) IN (0, 6) THEN 'weekend' END END AS note, coalesce(reason IS NULL AND state = 'no-classes', false) AS suspended FROM r""")
def _(spark, sf):
    rows = looked_up(spark, sf)
    shut = F.coalesce(F.col("state") == "offices-closed", F.lit(False))
    reason = decide.refusal(F.lit(600), F.lit(1000), F.lit(150), F.col("exams"), F.col("in_term"), shut, F.lit(1.0))
    return rows.select("date", calendar.resolve_state(reason, F.col("state"), F.col("low_confidence"), F.dayofweek("date") - 1).alias("s")).select("date", "s.*")


COVERED = LOOKUP + """, v AS (SELECT *, in_term AND coalesce(state, '') <> 'offices-closed' AND NOT exams AND dayofweek(date) BETWEEN 1 AND 5 AND day(date) % 13 <> 0 AS covered, NOT exams AND in_term AND coalesce(state, '') <> 'offices-closed' AS ranked FROM l)"""


def covered(spark, sf) -> DataFrame:
    rows = looked_up(spark, sf)
    day = F.dayofweek("date") - 1
    on = calendar.schedule_covers(F.col("in_term"), F.col("state"), F.col("exams"), day.between(1, 5), F.when(F.dayofmonth("date") % 13 != 0, 0.9))
    return rows.withColumn("covered", on).withColumn("ranked", ~F.col("exams") & F.col("in_term") & ~F.coalesce(F.col("state") == "offices-closed", F.lit(False)))


@query("d4_schedule_covers", COVERED + " SELECT date, covered FROM v")
def _(spark, sf):
    return covered(spark, sf).select("date", "covered")


@query("d5_next_search_window", COVERED + """, q AS (SELECT o_orderkey AS ask_id, o_orderdate::DATE AS date, (o_orderkey * 37 % 1440)::INT AS now FROM orders),
 n AS (SELECT ask_id, i::INT AS ahead, dayofweek(v.date)::INT AS day, CASE WHEN dayofweek(v.date) IN (0, 6) THEN 420 WHEN covered THEN 475 END AS "at", now FROM q, range(7) t(i), v WHERE v.date = q.date + i::INT AND ranked)
 SELECT ask_id, ahead, day, "at" FROM n WHERE "at" IS NOT NULL AND (ahead > 0 OR now < "at") QUALIFY row_number() OVER (PARTITION BY ask_id ORDER BY ahead) = 1""")
def _(spark, sf):
    k = F.col("o_orderkey")
    asks = T(spark, sf, "orders").select(k.alias("ask_id"), F.to_date("o_orderdate").alias("date"), (k * 37 % 1440).cast("int").alias("now"))
    return calendar.next_search_window(asks, covered(spark, sf).select("date", "ranked", "covered", F.lit(475).alias("start")))


@query("d7_needed_minutes", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN greatest(30, 1320 - o_orderkey % 1440) ELSE 60 END::INT AS need FROM orders")
def _(spark, sf):
    k = F.col("o_orderkey")
    return T(spark, sf, "orders").select("o_orderkey", calendar.needed_minutes(F.lit(60), k % 1440, F.lit(1320), k % 3 == 0).cast("int").alias("need"))


@query("d8_day_claim", LOOKUP + """ SELECT date, CASE WHEN exams THEN 'finals' WHEN NOT in_term THEN 'out-of-term' WHEN state = 'offices-closed' THEN 'campus-closed' WHEN state = 'no-classes' THEN 'no-classes' WHEN dayofweek(date) = 0 THEN 'closed' WHEN day(date) % 4 <> 0 THEN 'first-class' ELSE 'no-class' END AS head FROM l""")
def _(spark, sf):
    first = F.when(F.dayofmonth("date") % 4 != 0, 480)
    return looked_up(spark, sf).select("date", calendar.day_claim(F.col("exams"), F.col("in_term"), F.col("state"), F.dayofweek("date") == 1, first).alias("head"))


# -- guards ------------------------------------------------------------------------------------


@query("g3_balance_guard", ctes("busy") + """, m AS (SELECT day, sum(greatest("end" - start, 0)) AS m FROM busy WHERE day BETWEEN 1 AND 5 GROUP BY day) SELECT 'balance' AS guard, CASE WHEN min(m) / max(m) < 0.3 THEN 'forceable' ELSE 'ok' END AS level, round(min(m) / max(m), 3)::VARCHAR AS detail FROM m""")
def _(spark, sf):
    return guards.balance_guard(schedule.index_measure(X.busy(spark, sf)))


@query("g5_coordinate_guard", "SELECT 'coordinates' AS guard, CASE WHEN count(*) FILTER (WHERE c_custkey % 9 = 0) > count(*) * 0.1 THEN 'fatal' ELSE 'ok' END AS level, (count(*) FILTER (WHERE c_custkey % 9 = 0))::VARCHAR AS detail FROM customer")
def _(spark, sf):
    rows = T(spark, sf, "customer").select(F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("lat"), F.col("c_acctbal").alias("lon"))
    return guards.coordinate_guard(rows)


@query("g7_allowed_fields_guard", "SELECT 'field:o_totalprice' AS guard, 'fatal' AS level, count(*)::VARCHAR AS detail FROM orders UNION ALL SELECT 'code:o_orderstatus', CASE WHEN count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) > 0 THEN 'fatal' ELSE 'ok' END, (count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')))::VARCHAR FROM orders")
def _(spark, sf):
    return guards.allowed_fields_guard(T(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ("o_orderkey", "o_orderstatus"), {"o_orderstatus": ("F", "O")})


@query("g9_phantom_sentinel", "SELECT 'phantoms' AS guard, CASE WHEN count(*) FILTER (WHERE event_id % 50 = 0 AND event_id % 4 <> 0) > 0 OR count(*) FILTER (WHERE event_id % 4 = 0) = 0 THEN 'fatal' ELSE 'ok' END AS level, count(*) FILTER (WHERE event_id % 50 = 0 AND event_id % 4 <> 0) || '/' || count(*) FILTER (WHERE event_id % 4 = 0) AS detail FROM events")
def _(spark, sf):
    e = F.col("event_id")
    rows = T(spark, sf, "events").select("event_id", F.when(e % 50 == 0, 998).otherwise(40).alias("capacity"))
    return guards.phantom_sentinel(rows, e % 4 != 0, e % 4 == 0)


@query("g11_feed_coverage_guard", """WITH w AS (SELECT DISTINCT o_custkey AS feed, date_trunc('week', o_orderdate)::DATE AS week_start FROM orders), x AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY week_start) AS place, lag(week_start) OVER (PARTITION BY feed ORDER BY week_start) AS before FROM w)
 SELECT feed, week_start, CASE WHEN place = 1 AND week_start <> DATE '1995-01-02' THEN 'wrong-week' WHEN before IS NOT NULL AND week_start - before <> 7 THEN 'gap' WHEN day(week_start) % 5 = 0 THEN 'partial' WHEN day(week_start) % 3 = 0 THEN 'ids' END AS fault FROM x""")
def _(spark, sf):
    weeks = T(spark, sf, "orders").select(F.col("o_custkey").alias("feed"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("week_start")).distinct()
    ids = F.when(F.dayofmonth("week_start") % 3 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a")))
    weeks = weeks.withColumn("partial", F.dayofmonth("week_start") % 5 == 0).withColumn("resources", ids)
    expected = weeks.select("feed").distinct().select("feed", F.expr("date'1995-01-02'").alias("week"), F.array(F.lit("a"), F.lit("b")).alias("resources"))
    return calendar.feed_coverage(weeks, expected)


@query("g12_field_drift", "SELECT doc_id, CASE WHEN quality IS NULL AND toxic IS NULL THEN 'quality,toxic' WHEN quality IS NULL THEN 'quality' ELSE 'toxic' END AS lacking FROM (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN quality END AS quality, CASE WHEN doc_id % 5 <> 0 THEN toxic END AS toxic FROM labels) WHERE quality IS NULL OR toxic IS NULL")
def _(spark, sf):
    k = F.col("doc_id")
    rows = T(spark, sf, "labels").select("doc_id", F.when(k % 3 != 0, F.col("quality")).alias("quality"), F.when(k % 5 != 0, F.col("toxic")).alias("toxic"))
    return guards.field_drift(rows, ("quality", "toxic")).select("doc_id", "lacking")


@query("g16_term_bounds_guard", """WITH t AS (SELECT o_custkey AS term, CASE WHEN o_custkey % 2 = 0 THEN 'Spring' ELSE 'Autumn' END AS season, min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE - (o_custkey % 30)::INT AS last FROM orders GROUP BY o_custkey), c AS (SELECT o_custkey AS term, o_orderdate::DATE AS date FROM orders WHERE o_orderkey % 3 = 0),
 n AS (SELECT t.term, season, first, last, count(*) FILTER (WHERE date BETWEEN first AND last) AS inside, count(*) FILTER (WHERE date < first OR date > last) AS outside FROM t LEFT JOIN c USING (term) GROUP BY ALL)
 SELECT term, inside, outside, CASE WHEN outside > 0 THEN 'outside' WHEN inside < CASE season WHEN 'Spring' THEN 2 ELSE 1 END THEN 'few' WHEN inside > CASE season WHEN 'Spring' THEN 4 ELSE 3 END THEN 'many' WHEN term % 7 = 0 THEN 'exams' END AS fault FROM n""")
def _(spark, sf):
    o = T(spark, sf, "orders").select(F.col("o_custkey").alias("term"), "o_orderkey", F.to_date("o_orderdate").alias("date"))
    k = F.col("term")
    terms = o.groupBy("term").agg(F.min("date").alias("first"), F.max("date").alias("last")).withColumn("last", F.date_sub("last", (k % 30).cast("int"))).withColumn("season", F.when(k % 2 == 0, "Spring").otherwise("Autumn"))
    terms = terms.withColumn("exams_first", F.date_add("last", F.when(k % 7 == 0, 0).otherwise(3)))
    return calendar.term_bounds_guard(terms, o.where("o_orderkey % 3 = 0").select("term", "date"), {"Spring": (2, 4), "Autumn": (1, 3)})


@query("g17_bucket_guard", "SELECT 'buckets:source' AS guard, CASE WHEN count(DISTINCT source) <= 1 OR count(*) FILTER (WHERE source = 'src0') = 0 THEN 'fatal' ELSE 'ok' END AS level, count(DISTINCT source)::VARCHAR AS detail FROM documents")
def _(spark, sf):
    return guards.bucket_guard(T(spark, sf, "documents"), "source", "src0")


# -- graph -------------------------------------------------------------------------------------


@query("n1_segments_to_graph", """WITH p AS (SELECT l_orderkey AS line, l_linenumber * 1000000000::BIGINT + l_partkey * 1000 + l_suppkey AS seq, (l_suppkey % 50)::DOUBLE + l_linenumber % 3 * 0.1::DOUBLE AS x, (l_partkey % 40)::DOUBLE AS y FROM lineitem),
 n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM p WINDOW w AS (PARTITION BY line ORDER BY seq)), g AS (SELECT floor(x / 0.5 + 0.5)::BIGINT AS gx, floor(y / 0.5 + 0.5)::BIGINT AS gy, floor(nx / 0.5 + 0.5)::BIGINT AS hx, floor(ny / 0.5 + 0.5)::BIGINT AS hy, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS w FROM n WHERE nx IS NOT NULL),
 o AS (SELECT CASE WHEN (gx, gy) < (hx, hy) THEN [gx, gy, hx, hy] ELSE [hx, hy, gx, gy] END AS k, w FROM g WHERE gx <> hx OR gy <> hy) SELECT k[1] AS ax, k[2] AS ay, k[3] AS bx, k[4] AS by, round(min(w), 6) AS w FROM o GROUP BY k""")
def _(spark, sf):
    points = T(spark, sf, "lineitem").select(F.col("l_orderkey").alias("line"), (F.col("l_linenumber") * F.lit(1000000000).cast("long") + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("seq"), ((F.col("l_suppkey") % 50).cast("double") + F.col("l_linenumber") % 3 * 0.1).alias("x"), (F.col("l_partkey") % 40).cast("double").alias("y"))
    return graph.segments_to_graph(points).withColumn("w", F.round("w", 6))


@query("n2_largest_component", ctes("edges").replace("WITH ", "WITH RECURSIVE ") + ", r(node, o) AS (SELECT src, src FROM edges UNION SELECT e.dst, r.o FROM r JOIN edges e ON e.src = r.node), l AS (SELECT node, min(o) AS label FROM r GROUP BY node), b AS (SELECT label FROM l GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) SELECT node, label FROM l JOIN b USING (label)")
def _(spark, sf):
    return graph.largest_component(X.edges(spark, sf))


JUNCTIONS = ctes("edges").replace("WITH ", "WITH RECURSIVE ") + ", j AS (SELECT src AS node FROM edges GROUP BY src HAVING count(*) <> 2)"


@query("n3_contract_degree2", JUNCTIONS + """, r(start, prev, cur, w) AS (SELECT src, src, dst, w FROM edges WHERE src IN (SELECT node FROM j)
 UNION ALL SELECT r.start, r.cur, e.dst, r.w + e.w FROM r JOIN edges e ON e.src = r.cur AND e.dst <> r.prev WHERE r.cur NOT IN (SELECT node FROM j))
 SELECT start AS src, cur AS dst, min(w)::BIGINT AS w FROM r WHERE cur IN (SELECT node FROM j) AND start <> cur GROUP BY ALL""")
def _(spark, sf):
    return graph.contract_degree2(X.edges(spark, sf))


@query("n3_junction_distances", JUNCTIONS + ", r(source, node, dist) AS (SELECT node, node, 0 FROM j UNION SELECT r.source, e.dst, r.dist + e.w FROM r JOIN edges e ON e.src = r.node WHERE r.dist + e.w <= 900) SELECT source, node, min(dist)::BIGINT AS dist FROM r JOIN j USING (node) GROUP BY ALL")
def _(spark, sf):
    """Folding leaves distances between junctions as they are."""
    e = X.edges(spark, sf)
    junctions = e.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where("n <> 2").select(F.col("src").alias("node"))
    sources = junctions.select(F.col("node").alias("source"), "node", F.lit(0).cast("long").alias("cost"))
    return graph.bounded_distances(graph.contract_degree2(e), sources, 900).join(junctions, "node", "left_semi").select("source", "node", "dist")


@query("n3_longest_edge", JUNCTIONS + """, r(start, first, prev, cur, w, run, cuts) AS (SELECT src, dst, src, dst, w, w, []::BIGINT[] FROM edges WHERE src IN (SELECT node FROM j)
 UNION ALL SELECT r.start, r.first, r.cur, e.dst, r.w + e.w, CASE WHEN r.run + e.w > 300 THEN e.w ELSE r.run + e.w END, CASE WHEN r.run + e.w > 300 THEN list_append(r.cuts, r.cur) ELSE r.cuts END
  FROM r JOIN edges e ON e.src = r.cur AND e.dst <> r.prev WHERE r.cur NOT IN (SELECT node FROM j))
 SELECT DISTINCT unnest(cuts) AS node FROM r WHERE cur IN (SELECT node FROM j) AND (start, first) < (cur, prev)""")
def _(spark, sf):
    """Where runs are cut so that no folded edge is longer than 300."""
    return graph.pins(X.edges(spark, sf), 300)


WALKS = ctes("edges").replace("WITH ", "WITH RECURSIVE ") + ", " + NODES + """, o AS (SELECT s_suppkey AS source, ((s_suppkey * 91) % 7000)::DOUBLE AS x, ((s_suppkey * 53) % 1500)::DOUBLE AS y FROM supplier),
 d AS (SELECT c_nationkey AS place_id, ((c_custkey * 61) % 6500)::DOUBLE AS x, ((c_custkey * 29) % 1800)::DOUBLE AS y FROM customer WHERE c_custkey % 5 = 0),
 os AS (SELECT source, node, sqrt((o.x - n.x) * (o.x - n.x) + (o.y - n.y) * (o.y - n.y)) AS leg FROM o JOIN nodes n ON n.x BETWEEN o.x - 150 AND o.x + 150 AND n.y BETWEEN o.y - 150 AND o.y + 150 WHERE leg <= 150 QUALIFY row_number() OVER (PARTITION BY source ORDER BY leg, node) = 1),
 ds AS (SELECT place_id, node, sqrt((d.x - n.x) * (d.x - n.x) + (d.y - n.y) * (d.y - n.y)) AS leg FROM (SELECT DISTINCT * FROM d) d JOIN nodes n ON n.x BETWEEN d.x - 150 AND d.x + 150 AND n.y BETWEEN d.y - 150 AND d.y + 150 WHERE leg <= 150 QUALIFY row_number() OVER (PARTITION BY place_id, d.x, d.y ORDER BY leg, node) = 1),
 r(source, node, dist) AS (SELECT source, node, leg FROM os UNION SELECT r.source, e.dst, r.dist + e.w FROM r JOIN edges e ON e.src = r.node WHERE r.dist + e.w <= 700),
 best AS (SELECT source, node, min(dist) AS dist FROM r GROUP BY ALL), routed AS (SELECT source, place_id, min(dist + leg) AS routed FROM best JOIN ds USING (node) GROUP BY ALL),
 walks AS (SELECT o.source, d.place_id, any_value(routed) AS routed, min(sqrt((d.x - o.x) * (d.x - o.x) + (d.y - o.y) * (d.y - o.y))) AS straight,
   CASE WHEN any_value(routed) IS NOT NULL THEN 'routed' WHEN o.source IN (SELECT source FROM os) AND d.place_id IN (SELECT place_id FROM ds) THEN 'beyond' ELSE 'off-graph' END AS how
   FROM o CROSS JOIN d LEFT JOIN routed USING (source, place_id) GROUP BY o.source, d.place_id)"""


def walks(spark, sf) -> DataFrame:
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    origins = T(spark, sf, "supplier").select(k.alias("source"), (k * 91 % 7000).cast("double").alias("x"), (k * 53 % 1500).cast("double").alias("y"))
    doors = T(spark, sf, "customer").where("c_custkey % 5 = 0").select(F.col("c_nationkey").alias("place_id"), (c * 61 % 6500).cast("double").alias("x"), (c * 29 % 1800).cast("double").alias("y"))
    return graph.routed_walks(origins, doors, nodes(spark, sf), X.edges(spark, sf), 700)


@query("n6_routed_walks", WALKS + " SELECT source, place_id, round(routed, 6) AS routed, round(straight, 6) AS straight, round(coalesce(routed, straight * 1.3::DOUBLE), 6) AS metres, how FROM walks")
def _(spark, sf):
    """Origins and doors as coordinates; a row for each pair, off the graph and beyond the ceiling too."""
    return walks(spark, sf).select("source", "place_id", *[F.round(x, 6).alias(x) for x in ("routed", "straight", "metres")], "how")


@query("a30_circuity", WALKS + ", q AS (SELECT source, routed / straight AS ratio FROM walks WHERE routed IS NOT NULL AND straight > 0) SELECT source, count(*) AS n, round(avg(ratio), 9) AS mean, round(quantile_cont(ratio, 0.5), 9) AS median, round(quantile_cont(ratio, 0.9), 9) AS p90 FROM q GROUP BY source")
def _(spark, sf):
    """Over the walks that n6 routes."""
    return features.circuity(walks(spark, sf).where("routed is not null"))


