"""Queries for what goes with other queries' rows: counts, splits, reports and their other modes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import scalars as S
from lacuna.operators import graph, guards, intervals, rank, reports, schedule
from lacuna.plans import fixtures as X
from lacuna.plans.fixtures import ctes
from lacuna.plans.registry import ANSWERS, GAPS, ISLANDS, KEYS, LAST, SAFETY, TYPES, answered, classified, query, windows

T = X.table


@query("p7_repair_counts", ctes("busy") + 'SELECT resource_id, count(*) FILTER (WHERE event_id % 9 = 0) AS dropped, count(*) FILTER (WHERE event_id % 9 <> 0 AND "end" <= start) AS malformed FROM busy GROUP BY 1')
def _(spark, sf):
    rows = X.busy(spark, sf).withColumn("end", F.when(F.col("event_id") % 9 != 0, F.col("end")))
    return reports.repair_counts(rows, ["resource_id"])


@query("p4_visibility_flags", SAFETY + " SELECT resource_id, visibility, coalesce(listed, false) AS ga FROM v WHERE visibility IS NOT NULL")
def _(spark, sf):
    return classified(spark, sf).where("visibility is not null").select("resource_id", "visibility", F.coalesce("listed", F.lit(False)).alias("ga"))


@query("j1_unresolved_places", "SELECT c_nationkey, count(*) AS rows FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) GROUP BY 1")
def _(spark, sf):
    return reports.unresolved(T(spark, sf, "customer"), T(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey")


@query("a4_places", ctes("busy", "resources") + "SELECT count(DISTINCT place_id) AS places, count(DISTINCT resource_id) AS resources FROM busy JOIN resources USING (resource_id)")
def _(spark, sf):
    rows = X.busy(spark, sf).select("resource_id").distinct().join(X.resources(spark, sf), "resource_id")
    return rows.agg(F.countDistinct("place_id").alias("places"), F.countDistinct("resource_id").alias("resources"))


@query("a9_tally_shown", ANSWERS + """, d AS (SELECT *, row_number() OVER (PARTITION BY ask_id, place_id ORDER BY place) - 1 AS depth FROM ranked WHERE walk <= 6), p AS (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY depth, place) AS position, count(*) OVER (PARTITION BY ask_id) AS n, count(*) FILTER (WHERE depth = 0) OVER (PARTITION BY ask_id) AS n0 FROM d)
 SELECT ask_id, count(*) FILTER (WHERE meets AND wait = 0) AS meets, count(*) FILTER (WHERE NOT meets) AS shorter, count(*) FILTER (WHERE wait > 0) AS waiting, count(*) FILTER (WHERE known AND wait = 0) AS free, count(*) AS total FROM p WHERE position <= greatest(least(40, n0), least(10, n)) GROUP BY ask_id""")
def _(spark, sf):
    return answered(spark, sf, lambda a: rank.tally(rank.shape(a, TYPES, max_walk=6)))


@query("a11_overrun_allowed", LAST + " SELECT place_id, day, CASE WHEN open IS NULL THEN 'closed' ELSE 'after-close' END AS why, place_id % 4 = 1 AS allowed FROM l JOIN hours USING (place_id, day) WHERE open IS NULL OR last_end > close")
def _(spark, sf):
    over = schedule.overrun_check(schedule.last_end_by_place_day(X.busy(spark, sf), X.resources(spark, sf)), X.hours(spark, sf))
    return reports.flag_allowed(over, X.places(spark, sf).where("place_id % 4 = 1"), ["place_id"]).select("place_id", "day", "why", "allowed")


@query("a12_feed_types", ctes("busy") + "SELECT label, session_id AS type, count(*) AS rows, count(DISTINCT resource_id) AS resources FROM busy GROUP BY ALL")
def _(spark, sf):
    return X.busy(spark, sf).groupBy("label", F.col("session_id").alias("type")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("resource_id").alias("resources"))


@query("a12_parsed_of_requested", "SELECT count(*) AS requested, count(u) AS parsed, count(*) = count(u) AS complete FROM customer LEFT JOIN (SELECT DISTINCT user_id AS u FROM events) ON u = c_custkey")
def _(spark, sf):
    return reports.parsed_of_requested(T(spark, sf, "customer").select(F.col("c_custkey").alias("k")), T(spark, sf, "events").select(F.col("user_id").alias("k")), "k")


@query("a16_unknown_types", SAFETY + " SELECT type, count(*) AS rows, min(resource_id) AS example, 'unknown' AS what FROM v WHERE reason = 'type' GROUP BY type UNION ALL SELECT type, count(*), min(resource_id), 'listed-but-hidden' FROM v WHERE reason IS NOT NULL AND listed GROUP BY type")
def _(spark, sf):
    rows = classified(spark, sf)
    count = lambda df, what: df.groupBy("type").agg(F.count(F.lit(1)).alias("rows"), F.min("resource_id").alias("example")).withColumn("what", F.lit(what))
    return count(rows.where("reason = 'type'"), "unknown").unionByName(count(rows.where("reason is not null and listed"), "listed-but-hidden"))


@query("a17_uncovered_by_type", "SELECT source AS type, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT page_id FROM pages) GROUP BY 1")
def _(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", F.col("source").alias("type"))
    seen = T(spark, sf, "labels").select("doc_id").unionByName(T(spark, sf, "pages").select(F.col("page_id").alias("doc_id")))
    return d.join(seen.distinct(), "doc_id", "left_anti").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("a22_delta_p10", "SELECT round(quantile_cont(l_discount - l_tax, 0.1), 9) AS p10 FROM lineitem")
def _(spark, sf):
    return T(spark, sf, "lineitem").agg(F.round(F.percentile(F.col("l_discount") - F.col("l_tax"), 0.1), 9).alias("p10"))


@query("a25_unranked", ANSWERS + ", r AS (SELECT ask_id, count(*) AS ranked FROM answers GROUP BY 1), t AS (SELECT ask_id, count(*) AS near FROM near JOIN resources USING (place_id) GROUP BY 1) SELECT ask_id, near - coalesce(ranked, 0) AS unranked FROM t LEFT JOIN r USING (ask_id)")
def _(spark, sf):
    near = rank.ask_places(X.asks(spark, sf), X.places(spark, sf), 600.0)
    per = X.resources(spark, sf).groupBy("place_id").agg(F.count(F.lit(1)).alias("n"))
    total = near.join(per, "place_id").groupBy("ask_id").agg(F.sum("n").alias("near"))
    own = answered(spark, sf, lambda a: a.groupBy("ask_id").agg(F.count(F.lit(1)).alias("ranked")))
    return total.join(own, "ask_id", "left").select("ask_id", (F.col("near") - F.coalesce("ranked", F.lit(0))).alias("unranked"))


@query("a28_available_names", ANSWERS + " SELECT ask_id, name, string_agg(resource_id::VARCHAR, ',' ORDER BY resource_id) AS resources FROM answers JOIN places USING (place_id) WHERE known AND wait = 0 GROUP BY ask_id, name")
def _(spark, sf):
    def names(a: DataFrame) -> DataFrame:
        free = a.where("known and wait = 0").join(X.places(spark, sf).select("place_id", "name"), "place_id")
        return free.groupBy("ask_id", "name").agg(F.array_join(F.array_sort(F.collect_list("resource_id")).cast("array<string>"), ",").alias("resources"))

    return answered(spark, sf, names)


@query("w1_malformed", GAPS + """, f AS (SELECT resource_id, date, count(*) FILTER (WHERE malformed) AS malformed FROM fixed GROUP BY ALL), n AS (SELECT resource_id, date, count(*) AS gaps FROM gaps GROUP BY ALL) SELECT resource_id, date, malformed, coalesce(gaps, 0) AS gaps FROM f LEFT JOIN n USING (resource_id, date)""")
def _(spark, sf):
    rows = X.busy(spark, sf)
    wrong = intervals.repair_intervals(rows).groupBy(*KEYS).agg(F.count_if("malformed").alias("malformed"))
    gaps = intervals.free_gaps(rows, windows(spark, sf), KEYS).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("gaps"))
    return wrong.join(gaps, KEYS, "left").select(*KEYS, "malformed", F.coalesce("gaps", F.lit(0)).alias("gaps"))


@query("w9_day_edges", GAPS + "," + ISLANDS.format(src="clipped", op=">=") + """, t AS (SELECT resource_id, date, gap_start AS start, gap_end AS "end", CASE WHEN gap_end - gap_start < 20 THEN 'seam' ELSE 'free' END AS kind, 1 AS r FROM gaps UNION ALL SELECT resource_id, date, start, "end", 'busy', 1 FROM merged
 UNION ALL SELECT DISTINCT resource_id, date, 480, 480, 'edge', 0 FROM busy UNION ALL SELECT DISTINCT resource_id, date, 1320, 1320, 'edge', 2 FROM busy) SELECT resource_id, date, start, "end", kind, row_number() OVER (PARTITION BY resource_id, date ORDER BY start, r, "end") AS place FROM t""")
def _(spark, sf):
    return reports.day_edges(intervals.day_timeline(X.busy(spark, sf), windows(spark, sf), KEYS), windows(spark, sf), KEYS)


@query("w8_day_slots", ctes("busy") + """, s AS (SELECT resource_id, date, (start // 30) * 30 AS start, (start // 30) * 30 + 30 AS "end", bool_or(label = 'purchase') AS taken FROM busy GROUP BY 1, 2, 3, 4), z AS (SELECT *, max("end") OVER (PARTITION BY resource_id, date) AS last FROM s),
 f AS (SELECT *, CASE WHEN lag("end") OVER (PARTITION BY resource_id, date ORDER BY start) = start THEN 0 ELSE 1 END AS fresh FROM z WHERE NOT taken AND start >= 480), n AS (SELECT *, sum(fresh) OVER (PARTITION BY resource_id, date ORDER BY start) AS run FROM f),
 p AS (SELECT resource_id, date, any_value(last) AS last, min(start) AS start, max("end") AS "end" FROM n GROUP BY resource_id, date, run) SELECT resource_id, date, start, "end" FROM p WHERE start <= 600 AND "end" = last""")
def _(spark, sf):
    begin = (F.floor(F.col("start") / 30) * 30).cast("int")
    slots = X.busy(spark, sf).groupBy(*KEYS, begin.alias("start"), (begin + 30).alias("end")).agg(F.bool_or(F.col("label") == "purchase").alias("taken"))
    return reports.day_slots(slots, KEYS, 480, 120)


@query("u1_convergence", """WITH p AS (SELECT event_id % 6 AS pass, count(*) FILTER (WHERE event_id % 6 < 3 AND event_id % 5 = 0) AS a FROM events GROUP BY 1) SELECT pass, a AS added_with_room, pass >= 4 AS converged FROM p""")
def _(spark, sf):
    e = F.col("event_id")
    return reports.pass_convergence(T(spark, sf, "events").groupBy((e % 6).alias("pass")).agg(F.count_if((e % 6 < 3) & (e % 5 == 0)).alias("added_with_room")))


@query("u2_drift_counts", ctes("busy") + """, a AS (SELECT DISTINCT day, resource_id FROM busy WHERE event_id % 2 = 0), b AS (SELECT DISTINCT day, resource_id FROM busy WHERE event_id % 2 = 1), d AS (SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) SELECT change, count(*) AS pairs, count(DISTINCT resource_id) AS resources FROM d GROUP BY 1""")
def _(spark, sf):
    rows = X.busy(spark, sf)
    return reports.drift_counts(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ["day", "resource_id"], "resource_id")


@query("u3_departures", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' WHEN o_orderdate::DATE < DATE '1996-01-01' THEN 'expired' ELSE 'dropped-early' END AS reason FROM orders WHERE o_orderkey % 3 = 0")
def _(spark, sf):
    rows = T(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.to_date("o_orderdate")).alias("until"))
    return reports.departures(rows, rows.where("o_orderkey % 3 <> 0"), "o_orderkey", F.expr("date'1996-01-01'"))


@query("u9_verdict_tally", """WITH c AS (SELECT DISTINCT l_returnflag AS side, l_orderkey AS course, l_linenumber AS section, l_suppkey AS meeting, l_quantity AS value FROM lineitem), t AS (SELECT DISTINCT course, section, meeting, CASE WHEN course % 3 = 0 THEN value + 1 ELSE value END AS v FROM (SELECT course, section, meeting, min(value) AS value FROM c GROUP BY ALL) WHERE course % 5 <> 0 AND section <> 2 AND meeting % 4 <> 1)
 SELECT side, CASE WHEN value = v THEN 'confirmed' WHEN v IS NOT NULL THEN 'stale' WHEN EXISTS (SELECT 1 FROM t WHERE t.course = c.course AND t.section = c.section) THEN 'meeting-gone' WHEN EXISTS (SELECT 1 FROM t WHERE t.course = c.course) THEN 'section-gone' ELSE 'course-gone' END AS verdict, count(*) AS n FROM c LEFT JOIN t USING (course, section, meeting) GROUP BY ALL""")
def _(spark, sf):
    c = T(spark, sf, "lineitem").select(F.col("l_returnflag").alias("side"), F.col("l_orderkey").alias("course"), F.col("l_linenumber").alias("section"), F.col("l_suppkey").alias("meeting"), F.col("l_quantity").alias("value")).distinct()
    t = c.groupBy("course", "section", "meeting").agg(F.min("value").alias("value")).where("course % 5 <> 0 and section <> 2 and meeting % 4 <> 1")
    return reports.verdict_tally(c, t.withColumn("value", F.when(F.col("course") % 3 == 0, F.col("value") + 1).otherwise(F.col("value"))))


@query("u12_keep_first", "SELECT o_custkey, o_orderkey, count(*) OVER w AS copies, max(o_totalprice) OVER w - min(o_totalprice) OVER w > 1e-6 AS conflict FROM orders WINDOW w AS (PARTITION BY o_custkey) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def _(spark, sf):
    return reports.keep_first(T(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey", ["o_totalprice"]).drop("o_totalprice")


@query("f19_labels", "SELECT p_partkey, CASE WHEN m // 60 = 12 THEN 'noon' WHEN m // 60 = 0 THEN 'midnight' ELSE (m // 60 % 12) || CASE WHEN m < 720 THEN ' am' ELSE ' pm' END END AS label, trim(CASE WHEN m >= 120 THEN (m // 60) || ' hours ' WHEN m >= 60 THEN '1 hour ' ELSE '' END || CASE m % 60 WHEN 0 THEN '' WHEN 1 THEN '1 minute' ELSE m % 60 || ' minutes' END) AS spoken FROM (SELECT p_partkey, p_partkey % 1440 AS m FROM part)")
def _(spark, sf):
    m = F.col("p_partkey") % 1440
    return T(spark, sf, "part").select("p_partkey", reports.hour_label(m).alias("label"), reports.spoken_dur(m).alias("spoken"))


@query("f21_norm_keys", "SELECT p_partkey, 'AB' || p_partkey || 'C' AS norm, 'b-' || CASE WHEN p_partkey < 1000 THEN lpad(p_partkey::VARCHAR, 4, '0') ELSE p_partkey::VARCHAR END || 'x' AS padded FROM part")
def _(spark, sf):
    k = F.col("p_partkey").cast("string")
    return T(spark, sf, "part").select("p_partkey", S.norm_key(F.concat(F.lit("a-b 00"), k, F.lit(".c"))).alias("norm"), reports.pad_digits(F.concat(F.lit("b-"), k, F.lit("x"))).alias("padded"))


@query("f28_grid_back", "SELECT p_partkey, round(-83.03 + (p_partkey % 512 + 0.5) / 512 * (-83.0 + 83.03), 9) AS lon, round(40.01 - (p_partkey % 300 + 0.5) / 512 * (40.01 - 39.98), 9) AS lat FROM part".replace("-83.03 +", "-83.03::DOUBLE +").replace("40.01 -", "40.01::DOUBLE -", 1))
def _(spark, sf):
    k = F.col("p_partkey")
    at = reports.grid_back(k % 512, k % 300, -83.03, 39.98, -83.0, 40.01, 512)
    return T(spark, sf, "part").select("p_partkey", at.alias("g")).select("p_partkey", F.round("g.lon", 9).alias("lon"), F.round("g.lat", 9).alias("lat"))


@query("g2_subject_residue", "SELECT l_suppkey, count(*) FILTER (WHERE l_partkey % 10 = 3) AS failed, count(*) AS seen, CASE WHEN count(*) FILTER (WHERE l_partkey % 10 = 3) > 0.1 * count(*) AND count(*) FILTER (WHERE l_partkey % 10 = 3) >= 2 THEN 'fatal' ELSE 'ok' END AS level FROM lineitem GROUP BY 1")
def _(spark, sf):
    return reports.subject_residue(T(spark, sf, "lineitem"), F.col("l_partkey") % 10 == 3, "l_suppkey", 0.1)


@query("g13_ready_report", "WITH n AS (SELECT count(DISTINCT user_id) AS n FROM events), c AS (SELECT * FROM (VALUES (1, 100, false), (2, 10000, false), (3, 10000, true), (4, 10, true)) t(run, floor, previous)) SELECT run, CASE WHEN n < floor THEN CASE WHEN previous THEN 'refused' ELSE 'not-ready' END ELSE 'published' END AS state, (n < floor)::BIGINT AS fatal FROM n, c")
def _(spark, sf):
    """Runs with floors that the table meets or not, with and without a run before."""
    found = schedule.index_measure(X.busy(spark, sf))
    runs = []
    for run, floor, previous in ((1, 100, False), (2, 10_000, False), (3, 10_000, True), (4, 10, True)):
        report = guards.refusal_report([guards.count_guard(found, "resources", floor)])
        runs.append(reports.ready_report(report, F.lit(previous), F.col("fatal") > 0).select(F.lit(run).alias("run"), "state", "fatal"))
    return reduce(DataFrame.unionByName, runs)


@query("g15_expected_numbers", "SELECT c_custkey, c_custkey % 7 AS number, c_nationkey % 7 AS expected FROM customer WHERE c_custkey % 7 <> c_nationkey % 7")
def _(spark, sf):
    c = T(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 7).alias("number"))
    e = T(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") % 7).alias("number"))
    return reports.numbers_as_expected(c, e, "c_custkey")


@query("n7_graph_passes", ctes("edges").replace("WITH ", "WITH RECURSIVE ") + """, r(node, o) AS (SELECT src, src FROM edges UNION SELECT e.dst, r.o FROM r JOIN edges e ON e.src = r.node), l AS (SELECT node, min(o) AS label FROM r GROUP BY node), b AS (SELECT node FROM l WHERE label = (SELECT label FROM l GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)),
 big AS (SELECT * FROM edges WHERE src IN (SELECT node FROM b)), j AS (SELECT src AS node FROM big GROUP BY src HAVING count(*) <> 2),
 f(start, prev, cur, w) AS (SELECT src, src, dst, w FROM big WHERE src IN (SELECT node FROM j) UNION ALL SELECT f.start, f.cur, e.dst, f.w + e.w FROM f JOIN big e ON e.src = f.cur AND e.dst <> f.prev WHERE f.cur NOT IN (SELECT node FROM j)),
 folded AS (SELECT DISTINCT start AS src, cur AS dst FROM f WHERE cur IN (SELECT node FROM j) AND start <> cur)
 SELECT 'all' AS stage, count(DISTINCT src) AS nodes, count(*) FILTER (WHERE src < dst) AS edges FROM edges UNION ALL SELECT 'largest', count(DISTINCT src), count(*) FILTER (WHERE src < dst) FROM big UNION ALL SELECT 'contracted', count(DISTINCT src), count(*) FILTER (WHERE src < dst) FROM folded""")
def _(spark, sf):
    return graph.graph_passes(X.edges(spark, sf))
