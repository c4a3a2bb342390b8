from datetime import date

import pytest
from pyspark.sql import functions as F

from lacuna.functions import scalars as S
from lacuna.operators import graph, intervals, rank, reconcile, schedule
from lacuna.sources import readers


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_gaps_of_a_day_with_a_class_and_an_event(spark):
    busy = spark.createDataFrame([("T", 540, 600, "class"), ("T", 610, 660, "event")], "r string, start int, end int, label string")
    windows = spark.createDataFrame([("T", 540, 720), ("U", 540, 720), ("V", 700, 700)], "r string, open int, close int")
    assert rows(intervals.free_gaps(busy, windows, ["r"]), "r", "gap_start", "gap_end") == [("T", 600, 610), ("T", 660, 720), ("U", 540, 720)]


def test_merge_touching_contained_and_mixed(spark):
    busy = spark.createDataFrame(
        [("a", 0, 10, "x"), ("a", 10, 20, "x"), ("a", 12, 15, "x"), ("a", 35, 40, "x"), ("a", 36, 50, None), ("b", 5, 6, None)], "r string, start int, end int, label string"
    )
    merged = intervals.merge_intervals(busy, ["r"])
    assert [(r.r, r.start, r.end, r.label, r.rows, r.dropped) for r in merged.orderBy("r", "start").collect()] == [("a", 0, 20, "x", 3, 1), ("a", 35, 50, None, 2, 0), ("b", 5, 6, None, 1, 0)]
    strict = intervals.merge_intervals(busy, ["r"], strict=True)
    assert rows(strict, "r", "start", "end") == [("a", 0, 10), ("a", 10, 20), ("a", 35, 50), ("b", 5, 6)]
    again = intervals.merge_intervals(merged.select("r", "start", "end", "label"), ["r"])
    assert rows(again, "r", "start", "end") == rows(merged, "r", "start", "end")


def test_repair_runs_to_the_end_of_the_day(spark):
    df = spark.createDataFrame([(600, 500), (None, 3), (1, 2)], "start int, end int")
    assert rows(intervals.repair_intervals(df), "start", "end", "malformed") == [(1, 2, False), (600, 1440, True)]


def test_busy_and_free_minutes_fill_the_window(spark):
    busy = spark.createDataFrame([(i % 5, (i * 37) % 1300, (i * 37) % 1300 + 5 + i % 90, "l") for i in range(80)], "r long, start int, end int, label string")
    windows = spark.createDataFrame([(i, 480, 1320) for i in range(5)], "r long, open int, close int")
    free = intervals.free_gaps(busy, windows, ["r"]).groupBy("r").agg(F.sum(F.col("gap_end") - F.col("gap_start")).alias("f"))
    taken = intervals.union_minutes(busy, ["r"], 480, 1320)
    assert {r.f + r.minutes for r in free.join(taken, "r").collect()} == {840}


@pytest.mark.parametrize("text, minutes", [("8:00 am", 480), ("12:05 am", 5), ("12:00 pm", 720), ("7pm", 1140), ("25:00 am", None), ("", None), ("noon", None)])
def test_clock(spark, text, minutes):
    assert spark.range(1).select(S.clock_to_minutes(F.lit(text)).alias("m")).first().m == minutes


def test_closing_at_midnight(spark):
    assert spark.range(1).select(S.clock_to_minutes(F.lit("12am"), is_close=True).alias("m")).first().m == 1440


def test_short_name_and_html(spark):
    got = spark.range(1).select(S.short_name(F.lit("A rather long building - West wing")).alias("a"), S.short_name(F.lit("Hall - B")).alias("b"), S.html_text(F.lit("<b>a</b><br>&lt;b&gt; &amp;lt;")).alias("c")).first()
    assert (got.a, got.b, got.c) == ("West wing", "Hall - B", "a <b> &lt;")


def test_pick_gap_prefers_open_then_earliest_then_longest(spark):
    gaps = spark.createDataFrame(
        [(1, 600, 5, 60, 590, 640), (1, 600, 5, 60, 700, 800), (2, 600, 5, 60, 590, 700), (2, 600, 5, 60, 800, 1300), (3, 600, 5, 300, 610, 700), (3, 600, 5, 300, 800, 990)],
        "k long, now int, walk int, need int, gap_start int, gap_end int",
    )
    assert rows(rank.pick_gap(gaps, ["k"]), "k", "gap_start", "meets", "wait") == [(1, 700, True, 95), (2, 590, True, 0), (3, 800, False, 195)]


def test_tiers_keep_unknown_apart(spark):
    df = spark.createDataFrame([(True, 0, True, None), (True, 0, False, True), (True, 5, True, False), (False, 0, True, True), (False, 0, False, None)], "known boolean, wait int, meets boolean, listed boolean")
    assert [r.t for r in df.select(S.tier_of(*[F.col(c) for c in df.columns]).alias("t")).collect()] == [0, 2, 5, 6, 8]


def test_funnel_counts_the_first_failure(spark):
    df = spark.createDataFrame([(None, "1", 1, 1, 2), ("ONLINE", "1", 1, 1, 2), ("R", "9", 1, 1, 2), ("R", "1", None, 1, 2), ("R", "1", 1, 2, 2), ("R", "1", 1, 1, 2)], "resource_id string, place_id string, day int, start int, end int")
    places = spark.createDataFrame([("1",)], "place_id string")
    got = {r.stage: r.rows for r in schedule.funnel_counts(schedule.funnel_stage(df, ["ONLINE"], places)).collect()}
    assert got == dict.fromkeys(["blankId", "pseudo", "unknownPlace", "noWeekday", "badTime", "usable"], 1)


def test_week_monday_sends_a_sunday_forward(spark):
    df = spark.createDataFrame([(date(2026, 8, 30),), (date(2026, 8, 31),), (date(2026, 9, 5),)], "d date")
    assert [r.m for r in df.select(S.week_monday(F.col("d")).alias("m")).collect()] == [date(2026, 8, 31)] * 3


def test_graph_of_a_tee_and_its_components(spark):
    lines = [(1, [(0, 0), (50, 0)]), (2, [(50, 0), (100, 0)]), (3, [(50, 0), (50, 50)]), (4, [(50.1, 50), (50, 100)])]
    points = spark.createDataFrame([(i, k, float(x), float(y)) for i, p in lines for k, (x, y) in enumerate(p)], "line long, seq int, x double, y double")
    assert graph.segments_to_graph(points).count() == 4
    edges = spark.createDataFrame([(a, b, 1) for a, b in [(1, 2), (2, 3), (5, 6), (7, 5), (9, 10)] for a, b in [(a, b), (b, a)]], "src long, dst long, w int")
    assert rows(graph.component_labels(edges), "node", "label") == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (7, 5), (9, 9), (10, 9)]
    assert rows(graph.largest_component(edges), "node") == [(1,), (2,), (3,)]


def test_bounded_distances_stop_at_the_ceiling(spark):
    edges = spark.createDataFrame([(1, 2, 5), (2, 3, 5), (1, 3, 20), (3, 4, 5)], "src long, dst long, w long")
    sources = spark.createDataFrame([(0, 1, 0)], "source long, node long, cost long")
    assert rows(graph.bounded_distances(edges, sources, 12), "node", "dist") == [(1, 0), (2, 5), (3, 10)]


def test_nearest_node_beats_a_cell_edge(spark):
    points = spark.createDataFrame([(1, 59.0, 0.0), (2, 5000.0, 0.0)], "id long, x double, y double")
    nodes = spark.createDataFrame([(7, 0.0, 0.0), (8, 61.0, 0.0)], "node long, x double, y double")
    assert {(r.id, r.node) for r in graph.nearest_node(points, nodes).collect()} == {(1, 8), (2, None)}


def test_keys_and_diffs(spark):
    a = spark.createDataFrame([("01",), ("2",), ("3",)], "key string")
    b = spark.createDataFrame([("1",), ("002",)], "key string")
    assert rows(reconcile.never_saw(a, b, "key"), "key") == [("3",)]
    assert {r.key: r.change for r in reconcile.list_diff(a, b, "key").collect()}["01"] == "left"


def test_calendar_text(spark):
    text = "BEGIN:VEVENT\nSUMMARY:No classes\\, fall\n  break\nDTSTART;VALUE=DATE:20261015\nDTEND;VALUE=DATE:20261017\nEND:VEVENT\nBEGIN:VEVENT\nSUMMARY:One\nDTSTART:20261101\nEND:VEVENT\n"
    got = rows(readers.calendar_events(spark.createDataFrame([(text,)], "t string"), "t"), "summary", "day")
    assert got == [("No classes, fall break", date(2026, 10, 15)), ("No classes, fall break", date(2026, 10, 16)), ("One", date(2026, 11, 1))]


def test_readers_of_nested_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data":{"courses":[{"subject":"CSE","sections":[{"classNumber":"1","meetings":[{"facilityId":"DL1","monday":true},{"facilityId":null}]}]}]}}\n')
    assert rows(readers.read_page_archive(spark, str(tmp_path / "a.json")).fillna(""), "subject", "classNumber", "facilityId") == [("CSE", "1", ""), ("CSE", "1", "DL1")]
    (tmp_path / "b.json").write_text('{"279": {"name": "Hall"}, "12": {"name": "Lab"}}')
    assert rows(readers.read_keyed_dim(spark, str(tmp_path / "b.json"), "name: string"), "id", "name") == [("12", "Lab"), ("279", "Hall")]


def test_entry_points():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80
