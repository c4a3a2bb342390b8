"""Graph, pairing, inversions, text readers and propagation on rows made by hand, against plain versions."""

import datetime
import heapq
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import calendar, graph, order, places, reconcile, schedule


def dijkstra(edges, sources, ceiling):
    adj = defaultdict(list)
    for a, b, w in edges:
        adj[a].append((b, w))
    out = {}
    for s, node, cost in sources:
        heap, seen = [(cost, node)], {}
        while heap:
            d, n = heapq.heappop(heap)
            if n in seen or d > ceiling:
                continue
            seen[n] = d
            for m, w in adj[n]:
                heapq.heappush(heap, (d + w, m))
        for n, d in seen.items():
            out[(s, n)] = min(d, out.get((s, n), d))
    return out


def graph_of(spark, edges):
    return spark.createDataFrame([(a, b, w) for a, b, w in edges] + [(b, a, w) for a, b, w in edges], "src long, dst long, w long")


@pytest.mark.parametrize("width", [None, 11])
def test_bands_give_shortest_distances(spark, width):
    """Weights from 0, so that a band's own rows are relaxed too; a source without edges; one beyond the ceiling."""
    rng = random.Random(width)
    edges = [(rng.randrange(40), rng.randrange(40), rng.choice([0, 3, 9, 30]) if width else rng.choice([9, 12, 30])) for _ in range(70)]
    sources = [(1, 3, 0), (1, 5, 4), (2, 9, 0), (3, 999, 2), (4, 7, 500)]
    got = graph.bounded_distances(graph_of(spark, edges), spark.createDataFrame(sources, "source long, node long, cost long"), 40, width)
    want = dijkstra([e for a, b, w in edges for e in ((a, b, w), (b, a, w))], sources, 40)
    assert {(r["source"], r["node"]): r["dist"] for r in got.collect()} == want


def test_nearest_node_at_any_distance(spark):
    rng = random.Random(4)
    nodes = [(i, rng.uniform(-300, 300), rng.uniform(-300, 300)) for i in range(60)] + [(100, 90000.0, 90000.0), (101, None, 1.0)]
    points = [(i, rng.uniform(-400, 400), rng.uniform(-400, 400)) for i in range(40)] + [(50, 60000.0, 60000.0), (51, -50000.0, 10.0), (52, 60000.0, 60000.0), (53, None, 0.0)]
    p, n = spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(nodes, "node long, x double, y double")
    got = {r["id"]: (r["node"], r["metres"]) for r in graph.nearest_node(p, n, None).collect()}
    assert got[53] == (None, None)
    for i, x, y in points[:-1]:
        d, node = min((((x - a) ** 2 + (y - b) ** 2) ** 0.5, k) for k, a, b in nodes if a is not None)
        assert got[i][0] == node and abs(got[i][1] - d) < 1e-6
    assert graph.nearest_node(p, n.where("node < 0"), None).where("node is not null").count() == 0


def test_walks_snap_and_fall_back(spark):
    edges = graph_of(spark, [(1, 2, 100), (2, 3, 100), (8, 9, 50)])
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 200.0, 0.0), (8, 5000.0, 0.0), (9, 5050.0, 0.0)], "node long, x double, y double")
    origins = spark.createDataFrame([(1, 0.0, 30.0), (2, 2500.0, 0.0)], "source long, x double, y double")
    doors = spark.createDataFrame([(1, 200.0, 10.0), (1, 100.0, 200.0), (2, 5050.0, 5.0), (3, 9000.0, 9000.0)], "place_id long, x double, y double")
    got = {(r["source"], r["place_id"]): (r["how"], r["routed"], round(r["metres"], 3)) for r in graph.routed_walks(origins, doors, nodes, edges, 1000).collect()}
    assert got[(1, 1)] == ("routed", 240.0, 240.0)
    assert got[(1, 2)][0] == "beyond" and got[(1, 3)][0] == "off-graph" and got[(2, 1)][0] == "off-graph"
    assert got[(1, 2)][2] == round(1.3 * (5050**2 + 25**2) ** 0.5, 3)
    assert len(got) == 6


def test_contraction_folds_runs_and_cuts_long_ones(spark):
    chain = [(i, i + 1, 10) for i in range(100, 160)]
    ring = [(i, i + 1, 5) for i in range(300, 310)] + [(310, 300, 5)]
    loop = [(100, 400, 5), (400, 401, 5), (401, 100, 5)]
    edges = graph_of(spark, chain + ring + loop + [(100, 200, 7), (160, 201, 7)])
    got = {(r["src"], r["dst"]): r["w"] for r in graph.contract_degree2(edges).collect()}
    # 160 has degree 2 as well, so the run goes from 100 to 201; the ring and the loop leave nothing
    assert got == {(100, 201): 607, (201, 100): 607, (100, 200): 7, (200, 100): 7}
    folded = {(r["src"], r["dst"]): r["w"] for r in graph.contract_degree2(edges.where("src < 250 and dst < 250"), longest=100).collect()}
    assert max(folded.values()) <= 100
    at, total, seen = 200, 0, {200}
    while at != 201:  # without its loop 100 is folded too: along the cuts from end to end
        at, step = next((b, w) for (a, b), w in folded.items() if a == at and b not in seen)
        seen.add(at)
        total += step
    assert total == 614 and len(seen) == 8


def plain_pairs(left, right, tolerance):
    ld, rd = {d for d, _ in left}, {d for d, _ in right}
    lo, ro = [(d, s) for d, s in left if d not in rd], [(d, s) for d, s in right if d not in ld]
    cand = sorted((abs((a - b).days), a, b) for a, s in lo for b, t in ro if s == t and abs((a - b).days) <= tolerance)
    used, out = set(), set()
    for g, a, b in cand:
        if ("l", a) not in used and ("r", b) not in used:
            used |= {("l", a), ("r", b)}
            out.add((a, b, g))
    return out


def days(spark, rows):
    return spark.createDataFrame([("k", d, s) for d, s in rows], "key string, date date, state string")


def test_a_thousand_alternating_days_give_as_many_pairs(spark):
    start = datetime.date(2020, 1, 1)
    left = [(start + datetime.timedelta(2 * i), "closed") for i in range(1000)]
    right = [(start + datetime.timedelta(2 * i + 1), "closed") for i in range(1000)]
    got = calendar.slid_dates(days(spark, left), days(spark, right), 3)
    assert got.where("gap = 1").count() == 1000 and got.count() == 1000


def test_pairs_are_those_taken_one_by_one(spark):
    rng = random.Random(9)
    start = datetime.date(2026, 1, 1)
    for tolerance in (1, 4):
        some = lambda: sorted({start + datetime.timedelta(d) for d in rng.sample(range(90), 35)})
        left, right = [(d, rng.choice("ab")) for d in some()], [(d, rng.choice("ab")) for d in some()]
        got = {(r["left_date"], r["right_date"], r["gap"]) for r in calendar.slid_dates(days(spark, left), days(spark, right), tolerance).where("gap is not null").collect()}
        assert got == plain_pairs(left, right, tolerance)


def test_inversions_by_blocks_are_those_of_all_pairs(spark):
    rng = random.Random(2)
    rows = [("g%d" % (i % 3), i, rng.choice([None, *range(12)]), rng.choice([0.5, *range(8)])) for i in range(300)] + [("hot", i, rng.randrange(50), rng.choice([1, 1, 1, rng.random()])) for i in range(200)] + [("one", 1, 1, 1)]
    df = spark.createDataFrame([(g, k, a, float(b)) for g, k, a, b in rows], "g string, k long, a long, b double")
    got = {r["g"]: (r["pairs"], r["flipped"]) for r in reconcile.order_inversions(df, "g", "k", "a", "b", block=16).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        flips = sum((x[2] - y[2]) * (x[3] - y[3]) < 0 for i, x in enumerate(own) for y in own[:i] if x[2] is not None and y[2] is not None)
        if len(own) > 1:
            want[g] = (len(own) * (len(own) - 1) // 2, flips)
    assert got == want
    assert reconcile.inversions(np.array([3, 1, 2, 2, 0])) == 7


def test_rows_before_sums_by_group_in_order(spark):
    rows = [(g, v, w) for g in ("a", None, "b") for v, w in ((3, 5), (1, 2), (2, 0), (9, 1))]
    got = order.rows_before(spark.createDataFrame(rows, "g string, v int, w int").repartition(4), ["v"], ["g"], F.col("w")).collect()
    assert {(r["g"], r["v"]): r["before"] for r in got} == {(g, v): n for g in ("a", None, "b") for v, n in ((1, 0), (2, 2), (3, 2), (9, 7))}


def test_lines_of_dates(spark):
    D = datetime.date
    cases = {
        "December 17, 2026-January 9, 2027": ([(D(2026, 12, 17), D(2027, 1, 9))], None),
        "Closed November 28 – January 3, 2027": ([(D(2026, 11, 28), D(2027, 1, 3))], None),
        "March 12-20, 2027": ([(D(2027, 3, 12), D(2027, 3, 20))], None),
        "New Year's Day (January 1, 2027) and may 31, 2027": ([(D(2027, 1, 1), D(2027, 1, 1)), (D(2027, 5, 31), D(2027, 5, 31))], None),
        "November 26-27, 2026, 8 p.m. close on November 25": ([(D(2026, 11, 26), D(2026, 11, 27))], D(2026, 11, 25)),
        "Monday, June 3": ([], None),
        "February 30, 2026": ([], None),
        "": ([], None),
        None: (None, None),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    for r in places.dated_lines(df, "t").collect():
        want = cases[r["t"]]
        assert ([tuple(x) for x in r["ranges"]] if r["ranges"] is not None else None, r["early"]) == want, r
    got = places.date_ranges(spark.createDataFrame([(1, "May 3-4, 2026"), (2, "x")], "k int, t string"), "t", "k").collect()
    assert [(r["k"], r["first"], r["last"], r["early"]) for r in got] == [(1, D(2026, 5, 3), D(2026, 5, 4), None)]


def test_titles_ranges_cells_and_halves(spark):
    one = lambda f, t: spark.createDataFrame([(t,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]
    assert tuple(one(places.title_parts, "Old  (West) Hall (OWH) | 12 High St (rear)")) == ("Old (West) Hall", "OWH", "12 High St (rear)")
    assert tuple(one(places.title_parts, "Lab (L1)")) == ("Lab", "L1", None)
    assert one(places.title_parts, "Hall (west)") is None and one(places.title_parts, "Hall") is None and one(places.title_parts, None) is None
    span = lambda t, over=False: tuple(one(lambda c: places.range_to_span(c, over), t))
    assert span("7am-10pm") == (420, 1320, None) and span("7:30 a.m. to 12 a.m.") == (450, 1440, None) and span("Closed.") == (None, None, None)
    assert span("8am—9pm—10pm")[2] == "separator" and span("8-9pm")[2] == "open" and span("8pm-7am")[2] == "order" and span("8pm-7am", True) == (1200, 1860, None) and span("")[2] == "empty"
    assert one(places.slash_halves, "BO0410/420") == ["BO0410", "BO0420"] and one(places.slash_halves, "FL2125/35") == ["FL2125", "FL2135"]
    assert one(places.slash_halves, "A1/23") == ["A1", "A23"] and one(places.slash_halves, "AB/12") is None and one(places.slash_halves, "A12/") is None and one(places.slash_halves, "A12") is None
    cells = [("Monday 12/14",), ("Tues, Dec. 15",), ("Friday December 18, 2026",), ("Wed Dec 16, 2025",), ("Sunday 12/13",), ("Monday Foo 3",), ("Mon 13/40",)]
    got = calendar.exam_dates_in_cells(spark.createDataFrame([(1, c) for (c,) in cells], "k int, c string"), "k", "c", F.lit(2026)).first()
    assert (str(got["first"]), str(got["last"]), got["days"]) == ("2026-12-14", "2026-12-18", 3)


def test_propagation_is_idempotent_and_merges(spark):
    rows = [("P", 1, 60, 120, "a"), ("N", 1, 100, 180, "b"), ("S", 1, 300, 360, "c"), ("S", 1, 360, 400, "c")]
    busy = spark.createDataFrame(rows, "resource_id string, day int, start int, end int, label string")
    halves = spark.createDataFrame([("P", "N"), ("P", "S")], "parent string, child string")
    once = schedule.propagate_groups(busy, halves)
    twice = schedule.propagate_groups(once, halves)
    as_set = lambda df: sorted(map(repr, df.collect()))
    assert as_set(once) == as_set(twice)
    got = {(r["resource_id"], r["start"], r["end"], r["label"]) for r in once.where("not own").collect()}
    assert got == {("P", 60, 180, None), ("P", 300, 400, "c"), ("N", 60, 180, None), ("S", 60, 120, "a"), ("S", 300, 400, "c")}


def test_clashing_keys_are_fatal_and_reported(spark):
    dim = spark.createDataFrame([("07",), ("7",), ("8",)], "key string")
    df = spark.createDataFrame([("0008", None), ("x", "8")], "a string, b string")
    assert [r["matched"] for r in reconcile.fallback_key_join(df, dim.where("key = '8'"), "a", "b", "key").collect()] == ["8", "8"]
    assert [tuple(r) for r in reconcile.key_clashes(dim, "key").collect()] == [("7", ["07", "7"])]
    with pytest.raises(Exception, match="leading zeros"):
        reconcile.fallback_key_join(spark.createDataFrame([("7", None)], "a string, b string"), dim, "a", "b", "key").collect()
    cells = spark.createDataFrame([(1, None), (2, 5.0), (3, None)], "k int, v double")
    over = spark.createDataFrame([(1, 9.0), (2, 9.0), (7, 1.0)], "k int, value double")
    assert tuple(reconcile.override_report(cells, over, ["k"], "v").first()) == (1, 1, 1, 1, "fatal")
    src = spark.createDataFrame([("1010000", "0800-0855"), ("x", "0800-0855"), (None, None), ("1111111", "8-9")], "pattern string, time string")
    assert tuple(reconcile.source_counts(src).first()) == (1, 3, 2)
