"""Graphs whose tables stay out of the driver, fixes that wait in few entries of state."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from lacuna.operators import graph
from lacuna.streaming import fixes


def test_growing_tables_of_a_graph_are_not_broadcast(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    rnd, before = random.Random(7), store.executionsList().size()
    pairs = {(a, a + 1): 50 + a % 30 for a in range(0, 60) if a % 9} | {tuple(sorted(rnd.sample(range(60), 2))): 60 for _ in range(12)}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()] + [(b, a, w) for (a, b), w in pairs.items()], "src long, dst long, w long")
    junctions = edges.groupBy("src").count().where("count <> 2").select(F.col("src").alias("node"))
    far = graph.bounded_distances(graph.contract_degree2(edges), junctions.select(F.col("node").alias("source"), "node", F.lit(0).cast("long").alias("cost")), 400)
    got = {(r["source"], r["node"]): r["dist"] for r in far.join(junctions, "node", "left_semi").collect()}
    ran = store.executionsList()
    plans = [ran.apply(i).physicalPlanDescription().split("== Initial Plan")[0] for i in range(before, ran.size())]
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not [p for p in plans if "Broadcast" in p]
    ends = {r["node"] for r in junctions.collect()}
    near = {a: [] for a in range(61)}
    for (a, b), w in pairs.items():
        near[a].append((b, w)), near[b].append((a, w))
    want = {}
    for s in ends:
        best, front = {s: 0}, [s]
        while front:
            at = front.pop()
            for b, w in near[at]:
                if best[at] + w <= 400 and best[at] + w < best.get(b, 401):
                    best[b] = best[at] + w
                    front.append(b)
        want |= {(s, n): d for n, d in best.items() if n in ends}
    assert got == want


class State:
    """One user's state and timers, with each access counted as a message."""

    def __init__(self):
        self.entries, self.value, self.timers, self.messages = [], None, set(), 0

    def said(self, to):
        self.messages += 1
        return to

    def getListState(self, *_):
        return SimpleNamespace(appendValue=lambda v: self.said(self.entries.append(v)), get=lambda: self.said(iter(list(self.entries))), clear=lambda: self.said(self.entries.clear()))

    def getValueState(self, *_):
        return SimpleNamespace(get=lambda: self.said(self.value), exists=lambda: self.said(self.value is not None), update=lambda v: self.said(setattr(self, "value", v)), clear=lambda: self.said(setattr(self, "value", None)))

    def listTimers(self):
        return self.said(iter(sorted(self.timers)))

    def registerTimer(self, at):
        self.said(self.timers.add(at))

    def deleteTimer(self, at):
        self.said(self.timers.discard(at))

    def expire(self, throttle, watermark):
        out = []
        while due := [t for t in self.timers if t <= watermark]:
            out += [r for pdf in throttle.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), None) for r in pdf["event_id"]]
            self.timers.discard(min(due))
        return out


def test_a_batch_of_fixes_is_one_entry_of_state():
    state = State()
    throttle = fixes.Throttle(40.0, 15, 10_000)
    throttle.init(state)
    rows = [(1, e, 100 + e * 10, e * 25.0, 0.0) for e in range(600)]
    batch = lambda part: list(throttle.handleInputRows((1,), iter([pd.DataFrame(part, columns=["user_id", "event_id", "at", "x", "y"])]), None))
    batch(rows[300:][::-1]), batch(rows[:300])  # the later ones first
    assert len(state.entries) == 2 and state.messages < 10 and state.timers == {100_001}
    assert state.expire(throttle, 1_100_000) == list(range(0, 100, 2))  # those from then on wait
    assert sum(len(e[0]) for e in state.entries) == 500 and state.timers == {1_100_001}
    assert state.expire(throttle, 90_000_000) == list(range(100, 600, 2)) and not state.entries and not state.timers and state.value is None
    assert state.messages < 30


def test_a_far_spot_meets_few_nodes(spark, monkeypatch):
    rnd = random.Random(11)
    places = {i: (60.0 * (i % 40) + rnd.randint(0, 9), 60.0 * (i // 40) + rnd.randint(0, 9)) for i in range(1600)}
    spots = [(i, float(rnd.randint(-9000, 9000)), float(rnd.randint(-9000, 9000))) for i in range(120)]
    met, metres = spark.sparkContext.accumulator(0), graph._metres

    def counted(d):
        met.add(1)
        return d

    monkeypatch.setattr(graph, "_metres", lambda: F.udf(counted, "double")(metres()))
    nodes = spark.createDataFrame([(n, x, y) for n, (x, y) in places.items()], "node int, x double, y double")
    got = {r["id"]: (r["node"], r["metres"]) for r in graph.nearest_node(spark.createDataFrame(spots, "id int, x double, y double"), nodes, None).collect()}
    for i, x, y in spots:
        d, n = min((((x - a) ** 2 + (y - b) ** 2) ** 0.5, n) for n, (a, b) in places.items())
        assert got[i][0] == n and abs(got[i][1] - d) < 1e-9
    assert len(got) == 120 and met.value < 120 * 20
