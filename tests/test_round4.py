"""Questions asked once, walks to the nearest of many doors, lines parsed once."""

import os
import random

from pyspark.sql import functions as F

from __spark_entry__ import queries
from lacuna.operators import graph, places, rank
from lacuna.plans import fixtures as X

QUERIES = queries()
SMALL = "/root/testdata/sf0.001"


def copies(spark, tmp_path, by=600):
    """sf0.001 with each supplier twice, the second ``by`` further on, where the same is asked."""
    for name in os.listdir(SMALL):
        if name != "supplier.parquet":
            os.symlink(f"{SMALL}/{name}", tmp_path / name)
    rows = spark.read.parquet(f"{SMALL}/supplier.parquet")
    rows.unionByName(rows.withColumn("s_suppkey", (F.col("s_suppkey") + by).cast(rows.schema["s_suppkey"].dataType))).write.parquet(str(tmp_path / "supplier.parquet"))
    return str(tmp_path)


def test_equal_questions_are_answered_once_for_all(spark, tmp_path):
    sf = copies(spark, tmp_path)
    asks = X.asks(spark, sf)
    once, same = rank.asked_once(asks)
    assert once.count() * 2 == asks.count() == same.count() and once.where("ask_id >= 600").count() == 0
    for name in ("w2_pick_gap", "w3_rank", "d3_fallback_ladder", "a9_tally", "a25_unranked", "a25_visibility_counts", "a28_available_names"):
        rows = [tuple(r) for r in QUERIES[name](spark, sf).collect()]
        first, second = sorted(r for r in rows if r[0] < 600), sorted((r[0] - 600, *r[1:]) for r in rows if r[0] >= 600)
        assert first and first == second == sorted(tuple(r) for r in QUERIES[name](spark, SMALL).collect()), name


def test_nearest_doors_by_boxes_and_origins_on_one_spot(spark):
    rnd = random.Random(3)
    doors = [(p, rnd.randint(0, 900) + 5000.0 * (p == 3), float(rnd.randint(0, 400))) for p in range(5) for _ in range(120)] + [(9, None, 1.0)]
    spots = [(i, rnd.randint(-200, 1200) / 2, float(rnd.randint(-50, 500))) for i in range(80)] + [(100, None, 2.0)]
    d = spark.createDataFrame(doors, "place_id int, x double, y double")
    got = {(r[0], r[1]): r[2] for r in graph.nearest_doors(spark.createDataFrame(spots, "source int, x double, y double"), d, side=6).collect()}
    for s, x, y in spots[:-1]:
        for p in range(5):
            assert abs(got.pop((s, p)) - min(((a - x) ** 2 + (b - y) ** 2) ** 0.5 for q, a, b in doors if q == p)) < 1e-9
    assert not got
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 100.0, 0.0)], "node int, x double, y double")
    edges = spark.createDataFrame([(0, 1, 100), (1, 0, 100)], "src int, dst int, w int")
    both = spark.createDataFrame([(1, 3.0, 4.0), (2, 3.0, 4.0), (3, None, 4.0)], "source int, x double, y double")
    out = graph.routed_walks(both, spark.createDataFrame([(7, 100.0, 10.0), (8, None, None)], "place_id int, x double, y double"), nodes, edges, 500)
    rows = {(r["source"], r["place_id"]): (r["routed"], r["how"]) for r in out.collect()}
    assert rows == {(s, 7): (115.0, "routed") for s in (1, 2)} | {(3, 7): (None, "off-graph")} | {(s, 8): (None, "off-graph") for s in (1, 2, 3)}


def test_equal_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([(1, "May 3-4, 2026"), (2, "x"), (3, "May 3-4, 2026"), (4, None)], "k int, t string")
    got = places.date_ranges(lines, "t", "k")
    assert sorted((r["k"], str(r["first"]), str(r["last"])) for r in got.collect()) == [(1, "2026-05-03", "2026-05-04"), (3, "2026-05-03", "2026-05-04")]
    assert "Aggregate [t" in got._jdf.queryExecution().optimizedPlan().toString()


def test_model_is_fitted_in_a_task(spark, monkeypatch):
    from lacuna.llm import toxicity

    driver, fit = os.getpid(), toxicity.fit

    def in_a_task(*args, **kwargs):
        assert os.getpid() != driver
        return fit(*args, **kwargs)

    monkeypatch.setattr(toxicity, "fit", in_a_task)
    docs = spark.createDataFrame([(i, "vile words here" if i % 2 else "fine words here") for i in range(60)], "doc_id long, text string")
    slots, weights, _ = toxicity.learn(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    assert len(slots) == len(weights) > 0
    assert toxicity.learn(docs, docs.select("doc_id", F.lit(None).cast("int").alias("toxic")))[2] == -50.0


def test_which_ngrams_the_sample_shows_decides_no_link(spark):
    from lacuna.llm import ngram_join

    rnd = random.Random(5)
    base = [" ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 9)) for _ in range(60)) for _ in range(12)]
    texts = [t + f" x{j}" * (j % 2) for t in base for j in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links = lambda **kw: sorted((r["doc_id"], r["component_id"]) for r in ngram_join.ngram_components(docs, **kw).collect())
    assert (found := links()) == links(sample=1) and len({c for _, c in found}) == 12
