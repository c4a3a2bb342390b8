"""Answers with a row for each resource, dealt out to all who ask."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from lacuna.operators import rank

QUERIES = queries()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def asked(spark, tmp_path):
    """sf0.001 with its suppliers 40 times, 600 apart, where the same is asked; nothing is small enough to broadcast."""
    for name in os.listdir(SMALL):
        if name != "supplier.parquet":
            os.symlink(f"{SMALL}/{name}", tmp_path / name)
    rows = spark.read.parquet(f"{SMALL}/supplier.parquet")
    more = rows.crossJoin(spark.range(40)).withColumn("s_suppkey", (F.col("s_suppkey") + 600 * F.col("id")).cast(rows.schema["s_suppkey"].dataType))
    more.drop("id").write.parquet(str(tmp_path / "supplier.parquet"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield str(tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def dealt_in_runs(spark, asked, name):
    """All rows, each answer's 40 after one another, in as many parts as Spark shuffles into."""
    parts = QUERIES[name](spark, asked).rdd.glom().collect()
    rows = [tuple(r) for part in parts for r in part]
    want = [tuple(r) for r in QUERIES[name](spark, SMALL).collect()]
    assert len(want) > 20 and sorted(rows) == sorted((r[0] + 600 * i, *r[1:]) for r in want for i in range(40))
    runs = sum((a[0] % 600, *a[1:]) != (b[0] % 600, *b[1:]) for a, b in zip(rows, rows[1:], strict=False)) + 1
    assert runs == len(want) and len(parts) == 4


def test_picked_gaps_go_to_all_askers_in_runs(spark, asked):
    dealt_in_runs(spark, asked, "w2_pick_gap")


def test_soonest_gaps_go_to_all_askers_in_runs(spark, asked):
    dealt_in_runs(spark, asked, "w2_pick_gap_soon")


def test_ranked_answers_go_to_all_askers_in_runs(spark, asked):
    dealt_in_runs(spark, asked, "w3_rank")


def test_askers_in_several_arrays(spark, monkeypatch):
    monkeypatch.setattr(rank, "CHUNK", 7)
    rnd = random.Random(5)
    same = spark.createDataFrame([(a, a % 3 if a < 90 else 4) for a in range(100)], "ask_id long, asked long")
    rows = spark.createDataFrame([(rnd.choice((0, 1, 2, 4, 5)), r) for r in range(300)], "ask_id long, resource_id long")
    out = rank.each_for_all(rank.dealt(rows, "ask_id"), same)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rank.for_all(rows, same).collect()))
