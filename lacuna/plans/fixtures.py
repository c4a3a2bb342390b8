"""The tables that the registered queries run on, derived from the driver's by plain arithmetic on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def busy(spark: SparkSession, sf: str) -> DataFrame:
    minute = F.hour("ts") * 60 + F.minute("ts")
    return table(spark, sf, "events").select(
        "event_id",
        F.col("user_id").alias("resource_id"),
        F.to_date("ts").alias("date"),
        (F.dayofweek("ts") - 1).alias("day"),
        minute.alias("start"),
        F.least(F.lit(1440), minute + F.ceil("value").cast("int")).alias("end"),
        (F.col("user_id") % 3).cast("int").alias("session_id"),
        F.col("event_type").alias("label"),
    )


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Thirds of the events' span, by session id."""
    span = table(spark, sf, "events").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    return span.select(F.explode(F.expr("array(struct(0 as session_id, a as first, b as last), struct(1 as session_id, a as first, date_add(a, 14) as last), struct(2 as session_id, date_add(a, 15) as first, b as last))")).alias("s")).select("s.*")


def places(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        k.alias("place_id"),
        F.col("n_name").alias("name"),
        (F.lit(39.99) + ((k * 37) % 100) / 10000.0).alias("lat"),
        (F.lit(-83.02) + ((k * 53) % 150) / 10000.0).alias("lon"),
    )


def resources(spark: SparkSession, sf: str) -> DataFrame:
    """A resource for each customer: place, type and seats."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("resource_id"), F.col("c_nationkey").alias("place_id"), F.col("c_mktsegment").alias("type"), (F.col("c_custkey") % 97).cast("int").alias("seats")
    )


def hours(spark: SparkSession, sf: str) -> DataFrame:
    """Place and day: no row is unknown, null open is closed."""
    k, d = F.col("n_nationkey"), F.col("day")
    closed = k % 7 == d
    return (
        table(spark, sf, "nation").withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(6)))).where(k % 5 != 0)
        .select(k.alias("place_id"), "day", F.when(~closed, 420 + 30 * (k % 4)).alias("open"), F.when(~closed, 1320 + 15 * (k % 5)).alias("close"))
    )


def asks(spark: SparkSession, sf: str) -> DataFrame:
    """A question for each supplier."""
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("ask_id"), F.expr("date_add(date'2024-01-08', cast(s_suppkey % 5 as int))").alias("date"), (1 + k % 5).cast("int").alias("day"),
        (480 + (k * 37) % 600).cast("int").alias("now"), (30 + 30 * (k % 4)).cast("int").alias("need"),
        (F.lit(39.99) + ((k * 29) % 100) / 10000.0).alias("lat"), (F.lit(-83.02) + ((k * 31) % 150) / 10000.0).alias("lon"),
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Both directions of an undirected graph over parts."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    n = part.agg(F.count(F.lit(1)).alias("n"))
    both = part.crossJoin(F.broadcast(n))  # one row
    w = 50 + (F.col("k") * 13) % 200
    ring = both.where("k % 10 <> 0").select(F.col("k").alias("a"), ((F.col("k") + 1) % F.col("n")).alias("b"), w.alias("w"))
    far = both.where("k % 20 = 5").select(F.col("k").alias("a"), ((F.col("k") * 7 + 3) % F.col("n")).alias("b"), w.alias("w"))
    one = ring.unionByName(far)
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.min("w").alias("w"))


SQL = {
    "busy": """busy AS (SELECT event_id, user_id AS resource_id, CAST(ts AS DATE) AS date, dayofweek(ts)::INT AS day, (hour(ts) * 60 + minute(ts))::INT AS start,
        least(1440, hour(ts) * 60 + minute(ts) + ceil(value)::INT)::INT AS "end", (user_id % 3)::INT AS session_id, event_type AS label FROM events)""",
    "sessions": """sessions AS (SELECT unnest([{'session_id': 0, 'first': a, 'last': b}, {'session_id': 1, 'first': a, 'last': a + 14}, {'session_id': 2, 'first': a + 15, 'last': b}], recursive := true)
        FROM (SELECT min(ts)::DATE AS a, max(ts)::DATE AS b FROM events))""",
    "places": "places AS (SELECT n_nationkey AS place_id, n_name AS name, 39.99::DOUBLE + ((n_nationkey * 37) % 100) / 10000.0::DOUBLE AS lat, -83.02::DOUBLE + ((n_nationkey * 53) % 150) / 10000.0::DOUBLE AS lon FROM nation)",
    "resources": "resources AS (SELECT c_custkey AS resource_id, c_nationkey AS place_id, c_mktsegment AS type, (c_custkey % 97)::INT AS seats FROM customer)",
    "hours": """hours AS (SELECT n_nationkey AS place_id, day::INT AS day, CASE WHEN n_nationkey % 7 <> day THEN 420 + 30 * (n_nationkey % 4) END AS open,
        CASE WHEN n_nationkey % 7 <> day THEN 1320 + 15 * (n_nationkey % 5) END AS close FROM nation, range(7) t(day) WHERE n_nationkey % 5 <> 0)""",
    "asks": """asks AS (SELECT s_suppkey AS ask_id, DATE '2024-01-08' + (s_suppkey % 5)::INT AS date, (1 + s_suppkey % 5)::INT AS day, (480 + (s_suppkey * 37) % 600)::INT AS now, (30 + 30 * (s_suppkey % 4))::INT AS need,
        39.99::DOUBLE + ((s_suppkey * 29) % 100) / 10000.0::DOUBLE AS lat, -83.02::DOUBLE + ((s_suppkey * 31) % 150) / 10000.0::DOUBLE AS lon FROM supplier)""",
    "edges": """one AS (SELECT p_partkey AS a, (p_partkey + 1) % (SELECT count(*) FROM part) AS b, 50 + (p_partkey * 13) % 200 AS w FROM part WHERE p_partkey % 10 <> 0
        UNION ALL SELECT p_partkey, (p_partkey * 7 + 3) % (SELECT count(*) FROM part), 50 + (p_partkey * 13) % 200 FROM part WHERE p_partkey % 20 = 5),
        edges AS (SELECT a AS src, b AS dst, min(w) AS w FROM (SELECT * FROM one UNION ALL SELECT b, a, w FROM one) WHERE a <> b GROUP BY a, b)""",
}


def ctes(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "
