"""Readers: page archives, keyed tables, id lists, and rows out of html and text columns."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.scalars import html_text

MEETINGS = (
    "data struct<courses: array<struct<subject: string, sections: array<struct<classNumber: string, startDate: date, endDate: date, "
    "meetings: array<struct<facilityId: string, buildingCode: string, startTime: string, endTime: string, monday: boolean, tuesday: boolean, "
    "wednesday: boolean, thursday: boolean, friday: boolean, saturday: boolean, sunday: boolean>>>>>>>"
)


def read_page_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row for each meeting of (gzipped) JSON pages; fields that the schema doesn't name, persons too, aren't read."""
    pages = spark.read.schema(MEETINGS).json(path)
    courses = pages.select(F.explode("data.courses").alias("c"))
    sections = courses.select(F.col("c.subject").alias("subject"), F.explode("c.sections").alias("s"))
    return sections.select("subject", "s.classNumber", "s.startDate", "s.endDate", F.explode("s.meetings").alias("m")).select("subject", "classNumber", "startDate", "endDate", "m.*")


def read_keyed_dim(spark: SparkSession, path: str, value_schema: str, lines: bool = False) -> DataFrame:
    """Rows (id, fields) of JSON objects keyed by id: one a file, or with ``lines`` one a line."""
    text = spark.read.text(path, wholetext=not lines)
    return text.select(F.explode(F.from_json("value", f"map<string, struct<{value_schema}>>")).alias("id", "v")).select("id", "v.*")


def read_id_list(spark: SparkSession, path: str, field: str, lines: bool = False) -> DataFrame:
    """Distinct ids of lists with the date on which they were pulled: one list a file, or with ``lines`` one a line."""
    rows = spark.read.schema(f"pulled date, `{field}` array<string>").option("multiLine", not lines).json(path)
    return rows.select(F.explode(field).alias("id"), "pulled").distinct()


def list_items(pages: DataFrame) -> DataFrame:
    """page_id, place and text of each <li>, tags removed and entities decoded."""
    items = F.regexp_extract_all("html", F.lit(r"(?is)<li[^>]*>(.*?)</li>"), 1)
    return pages.select("page_id", F.posexplode(items).alias("place", "raw")).select("page_id", "place", html_text(F.col("raw")).alias("item"))


def extract_links(pages: DataFrame, marker: str = "") -> DataFrame:
    """Distinct links that hold the marker, with the last part of the path."""
    links = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), 1)
    out = pages.select("page_id", F.explode(links).alias("href")).distinct()
    return out.where(F.contains("href", F.lit(marker))).withColumn("slug", F.regexp_extract("href", r"([^/]*)/*$", 1))


def extract_ids(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.select(F.explode(F.regexp_extract_all(column, F.lit(pattern), 1)).alias("id")).distinct()


def split_blocks(df: DataFrame, key: str, column: str) -> DataFrame:
    """Runs of lines between blank ones."""
    blocks = F.filter(F.split(column, r"\n[ \t]*(?:\n[ \t]*)+"), lambda b: F.trim(b) != "")
    return df.select(key, F.posexplode(blocks).alias("block", "text"))


class IncompleteIndex(ValueError):
    """A staged index doesn't hold what was to be written."""


def write_index(busy: DataFrame, root: str, name: str, term: str = "term") -> None:
    """Nested, sorted intervals of each resource, as the version ``name`` of the index in ``root``, partitioned by term.

    In two phases: the version is written to a folder of its own and read back; only if it holds the resources and
    intervals of ``busy`` does a row that points to it join the pointers, the last thing that is written. Readers follow
    the newest pointer, so a write that fails or is not whole leaves them with the version before. One writer at a time.
    """
    spark = busy.sparkSession
    staged = f"{root}/versions/{name}"
    nested = busy.groupBy(term, "resource_id").agg(F.array_sort(F.collect_list(F.struct("day", "start", "end", "session_id", "label"))).alias("busy"))
    nested.write.partitionBy(term).parquet(staged)
    want = busy.agg(F.countDistinct(F.struct(term, "resource_id")).alias("resources"), F.count(F.lit(1)).alias("intervals")).first()
    found = spark.read.parquet(staged).agg(F.count(F.lit(1)).alias("resources"), F.coalesce(F.sum(F.size("busy")), F.lit(0)).alias("intervals")).first()
    if tuple(want) != tuple(found):
        raise IncompleteIndex(f"{staged}: {found['resources']} resources and {found['intervals']} intervals of {want['resources']} and {want['intervals']}")
    last = pointers(spark, root).agg(F.max("version")).first()[0] or 0
    spark.range(1).select(F.lit(last + 1).cast("long").alias("version"), F.lit(name).alias("name"), F.lit(want["resources"]).cast("long").alias("resources"), F.lit(want["intervals"]).cast("long").alias("intervals")).write.mode("append").parquet(f"{root}/pointers")


def pointers(spark: SparkSession, root: str) -> DataFrame:
    """The versions of an index that were published; a row each."""
    schema = "version long, name string, resources long, intervals long"
    try:
        return spark.read.schema(schema).parquet(f"{root}/pointers")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """The newest published version: term, resource_id, busy."""
    newest = pointers(spark, root).orderBy(F.desc("version")).first()
    if newest is None:
        raise FileNotFoundError(f"no index was published in {root}")
    return spark.read.parquet(f"{root}/versions/{newest['name']}")


def write_report(guards: DataFrame, path: str, run: str) -> None:
    """Adds a run's guard rows to a table of all runs."""
    guards.select(F.lit(run).alias("run"), "guard", "level", "detail").write.mode("append").parquet(path)


def calendar_events(df: DataFrame, column: str) -> DataFrame:
    """Events of calendar text as (summary, day): folded lines joined, the end date left out, one day without an end."""
    text = F.regexp_replace(F.regexp_replace(F.col(column), "\r", ""), r"\n[ \t]", "")
    events = F.regexp_extract_all(text, F.lit(r"(?s)BEGIN:VEVENT\n(.*?)END:VEVENT"), 1)
    rows = df.select(F.explode(events).alias("e"))
    date = lambda name: F.to_date(F.nullif(F.regexp_extract("e", rf"{name}[^:\n]*:([0-9]{{8}})", 1), F.lit("")), "yyyyMMdd")
    rows = rows.select(F.replace(F.regexp_extract("e", r"SUMMARY[^:\n]*:([^\n]*)", 1), F.lit("\\,"), F.lit(",")).alias("summary"), date("DTSTART").alias("first"), date("DTEND").alias("stop"))
    last = F.coalesce(F.date_sub("stop", 1), F.col("first"))
    return rows.where("first is not null").select("summary", F.explode(F.sequence("first", F.greatest(last, F.col("first")))).alias("day"))
