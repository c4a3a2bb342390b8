"""Quality gates: each gives rows (guard, level, detail); level is ok, forceable or fatal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guard(df: DataFrame, name: str, level: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(name).alias("guard"), level.alias("level"), detail.cast("string").alias("detail"))


def count_guard(now: DataFrame, column: str, floor: int, previous: DataFrame | None = None, keep: float = 0.95) -> DataFrame:
    """Below the floor is fatal; below ``keep`` of the previous count is forceable."""
    prev = previous.select(F.col(column).alias("_prev")) if previous is not None else now.select(F.lit(None).cast("long").alias("_prev")).limit(1)
    both = now.crossJoin(prev)  # one row each
    level = F.when(F.col(column) < floor, "fatal").when(F.col(column) < F.ceil(F.col("_prev") * keep), "forceable").otherwise("ok")
    return guard(both, f"count:{column}", level, F.col(column))


def residue_guard(df: DataFrame, failed: Column, name: str, most: float) -> DataFrame:
    """More than ``most`` of the values that could not be read is fatal; nothing seen is fine."""
    agg = df.agg(F.count_if(failed).alias("failed"), F.count(F.lit(1)).alias("seen"))
    rate = F.col("failed") / F.nullif(F.col("seen"), F.lit(0))
    return guard(agg, f"residue:{name}", F.when(rate > most, "fatal").otherwise("ok"), F.col("failed"))


def balance_guard(measure: DataFrame, least: float = 0.3) -> DataFrame:
    return guard(measure, "balance", F.when(F.col("balance") < least, "forceable").otherwise("ok"), F.round("balance", 3))


def unresolved_guard(df: DataFrame, dim: DataFrame, key: str, excused: tuple = ()) -> DataFrame:
    missing = df.select(key).distinct().join(dim.select(key).distinct(), key, "left_anti").where(~F.col(key).isin(*excused) if excused else F.lit(True))
    agg = missing.agg(F.count(F.lit(1)).alias("n"))
    return guard(agg, f"unresolved:{key}", F.when(F.col("n") > 0, "fatal").otherwise("ok"), F.col("n"))


def coordinate_guard(df: DataFrame, most: float = 0.1) -> DataFrame:
    agg = df.agg(F.count_if(F.col("lat").isNull() | F.col("lon").isNull()).alias("without"), F.count(F.lit(1)).alias("rows"))
    return guard(agg, "coordinates", F.when(F.col("without") > F.col("rows") * most, "fatal").otherwise("ok"), F.col("without"))


#: patterns of personal data
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"


def pii_guard(df: DataFrame) -> DataFrame:
    """Rows of each string column that hold an address or a phone number; any is fatal."""
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    counts = df.agg(*[F.count_if(F.col(c).rlike(EMAIL) | F.col(c).rlike(PHONE)).alias(c) for c in text])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in text])).alias("r"))
    return rows.select(F.concat(F.lit("pii:"), "r.column").alias("guard"), F.when(F.col("r.n") > 0, "fatal").otherwise("ok").alias("level"), F.col("r.n").cast("string").alias("detail"))


def freshness_guard(df: DataFrame, now: Column, most_days: int = 10) -> DataFrame:
    """``state`` of each timestamp: unreadable, future (by an hour), stale or ok, and runs missed at one a week."""
    days = (F.unix_timestamp(now) - F.unix_timestamp("generated")) / 86400.0
    state = F.when(F.col("generated").isNull(), "unreadable").when(days < -1 / 24.0, "future").when(days > most_days, "stale").otherwise("ok")
    return df.withColumn("state", state).withColumn("missed", F.when(days >= 0, F.floor(days / 7)).otherwise(0))


def field_shape(df: DataFrame, required: tuple[str, ...], patterns: dict[str, str]) -> DataFrame:
    """Per field: rows where it is missing, and rows where it isn't as its pattern says."""
    fields = [*required, *[f for f in patterns if f not in required]]
    bad = lambda f: F.count_if(~F.col(f).cast("string").rlike(patterns[f])) if f in patterns else F.lit(0)
    aggs = [F.struct(F.lit(f).alias("field"), F.count_if(F.col(f).isNull()).alias("missing"), bad(f).cast("long").alias("malformed")).alias(f"_{i}") for i, f in enumerate(fields)]
    return df.agg(*aggs).select(F.explode(F.array(*[F.col(f"_{i}") for i in range(len(fields))])).alias("r")).select("r.*")


def bucket_guard(df: DataFrame, column: str, expected: str) -> DataFrame:
    agg = df.agg(F.countDistinct(column).alias("n"), F.count_if(F.col(column) == expected).alias("hit"))
    return guard(agg, f"buckets:{column}", F.when((F.col("n") <= 1) | (F.col("hit") == 0), "fatal").otherwise("ok"), F.col("n"))


def archive_completeness(df: DataFrame, bucket: str, facet: DataFrame, page: int = 200, cap: int = 10_000) -> DataFrame:
    """Per bucket: items, pages, and ok, SHORT (fewer than the facet says) or CAPPED."""
    have = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("items"))
    out = facet.join(have, bucket, "left").withColumn("items", F.coalesce("items", F.lit(0)).cast("long"))
    status = F.when(F.col("expected") >= cap, "CAPPED").when(F.col("items") < F.col("expected"), "SHORT").otherwise("ok")
    return out.withColumn("pages", F.ceil(F.col("items") / page).cast("long")).withColumn("status", status)


def location_consistency(df: DataFrame, place: str, label: str) -> DataFrame:
    """Places that go by more than one label."""
    return df.groupBy(place).agg(F.countDistinct(label).alias("labels")).where("labels > 1")


def refusal_report(guards: list[DataFrame], force: bool = False) -> DataFrame:
    """One row: how many are fatal and forceable, and whether the run is refused (force clears forceable ones)."""
    rows = reduce(DataFrame.unionByName, guards)
    out = rows.agg(F.count_if(F.col("level") == "fatal").alias("fatal"), F.count_if(F.col("level") == "forceable").alias("forceable"))
    return out.withColumn("refused", (F.col("fatal") > 0) | (F.lit(not force) & (F.col("forceable") > 0)))


def allowed_fields_guard(df: DataFrame, fields: tuple[str, ...], codes: dict[str, tuple]) -> DataFrame:
    """Columns that nobody approved, and values of coded columns outside their list, with how many rows; any is fatal."""
    extra = [c for c in df.columns if c not in fields]
    checks = [("field", c, F.count(F.lit(1))) for c in extra] + [("code", c, F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*v))) for c, v in codes.items() if c in df.columns]
    counts = df.agg(F.lit(0).alias("_"), *[n.alias(f"n{i}") for i, (_, _, n) in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(f"{kind}:{c}").alias("guard"), F.col(f"n{i}").alias("n")) for i, (kind, c, _) in enumerate(checks)])
    return counts.select(F.explode(rows).alias("r")).select("r.guard", F.when(F.col("r.n") > 0, "fatal").otherwise("ok").alias("level"), F.col("r.n").cast("string").alias("detail"))


def phantom_sentinel(df: DataFrame, real: Column, sentinel: Column, capacity: int = 998) -> DataFrame:
    """Rows with the sentinel's capacity that pass as real are fatal; so is a table without the sentinel."""
    agg = df.agg(F.count_if(real & (F.col("capacity") == capacity)).alias("phantoms"), F.count_if(sentinel).alias("seen"))
    level = F.when((F.col("phantoms") > 0) | (F.col("seen") == 0), "fatal").otherwise("ok")
    return guard(agg, "phantoms", level, F.concat_ws("/", "phantoms", "seen"))


def field_drift(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Rows that lack some of the fields, with their names."""
    lacking = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]))
    return df.withColumn("lacking", F.array_join(lacking, ",")).where("lacking <> ''")


def max_distance_guard(children: DataFrame, parents: DataFrame, key: str, most: float) -> DataFrame:
    """Children farther than ``most`` metres from their parent, with the distance: a broken join. Both have lat and lon."""
    from lacuna.functions.scalars import haversine_m

    p = parents.select(key, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    return children.join(p, key).withColumn("metres", haversine_m(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))).where(F.col("metres") > most).drop("_lat", "_lon")
