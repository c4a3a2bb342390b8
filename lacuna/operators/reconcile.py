"""Sources against each other: unions of passes, diffs, votes, overrides, adjudication."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.scalars import unpad
from lacuna.operators.graph import cut
from lacuna.operators.order import rows_before


def harvest_union(rows: DataFrame, key: str) -> DataFrame:
    """Per pass: keys it saw, keys no earlier pass had, and how many keys there are after it. ``rows``: key, pass."""
    seen = rows.groupBy("pass").agg(F.countDistinct(key).alias("saw"))
    first = rows.groupBy(key).agg(F.min("pass").alias("pass")).groupBy("pass").agg(F.count(F.lit(1)).alias("added"))
    out = seen.join(first, "pass", "left").withColumn("added", F.coalesce("added", F.lit(0)).cast("long"))
    return out.withColumn("union_after", F.sum("added").over(Window.orderBy("pass")))


def schedule_drift(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys in one of two tables only, with ``change`` added or removed."""
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    return b.join(a, list(keys), "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, list(keys), "left_anti").withColumn("change", F.lit("removed")))


def list_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    o, n = old.select(key).distinct().withColumn("_o", F.lit(True)), new.select(key).distinct().withColumn("_n", F.lit(True))
    out = o.join(n, key, "full_outer")
    return out.withColumn("change", F.when(F.col("_o").isNull(), "appeared").when(F.col("_n").isNull(), "left").otherwise("kept")).drop("_o", "_n")


def never_saw(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of a that b lacks both exactly and without leading zeros."""
    other = b.select(F.col(key).alias("_k")).distinct()
    loose = b.select(unpad(F.col(key)).alias("_k")).distinct()
    rows = a.select(key).distinct().withColumn("_l", unpad(F.col(key)))
    rows = rows.join(other, rows[key] == F.col("_k"), "left_anti")
    return rows.join(loose, rows["_l"] == F.col("_k"), "left_anti").drop("_l")


def keyset_equal(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: sizes of both key sets, keys missing on each side, and whether they are equal."""
    d = list_diff(a, b, key)
    out = d.agg(F.count_if(F.col("change") == "left").alias("only_a"), F.count_if(F.col("change") == "appeared").alias("only_b"), F.count_if(F.col("change") == "kept").alias("both"))
    return out.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def carried_forward(rows: DataFrame, key: str, period: str) -> DataFrame:
    """Keys of earlier periods that the newest lacks: when last seen, in how many periods."""
    newest = rows.agg(F.max(period).alias("newest"))
    per = rows.groupBy(key).agg(F.max(period).alias("last_seen"), F.countDistinct(period).alias("periods"))
    out = per.crossJoin(F.broadcast(newest)).where(F.col("last_seen") < F.col("newest")).drop("newest")
    return out.withColumn("strength", F.when(F.col("periods") >= 3, "strong").when(F.col("periods") == 2, "medium").otherwise("weak"))


def _pattern_ok() -> Column:
    return F.coalesce(F.col("time").rlike("^[0-2][0-9][0-5][0-9]-[0-2][0-9][0-5][0-9]$") & F.col("pattern").rlike("^[01]{7}$"), F.lit(False))


def source_intervals(df: DataFrame) -> DataFrame:
    """A row for each 1 in a 7-letter pattern (first Monday); ``day`` is 0 for Sunday. Times are HHMM-HHMM."""
    minute = lambda at: F.substring("time", at, 2).try_cast("int") * 60 + F.substring("time", at + 2, 2).try_cast("int")
    rows = df.where(_pattern_ok()).select("*", F.posexplode(F.split("pattern", "")).alias("at", "bit")).where("bit = '1'")
    return rows.withColumn("day", (F.col("at") + 1) % 7).withColumn("start", minute(1)).withColumn("end", minute(6)).drop("at", "bit")


def source_counts(df: DataFrame) -> DataFrame:
    """One row: rows of a second source that give intervals, that are skipped (no pattern or time to read), and intervals."""
    days = F.length("pattern") - F.length(F.replace("pattern", F.lit("1"), F.lit("")))
    return df.agg(F.count_if(_pattern_ok()).alias("read"), F.count_if(~_pattern_ok()).alias("skipped"), F.coalesce(F.sum(F.when(_pattern_ok(), days)), F.lit(0)).cast("long").alias("intervals"))


def uncovered(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Intervals of ``rows`` that the union of the other's doesn't cover, with the minutes it lacks."""
    from lacuna.operators.intervals import merge_intervals

    merged = merge_intervals(other.select(*keys, "start", "end").withColumn("label", F.lit(None).cast("string")), keys).select(*keys, F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    own = rows.select(*keys, "start", "end").where("end > start").distinct()
    on = [own[k] == merged[k] for k in keys] + [own["start"] < merged["o_end"], own["end"] > merged["o_start"]]
    both = own.join(merged, on, "left").select(*[own[k] for k in keys], own["start"], own["end"], "o_start", "o_end")
    covered = F.coalesce(F.sum(F.least("end", "o_end") - F.greatest("start", "o_start")), F.lit(0))
    return both.groupBy(*keys, "start", "end").agg(covered.alias("covered")).withColumn("lacking", (F.col("end") - F.col("start") - F.col("covered")).cast("long")).where("lacking > 0").drop("covered")


def adjudicate(claims: DataFrame, truth: DataFrame) -> DataFrame:
    """Claims against a later table at three grains: confirmed, stale, part-gone or whole-gone.

    Both have order, line and value.
    """
    exact = truth.select("order", "line", F.col("value").alias("t_value")).distinct()
    whole = truth.select("order").distinct().withColumn("_whole", F.lit(True))
    out = claims.join(exact, ["order", "line"], "left").join(whole, "order", "left")
    verdict = F.when(F.col("t_value").eqNullSafe(F.col("value")) & F.col("t_value").isNotNull(), "confirmed").when(F.col("t_value").isNotNull(), "stale").when(F.col("_whole").isNotNull(), "part-gone").otherwise("whole-gone")
    return out.withColumn("verdict", verdict).drop("_whole")


def dedupe_conflict(df: DataFrame, key: str, columns: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Per key: rows, and whether a column differs among them by more than the tolerance."""
    spread = F.greatest(*[F.max(c) - F.min(c) for c in columns], F.lit(0.0))
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), (spread > tolerance).alias("conflict"))


def majority_vote(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each key, the smaller of equal ones."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"))
    by = Window.partitionBy(*keys).orderBy(F.desc("votes"), value)
    return counts.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def source_coverage(keys: DataFrame, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many keys have a row in a, b, both, either and none."""
    rows = keys.select(key).distinct()
    for name, other in (("a", a), ("b", b)):
        rows = rows.join(other.select(key).distinct().withColumn(f"_{name}", F.lit(True)), key, "left")
    x, y = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return rows.agg(F.count_if(x).alias("in_a"), F.count_if(y).alias("in_b"), F.count_if(x & y).alias("in_both"), F.count_if(x | y).alias("in_either"), F.count_if(~x & ~y).alias("in_none"))


def value_agreement(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Whether the sources' values (nulls aside) agree."""
    return df.select(key, (F.size(F.array_distinct(F.array_compact(F.array(*[F.col(c) for c in columns])))) <= 1).alias("agree"))


def override_patch(df: DataFrame, overrides: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``value`` from the override where it could not be read (null); ``patched`` says so."""
    o = overrides.select(*keys, F.col("value").alias("_value"))
    out = df.join(o, list(keys), "left")
    return out.withColumn("patched", F.col(value).isNull() & F.col("_value").isNotNull()).withColumn(value, F.coalesce(F.col(value), F.col("_value"))).drop("_value")


def override_report(df: DataFrame, overrides: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row on a patch: cells patched, unresolved (still null: fatal), overrides unused (their cell could be read) and
    without a cell."""
    o = overrides.select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(True).alias("_over"), F.col("value").alias("_value"))
    cells = df.select(*keys, F.col(value).alias("_own"), F.lit(True).alias("_cell"))
    both = cells.join(o, [cells[k] == o[f"_{k}"] for k in keys], "full_outer")
    open_ = F.col("_cell").isNotNull() & F.col("_own").isNull()
    out = both.agg(
        F.count_if(open_ & F.col("_value").isNotNull()).alias("patched"), F.count_if(open_ & F.col("_value").isNull()).alias("unresolved"),
        F.count_if(F.col("_over").isNotNull() & F.col("_own").isNotNull()).alias("unused"), F.count_if(F.col("_cell").isNull()).alias("without_cell"),
    )
    return out.withColumn("level", F.when(F.col("unresolved") > 0, "fatal").otherwise("ok"))


def key_clashes(dim: DataFrame, key: str) -> DataFrame:
    """Keys of a dimension that are one without leading zeros: unpadded, keys (sorted). Any row is fatal for a join by them."""
    own = dim.select(unpad(F.col(key)).alias("unpadded"), F.col(key).alias("_k")).where("_k is not null").distinct()
    return own.groupBy("unpadded").agg(F.array_sort(F.collect_list("_k")).alias("keys")).where(F.size("keys") > 1)


def fallback_key_join(df: DataFrame, dim: DataFrame, first: str, second: str, key: str) -> DataFrame:
    """Rows with the dimension's key found by ``first``, else by ``second``; keys without leading zeros.

    Two keys of the dimension that are one without zeros are fatal: the query fails where a row would meet them (see
    key_clashes for the list).
    """
    d = dim.select(unpad(F.col(key)).alias("_k"), F.col(key).alias("_v")).groupBy("_k").agg(F.min("_v").alias("_v"), F.max("_v").alias("_w"))
    clash = F.raise_error(F.concat(F.lit("keys that differ in leading zeros only: "), "_v", F.lit(", "), "_w"))
    d = d.select("_k", F.when(F.col("_v") == F.col("_w"), F.col("_v")).otherwise(clash.cast("string")).alias("_v"))
    a, b = d.toDF("_ka", "_va"), d.toDF("_kb", "_vb")
    out = df.join(a, unpad(F.col(first)) == F.col("_ka"), "left").join(b, unpad(F.col(second)) == F.col("_kb"), "left")
    by = F.when(F.col("_va").isNotNull(), "first").when(F.col("_vb").isNotNull(), "second")
    return out.withColumn("matched", F.coalesce("_va", "_vb")).withColumn("matched_by", by).drop("_ka", "_va", "_kb", "_vb")


def inversions(values: np.ndarray) -> int:
    """Pairs in which a strictly larger value comes first: bit by bit from the highest, ones before zeros of equal heads."""
    x = np.unique(values, return_inverse=True)[1].astype(np.int64)
    total = 0
    for bit in range(int(x.max(initial=0)).bit_length() - 1, -1, -1):
        head, one = x >> (bit + 1), (x >> bit) & 1
        ones = np.cumsum(one)
        first = np.searchsorted(head, head)  # where the run of equal heads begins; x is in order of its heads
        total += int((ones - (ones - one)[first])[one == 0].sum())
        x = x[np.argsort(x >> bit, kind="stable")]
    return total


def _within(rows: DataFrame, group: str, part: str) -> DataFrame:
    """Inversions inside each part of a group, whose rows one task holds."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"group": [key[0]], "n": [inversions(pdf.sort_values("at")["rank"].to_numpy())]})

    rows = rows.select(F.col(group).alias("group"), F.col(part).alias("part"), "at", "rank")
    return rows.groupBy("group", "part").applyInPandas(run, rows.select("group").schema.simpleString()[7:-1].replace(":", " ") + ", n long")


def order_inversions(df: DataFrame, group: str, key: str, a: str, b: str, block: int = 65_536) -> DataFrame:
    """Per group: pairs of keys, and those whose strict order by a is the other way round by b. Ties in either don't count.

    Rows are put in order of (a, b) and cut into blocks of that order; values of b are ranked and cut into buckets. A pair
    that lies in two blocks and two buckets is counted from sums over the grid of these; pairs inside one block, or inside
    one bucket, are counted by the task that holds it. No pair is ever a row. A value of b that alone fills a bucket has
    no inversions inside and isn't gathered, so no task holds more than about two blocks. The grid has (rows / block)**2
    cells for a group, less than it has rows up to block**2 of these. Rows with a null score take no part.
    """
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(group).alias("group"), F.col(key).alias("key"), F.col(a).alias("a"), F.col(b).alias("b"))
    values = rows_before(rows.groupBy("group", "b").agg(F.count(F.lit(1)).alias("same")), ["b"], ["group"], F.col("same"), "rank")
    alone = F.col("same") > block
    values = values.withColumn("bucket", F.floor(F.col("rank") / block) * 2 + alone.cast("int")).withColumn("alone", alone)
    placed = rows_before(rows, ["a", "b", "key"], ["group"], name="at").withColumn("block", F.floor(F.col("at") / block))
    values = values.select(F.col("group").alias("_g"), F.col("b").alias("_v"), "rank", "bucket", "alone")
    placed = cut(placed.join(values, F.col("group").eqNullSafe(F.col("_g")) & (F.col("b") == F.col("_v"))).select("group", "at", "block", "rank", "bucket", "alone"))

    counts = cut(placed.groupBy("group", "block", "bucket").agg(F.count(F.lit(1)).alias("n")))
    sides = lambda c: counts.select(F.col("group").alias("_g"), c).distinct()
    grid = sides("block").alias("x").join(sides("bucket").alias("y"), F.col("x._g").eqNullSafe(F.col("y._g"))).select(F.col("x._g").alias("_g"), F.col("block").alias("_b"), F.col("bucket").alias("_k"))
    grid = grid.join(counts, F.col("_g").eqNullSafe(F.col("group")) & (F.col("_b") == F.col("block")) & (F.col("_k") == F.col("bucket")), "left")
    grid = grid.select("_g", F.col("_b").alias("block"), F.col("_k").alias("bucket"), F.coalesce("n", F.lit(0)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("_g", "bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    larger = F.coalesce(F.sum("earlier").over(Window.partitionBy("_g", "block").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    across = grid.withColumn("earlier", earlier).withColumn("larger", larger).select(F.col("_g").alias("group"), (F.col("n") * F.col("larger")).alias("n"))
    # a pair of one bucket in one block is counted with both, so it goes once from the bucket's
    in_block = _within(placed, "group", "block")
    in_bucket = _within(placed.where("not alone"), "group", "bucket")
    in_both = _within(placed.where("not alone").withColumn("cell", F.struct("block", "bucket")), "group", "cell").select("group", (-F.col("n")).alias("n"))
    flipped = across.unionByName(in_block).unionByName(in_bucket).unionByName(in_both).groupBy("group").agg(F.sum("n").alias("flipped"))
    sizes = df.groupBy(F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("_n")).withColumn("pairs", (F.col("_n") * (F.col("_n") - 1) / 2).cast("long"))
    out = sizes.where("pairs > 0").join(flipped.withColumnRenamed("group", "_g"), F.col("group").eqNullSafe(F.col("_g")), "left")
    return out.select(F.col("group").alias(group), "pairs", F.coalesce("flipped", F.lit(0)).cast("long").alias("flipped"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("rows"))
