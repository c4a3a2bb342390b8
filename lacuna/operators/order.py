"""Places of rows in an order, found without one task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.graph import cut


def rows_before(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), weight: Column | None = None, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``weight`` (1: the number) of the rows of its group that come before each one.

    Rows are sorted by ranges of (by, order), a range for each partition, and written; ranges are summed by group, so the
    second sum runs over as many rows of a group as there are partitions. Rows equal in order are taken in any.
    """
    keys = [*by, *order]
    w = weight if weight is not None else F.lit(1).cast("long")
    spread = cut(df.withColumn("_w", w).repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy(*by, "_range").agg(F.sum("_w").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    inside = spread.withColumn("_in", F.coalesce(F.sum("_w").over(own), F.lit(0)))
    names = [*by, "_range"]
    starts = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(names)], "_start")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(names)]
    return inside.join(starts, same).select(*df.columns, (F.col("_start") + F.col("_in")).cast("long").alias(name))
