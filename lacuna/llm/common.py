"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PIECE = 4 << 20  #: characters of text that a worker looks at together

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder on a local master; on a cluster, where no machine sees another's, the warehouse.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/lacuna-scratch"
    if "at" not in _OWN_DIR:
        _OWN_DIR["at"] = "file://" + tempfile.mkdtemp(prefix="spark-lacuna-")
    return _OWN_DIR["at"]


def release() -> None:
    """Freed memory goes back to the system; Python workers outlive their tasks and stages."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(frames: Iterator[pd.DataFrame], column: str = "text", most: int = PIECE) -> Iterator[pd.DataFrame]:
    """The rows of ``frames`` in order, in frames whose texts have ``most`` characters together at most; a longer text is alone."""
    for pdf in frames:
        upto = np.cumsum([len(t) for t in pdf[column]])
        at = 0
        while at < len(pdf):
            to = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")), at + 1)
            yield pdf.iloc[at:to]
            at = to
    release()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    The files that the job shuffled serve nothing once it is written, so Spark is asked to remove them at its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def int_column(values: list):
    """A nullable column of 64-bit integers; pandas alone would go through floats where a value is None."""
    out = np.array([0 if v is None else v for v in values], np.int64)
    return pd.arrays.IntegerArray(out, np.array([v is None for v in values], bool))


# -- rolling hashes over integer sequences, as numpy passes -----------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def rolling_hash(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash (mod 2**64, then mixed) of every k consecutive codes; built by doubling."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    piece, have, need = codes.astype(np.uint64) + np.uint64(1), 1, k
    out, done = None, 0
    power = _BASE  # _BASE ** have
    with np.errstate(over="ignore"):
        while need:
            if need & 1:
                if out is None:
                    out = piece
                else:
                    m = min(len(out), len(piece) - done)
                    out = out[:m] * power + piece[done : done + m]
                done += have
            need >>= 1
            if need:
                piece = piece[: len(piece) - have] * power + piece[have:]
                power = power * power
                have *= 2
    return mix64(out[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, in log2(w) passes."""
    have, best = 1, x
    while 2 * have <= w:
        best = np.minimum(best[: len(best) - have], best[have:])
        have *= 2
    if have < w:
        best = np.minimum(best[: len(best) - (w - have)], best[w - have :])
    return best
