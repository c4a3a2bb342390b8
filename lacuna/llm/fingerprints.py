"""Winnowing fingerprints of documents, and of documents edited with their neighbour's text.

``winnow`` keeps, for every window of ``w`` consecutive k-gram hashes, the smallest hash (rightmost on
ties) together with its position. Two texts that share ``k + w - 1`` code points share a kept hash, and
the positions say where. A text shorter than ``k`` keeps one hash of the whole; an empty text keeps none.

``document_fingerprints`` also compares every document with the next one in descending id order.
The order is found without moving all rows to one task: ids are cut into blocks at quantiles, each
block's first document is also sent to the block before it, and every block is read as a sorted stream.

Null text counts as empty; null ids sort last; rows that repeat an id are ordered by a hash of the text;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import mix64, rolling_hash, shuffle_partitions, sliding_min, text_or_empty

K = 20  #: code points in a gram
W = 31  #: grams in a window; a common passage of K + W - 1 = 50 code points is always found
MAX_BLOCKS = 2048  #: bounds the literals that name the blocks
SEGMENT = 1 << 20  #: windows hashed at once, so that a long text needs bounded memory

_LOW = np.uint64(0xFFFFFFFF)
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_fingerprints long"
)


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes uint32, positions uint32) kept from ``text``, by position."""
    n = len(text)
    if not n:
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if n < k:
        whole = mix64(rolling_hash(codes, n) + np.uint64(n))
        return (whole >> np.uint64(32)).astype(np.uint32), np.zeros(1, np.uint32)
    grams = n - k + 1
    kept = []
    for a in range(0, max(1, grams - w + 1), SEGMENT):
        b = min(grams, a + SEGMENT + w - 1)  # grams a..b hold the windows that start in this segment
        h = rolling_hash(codes[a : b + k - 1], k)
        at = np.arange(a, b, dtype=np.uint64)
        key = (h & ~_LOW) | (_LOW - at)  # ties: the larger position makes the smaller key
        kept.append(np.unique(sliding_min(key, min(w, len(key)))))
    keys = np.concatenate(kept)
    pos = (_LOW - (keys & _LOW)).astype(np.uint32)
    order = np.argsort(pos, kind="stable")
    pos, hashes = pos[order], (keys >> np.uint64(32)).astype(np.uint32)[order]
    first = np.ones(len(pos), bool)
    first[1:] = pos[1:] != pos[:-1]
    return hashes[first], pos[first]


def encode(hashes: np.ndarray, pos: np.ndarray) -> str:
    """Base64 of records (hash uint32, distance to the position before uint16), little-endian."""
    rec = np.empty(len(pos), [("h", "<u4"), ("d", "<u2")])
    rec["h"], rec["d"] = hashes, np.diff(pos, prepend=np.uint32(0)) if len(pos) else pos
    return base64.b64encode(rec.tobytes()).decode()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    rec = np.frombuffer(base64.b64decode(fingerprint), [("h", "<u4"), ("d", "<u2")])
    return rec["h"].copy(), np.cumsum(rec["d"], dtype=np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two sorted arrays of distinct hashes; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(a) + len(b) - common)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pairs(k: int, w: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # (block, doc_id, text, hashes, positions, set) that waits for the next document

        def row(cur, nxt):
            text = cur[2]
            other = edited(text, nxt[2])
            if other == text:
                eh, ep, es = cur[3], cur[4], cur[5]
            else:
                eh, ep = winnow(other, k, w)
                es = np.unique(eh)
            sha = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
            return (cur[1], len(text), sha, encode(cur[3], cur[4]), encode(eh, ep), likeness(cur[5], es), likeness(cur[5], nxt[5]), len(cur[3]))

        for pdf in batches:
            out = []
            for block, doc_id, text, guest in zip(pdf["block"], pdf["doc_id"], pdf["text"], pdf["guest"]):
                if guest and (held is None or held[0] != block):
                    continue  # the end of this block has been answered
                h, p = winnow(text, k, w)
                new = (block, None if pd.isna(doc_id) else int(doc_id), text, h, p, np.unique(h))
                if held is not None and held[0] == block:
                    out.append(row(held, new))
                held = None if guest else new
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})

    return run


def document_fingerprints(docs: DataFrame, k: int = K, w: int = W, blocks: int | None = None) -> DataFrame:
    """One row per document: see the module. ``blocks``: id ranges, read one after another by tasks."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    n = blocks or min(2 * shuffle_partitions(spark), MAX_BLOCKS)
    ids = docs.select("doc_id").where("doc_id is not null")
    cuts = sorted({int(x) for x in ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)}, reverse=True) if n > 1 else []
    # block 0 holds the largest ids; n bounds the cuts, so this array of literals is small
    block = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(
        F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > F.col("doc_id"))) if cuts else F.lit(0)
    )
    docs = docs.withColumn("block", block.cast("int"))
    # the first document of every block: at most one row a block
    heads = docs.select("block", "doc_id").groupBy("block").agg(F.max("doc_id").alias("head")).orderBy("block").collect()
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    before = {r["block"]: heads[i - 1]["block"] for i, r in enumerate(heads)}  # the first block follows the last
    guests = F.lit(None).cast("int")
    for_head = [(r["block"], r["head"], before[r["block"]]) for r in heads]
    home = F.create_map(*[F.lit(x) for b, _, to in for_head for x in (b, to)])
    largest = F.create_map(*[F.lit(x) for b, h, _ in for_head for x in (b, h if h is not None else -1)])
    is_head = F.col("doc_id").eqNullSafe(F.when(F.col("doc_id").isNotNull(), largest[F.col("block")]))
    guests = F.when(is_head, home[F.col("block")])
    sent = docs.select(
        F.explode(F.array_compact(F.array(F.struct(F.col("block").alias("block"), F.lit(False).alias("guest")), F.when(guests.isNotNull(), F.struct(guests.alias("block"), F.lit(True).alias("guest")))))).alias("to"),
        "doc_id",
        "text",
    ).select("to.block", "to.guest", "doc_id", "text")
    dealt = sent.repartition(n, "block").sortWithinPartitions("block", "guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    return dealt.mapInPandas(_pairs(k, w), SCHEMA)
