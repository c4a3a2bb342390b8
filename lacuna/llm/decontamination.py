"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Words are runs of ASCII digits, ASCII letters (lower-cased) and characters beyond ASCII. An item's windows are its
``size`` consecutive words; an item with fewer words, but not none, is one window. A document contains a window if the
window's words stand in it one after the other, and every word of such a place is hit.

A window is a set of shingles (``SHINGLE`` words; a shorter window is one shingle). Containment must be whole, so any one
shingle of a window is a necessary prefix of it: the rarest one over all documents is taken, its anchor. What then happens:

1. the shingles that benchmark windows have are counted over all documents, and each window gets its anchor;
2. documents are read once more: the places of anchors are kept, with the words that a window around them could reach;
3. a place gives a row for each length and offset that a window with such an anchor may have, if that window begins and
   ends inside the document (positional and length bounds); it meets the windows by hash and offset, and its words are
   compared with theirs one by one.

The scans test shingles against a bitmap of at most ``BITS`` bits that travels with the plan, so a document gives rows
only for what may be in the benchmark; the joins behind it are exact, whatever the bitmap lets through. Texts are never
shuffled. What is joined is left to Spark: benchmark tables are broadcast only if they are found to be small.

Null texts have no words, like empty ones; items without words have no windows. Rows that repeat an id, and null ids,
are documents of their own. Item ids that repeat are one item with all their texts' windows; a null item_id is an item
named "". A text of any length is one row; what is kept of it grows with its anchors' places. Ties for the rarest shingle
go to the smaller hash, then to the earlier place. Other columns of either table don't matter, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import materialize

SIZE = 10  #: words in a window
SHINGLE = 3  #: words in a shingle
BITS = 1 << 22  #: of the bitmap, at most

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: beside ASCII, lower-case letters and punctuation that lower() leaves alone; texts of these alone may go through it
PLAIN = r"^[\x00-\x7Fß-ÿ‐-‧]*$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).when(text.rlike(PLAIN), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _places(w: Column, k: int) -> Column:
    """The places at which k words begin."""
    return F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))


def _shingle(w: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(w, at + i) for i in range(k)])


def windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """item, words: the distinct windows of every item."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return items.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at") + 1, size).alias("words")).distinct()


def _bitmap(hashes: DataFrame) -> tuple[Column, int]:
    """Bits at ``h`` modulo their number, as a constant array of 64-bit words, and that number."""
    n = hashes.count()
    bits = min(BITS, max(1 << 12, 1 << (64 * n).bit_length()))
    word, bit = F.call_function("shiftright", F.col("h"), F.lit(6)).bitwiseAND(bits // 64 - 1), F.col("h").bitwiseAND(63).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    found = hashes.groupBy(word.alias("word")).agg(F.bit_or(one).alias("bits")).collect()  # BITS / 64 rows at most
    of = {r["word"]: r["bits"] for r in found}
    return F.split(F.lit(",".join(str(of.get(i, 0)) for i in range(bits // 64))), ",").cast("array<bigint>"), bits


def _has(bitmap: tuple[Column, int], h: Column) -> Column:
    array, bits = bitmap
    return F.call_function("bit_get", F.get(array, F.call_function("shiftright", h, F.lit(6)).bitwiseAND(bits // 64 - 1).cast("int")), h.bitwiseAND(63).cast("int")) == 1


def _known(k: int, bitmap: tuple[Column, int]) -> Column:
    """The places of ``w`` whose shingle of k words the bitmap has."""
    return F.filter(_places(F.col("w"), k), lambda at: _has(bitmap, _shingle(F.col("w"), at, k)))


def _hashes(k: int, bitmap: tuple[Column, int]) -> Column:
    return F.transform(_known(k, bitmap), lambda at: _shingle(F.col("w"), at, k))


def _surroundings(k: int, bitmap: tuple[Column, int], reach: int) -> Column:
    """Of the same places k, at, and the words from first, ``reach`` before it, to ``reach`` behind the shingle."""
    first = lambda at: F.greatest(at - reach, F.lit(0))
    return F.transform(_known(k, bitmap), lambda at: F.struct(F.lit(k).alias("k"), at.alias("at"), first(at).alias("first"), F.slice(F.col("w"), first(at) + 1, at + k + reach - first(at)).alias("words")))


def anchored(docs: DataFrame, found: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """win, words, n, k, offset, anchor: each distinct window with its rarest shingle's hash and place in it."""
    wins = materialize(found.select("words").distinct().withColumn("win", F.monotonically_increasing_id()), "bench-windows")
    n = F.size("words")
    each = wins.select("win", "words", n.alias("n"), F.least(n, F.lit(shingle)).alias("k")).withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("k"))))
    h = reduce(lambda out, k: F.when(F.col("k") == k, _shingle(F.col("words"), F.col("offset"), k)).otherwise(out), range(2, shingle + 1), _shingle(F.col("words"), F.col("offset"), 1))
    each = materialize(each.withColumn("h", h), "bench-shingles")
    lengths = [r["k"] for r in each.select("k").distinct().collect()]  # ``shingle`` rows at most
    texts = docs.select(words(F.col("text")).alias("w"))
    counts = []
    for k in sorted(lengths):
        bitmap = _bitmap(each.where(F.col("k") == k).select("h").distinct())
        counts.append(texts.select(F.explode(_hashes(k, bitmap)).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("places")).withColumn("k", F.lit(k)))
    if not counts:
        return each.select("win", "words", "n", "k", "offset", F.col("h").alias("anchor"))
    rows = each.join(reduce(DataFrame.unionByName, counts), ["k", "h"], "left")
    best = F.min_by(F.struct("words", "n", "k", "offset", F.col("h").alias("anchor")), F.struct(F.coalesce("places", F.lit(0)), "h", "offset"))
    return materialize(rows.groupBy("win").agg(best.alias("b")).select("win", "b.*"), "bench-anchors")


def hits(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: row, doc_id, n_words of every document; row, start, n, win of each window's place; win, item."""
    found = materialize(windows(benchmark, size), "bench-items")
    wins = anchored(docs, found, size, shingle)
    shapes = [(r["k"], r["n"], r["offset"]) for r in wins.select("k", "n", "offset").distinct().collect()]  # size * size rows at most
    texts = docs.select("doc_id", words(F.col("text")).alias("w"))
    nothing = F.array().cast("array<struct<k:int,at:int,first:int,words:array<string>>>")
    kept = [nothing]
    for k in sorted({k for k, _, _ in shapes}):
        bitmap = _bitmap(wins.where(F.col("k") == k).select(F.col("anchor").alias("h")).distinct())
        kept.append(_surroundings(k, bitmap, size - k))
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("w").alias("n_words"), F.concat(*kept).alias("places"))
    rows = materialize(rows, "bench-places")
    # a shape's window around an anchor's place, if it lies inside the document
    shape = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n"), F.lit(o).alias("offset")) for k, n, o in shapes]) if shapes else F.array().cast("array<struct<k:int,n:int,offset:int>>")
    at = rows.where(F.size("places") > 0).select("row", F.explode("places").alias("p")).select("row", "p.*")
    inside = F.filter(shape, lambda s: (s["k"] == F.col("k")) & (F.col("at") - s["offset"] >= F.col("first")) & (F.col("at") - s["offset"] - F.col("first") + s["n"] <= F.size("words")))
    at = at.select("row", "at", "first", "words", F.explode(inside).alias("s"))
    at = at.select("row", (F.col("at") - F.col("s.offset")).alias("start"), "s.n", "s.offset", F.slice("words", F.col("at") - F.col("s.offset") - F.col("first") + 1, F.col("s.n")).alias("there"))
    at = at.withColumn("key", F.xxhash64("there"))
    own = wins.select("win", "words", "offset", F.xxhash64("words").alias("key"))
    places = at.join(own, ["key", "offset"]).where(F.col("there") == F.col("words")).select("row", "start", "n", "win")
    items = found.withColumn("key", F.xxhash64("words")).join(own.select("win", "key", F.col("words").alias("own")), "key").where(F.col("words") == F.col("own")).select("win", "item")
    return rows.select("row", "doc_id", "n_words"), places, items


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a row for every row of ``docs`` (doc_id, text).

    items_sha256 is that of the ids of items with a window in the document, in the order of strings, joined by commas.
    ``benchmark``: item_id, text.
    """
    rows, places, items = hits(docs, benchmark, size, shingle)
    places = materialize(places, "bench-hits")
    # words under at least one of the places of a document, which lie inside it
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["upto"], s["start"] + s["n"]).alias("upto"), (a["n"] + F.greatest(s["start"] + s["n"] - F.greatest(a["upto"], s["start"]), F.lit(0))).alias("n")),
        lambda a: a["n"],
    )
    hit = places.groupBy("row").agg(F.collect_set(F.struct("start", "n")).alias("spans")).select("row", covered.alias("n_hit"))
    named = places.select("row", "win").distinct().join(items, "win").select("row", "item").distinct()
    named = named.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("ids"))
    out = rows.join(hit.join(named, "row"), "row", "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def oracle(size: int = SIZE) -> str:
    """DuckDB SQL: every window of every document against the items' windows, as lists of words."""
    split = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents),
        b AS (SELECT item_id, {split} AS w FROM benchmark),
        wins AS (
            SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, w[i + 1 : i + {size}] AS win
            FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - {size}, 0) + 1)) AS i FROM b WHERE len(w) > 0)
        ),
        sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
        spots AS (SELECT r, n, i, w[i + 1 : i + n] AS win FROM (SELECT r, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS i FROM d, sizes)),
        found AS (SELECT s.r, s.i, s.n, wins.item FROM spots s JOIN wins USING (win)),
        hit AS (SELECT r, count(DISTINCT i + o) AS n_hit FROM (SELECT DISTINCT r, i, unnest(range(0, n)) AS o FROM found) GROUP BY r),
        named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
    """
