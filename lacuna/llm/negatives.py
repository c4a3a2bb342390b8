"""Hard-negative mining on an inverted multi-index: exact windows of scores, certified by bounds.

Vectors are taken as whole numbers (``SCALE`` times each component, rounded down) and scored by inner product with an
anchor. Each half of the components has a codebook, fitted by k-means to a bounded sample; a pair of codewords is a cell,
and every vector lies in one. Over all vectors the largest distance to its codeword is the radius of each codeword, so for
an anchor q no vector of cell (a, b) scores above

    <q1, c1[a]> + |q1| r1[a] + <q2, c2[b]> + |q2| r2[b].

For each anchor a heap visits the cells in the order of that sum (the two halves' bounds are sorted, and a cell's
neighbours are pushed when it is taken). The search has two rounds, for positives and again for negatives. The first looks
into the best cells, until they hold ``probe`` vectors; what it finds is a floor for what is wanted. The second visits the
rest and stops when the next bound is below that floor, which certifies the result. For negatives the floor is each window's
tenth best, or the window's lower end while it has fewer; cells whose lower bound is above all windows are passed over.
Where vectors have no structure the bounds exclude little, and the second round sees most cells; it stays exact.

Cells are dealt to shards of about ``part`` vectors, a larger cell to several, and an anchor goes, in blocks of anchors, to
the shards that hold its cells. A shard returns at most as many rows for an anchor and window as are wanted.

Vectors equal in components and label are one row with their smallest ids, and anchors equal in both are searched once, so
neither a vector that repeats nor one that many anchors share costs more than one. Vectors that are null or empty, hold a
null or non-finite component or have another dimension than most take no part, nor do rows with a null id or label. Of rows
that repeat an id, the one with the smallest label, then vector, counts. Ties go to the smaller id. A positive score below
zero has no negatives, as its window is empty. Components beyond 64 bits count as the nearest that fits, scores too. An
empty table, or one without anchors, gives no rows; columns beside vec_id, embedding and label don't matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.llm.common import materialize
from lacuna.llm.neighbours import kmeans, shards_of

SCALE = 256
SAMPLE = 8_000  #: vectors that codebooks are fitted on, at most
CODEWORDS = 256  #: of a half, at most
PER_CELL = 32  #: vectors in a cell, about, below that
PROBE = 1024
PART = 8192
BLOCK = 2048
IDS = 11  #: of equal rows that can matter: as many as are wanted, and the anchor itself
LIMIT = 2**63 - 1

ROWS = "vec array<long>, label long, ids array<long>, cell long, d1 double, d2 double"
FOUND = "ask long, window long, vec_id long, score long"


def usable(vectors: DataFrame) -> DataFrame:
    """id, label, vec of the rows that take part: whole numbers, every id once."""
    x = F.col("embedding").cast("array<double>")
    ok = (F.size("vec") > 0) & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), x.alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()).where(ok)
    rows = rows.withColumn("vec", F.transform("vec", lambda v: F.floor(v * F.lit(float(SCALE)))))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r")).select("id", "r.*")
    dims = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    return rows.where(F.size("vec") == dims[0]["dim"]) if dims else rows


def grouped(rows: DataFrame, salts: int = 64) -> DataFrame:
    """vec, label, ids: equal rows as one, with their ``IDS`` smallest ids; in two steps, so that no vector's rows meet in one task."""
    salted = Window.partitionBy("key", "vec", "label", "salt").orderBy("id")
    few = rows.withColumn("key", F.xxhash64("vec", "label")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    few = few.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= IDS)
    return few.groupBy("key", "vec", "label").agg(F.collect_list("id").alias("ids")).select("vec", "label", F.slice(F.array_sort("ids"), 1, IDS).alias("ids"))


class MultiIndex:
    """Two codebooks and, once all vectors are coded, their radii and the number of vectors in every cell."""

    def __init__(self, x: np.ndarray, k: int):
        self.half = -(-x.shape[1] // 2)
        self.books = [kmeans(part, k) if part.shape[1] else np.zeros((1, 0)) for part in self.halves(x)]
        self.radii: list[np.ndarray] = [np.zeros(len(b)) for b in self.books]
        self.filled = np.zeros((len(self.books[0]), len(self.books[1])), np.int64)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Cells, and distances to the codeword by half."""
        codes, far = [], []
        for part, book in zip(self.halves(x), self.books):
            near = np.concatenate([np.argmax(p @ book.T - 0.5 * (book * book).sum(1), 1) for p in np.array_split(part, max(1, len(part) // 4096))])
            codes.append(near)
            far.append(np.sqrt(((part - book[near]) ** 2).sum(1)))
        return codes[0].astype(np.int64) * len(self.books[1]) + codes[1], far

    def bounds(self, q: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Upper and lower bounds of the score by half and codeword, a little wide for rounding."""
        upper, lower = [], []
        for part, book, radius in zip(self.halves(q[None])[0:2], self.books, self.radii):
            middle, reach = (book @ part[0]), float(np.sqrt((part[0] ** 2).sum())) * radius
            slack = 1e-9 * (np.abs(middle) + reach) + 0.5
            upper.append(middle + reach + slack)
            lower.append(middle - reach - slack)
        return upper, lower

    def visit(self, q: np.ndarray) -> Iterator[tuple[float, float, int, int]]:
        """(upper bound, lower bound, cell, vectors) of the cells with vectors, by upper bound, highest first."""
        (u1, u2), (l1, l2) = self.bounds(q)
        o1, o2 = np.argsort(-u1, kind="stable").tolist(), np.argsort(-u2, kind="stable").tolist()
        u1, u2, l1, l2 = u1.tolist(), u2.tolist(), l1.tolist(), l2.tolist()
        heap = [(-(u1[o1[0]] + u2[o2[0]]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < len(o2):
                heapq.heappush(heap, (-(u1[o1[i]] + u2[o2[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(o1):
                heapq.heappush(heap, (-(u1[o1[i + 1]] + u2[o2[0]]), i + 1, 0))
            a, b = o1[i], o2[j]
            if n := int(self.filled[a, b]):
                yield -bound, l1[a] + l2[b], a * len(o2) + b, n

    def cells(self, q: np.ndarray, probe: int, floor: float | None = None, ceiling: float = np.inf) -> list[int]:
        """Without a floor the best cells, until they hold ``probe`` vectors; with one, the rest down to it. Cells whose
        lower bound is above the ceiling hold nothing that is wanted."""
        out, seen = [], 0
        for upper, lower, cell, n in self.visit(q):
            if seen < probe:
                seen += n
                if floor is None and lower <= ceiling:
                    out.append(cell)
            elif floor is None or upper < floor:
                break
            elif lower <= ceiling:
                out.append(cell)
        return out


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers. Doubles are exact below 2**53; Python's integers where they may not be."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * max(q.shape[1], 1)
    if most < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return np.clip(q.astype(object) @ x.astype(object).T, -LIMIT, LIMIT).astype(np.int64)


def _code(index):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cells, (d1, d2) = index.value.encode(np.stack(pdf["vec"].to_list()).astype(float))
                yield pdf.assign(cell=cells, d1=d1, d2=d2)

    return run


def _route(index, shard_of: dict[int, tuple[int, int]], probe: int):
    """A row for each ask and shard with one of its cells. An ask's floor is the least of its windows' floors, null in a first round."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = shard_of.value
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                floor = None if r.floor is None or np.isnan(r.floor) else float(r.floor)
                by_shard: dict[int, list[int]] = {}
                for cell in index.value.cells(np.asarray(r.vec, float), probe, floor, float(r.ceiling)):
                    first, parts = places[cell]
                    for shard in range(first, first + parts):
                        by_shard.setdefault(shard, []).append(cell)
                out += [(r.ask, r.label, r.vec, r.windows, shard, np.array(own, "<i8").tobytes()) for shard, own in by_shard.items()]
            if out:
                yield pd.DataFrame(out, columns=["ask", "label", "vec", "windows", "shard", "cells"])

    return run


def window_of(positive: int, low: int, high: int) -> tuple[int, int]:
    """The whole scores s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def _search(most: int, low: int, high: int):
    """Of a shard's vectors in the ask's cells, the ``most`` best with its label or, for every window, the best with
    another label inside it."""

    def best(score: np.ndarray, ids: list, at: np.ndarray) -> list[tuple[int, int]]:
        out, last = [], None
        for j in at[np.argsort(-score[at], kind="stable")]:
            s = int(score[j])
            if len(out) >= most and s < last:
                break
            last = s
            out += [(-s, int(v)) for v in ids[j]]
        return sorted(out)[:most]

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x, cells, labels, ids = np.stack(right["vec"].to_list()), right["cell"].to_numpy(), right["label"].to_numpy(), right["ids"].to_list()
            for a in range(0, len(left), 64):
                part = left.iloc[a : a + 64]
                scores = exact_scores(np.stack(part["vec"].to_list()), x)
                for score, r in zip(scores, part.itertuples(index=False)):
                    mine = np.isin(cells, np.frombuffer(r.cells, "<i8"))
                    if r.windows is None:
                        out += [(r.ask, None, v, -s) for s, v in best(score, ids, np.nonzero(mine & (labels == r.label))[0])]
                        continue
                    mine &= labels != r.label
                    for p in r.windows:
                        lo, hi = window_of(int(p), low, high)
                        out += [(r.ask, int(p), v, -s) for s, v in best(score, ids, np.nonzero(mine & (score >= lo) & (score <= hi))[0])]
        columns = ["ask", "window", "vec_id", "score"]
        return pd.DataFrame({c: pd.array([r[i] for r in out], dtype="Int64") for i, c in enumerate(columns)})

    return run


def _top(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("ask", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


class Searcher:
    """The coded rows of a table in shards, and searches over them."""

    def __init__(self, rows: DataFrame, n: int, sample: int, part: int, block: int, probe: int):
        spark = rows.sparkSession
        self.probe, self.block, self.spark = probe, block, spark
        drawn = np.array([r["vec"] for r in rows.select("vec").orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(sample).collect()], float)
        k = int(max(1, min(CODEWORDS, len(drawn) // 16, round((n / PER_CELL) ** 0.5))))
        index = MultiIndex(drawn, k)
        self.coded = materialize(rows.mapInPandas(_code(spark.sparkContext.broadcast(index)), ROWS), "negatives-index")
        width = len(index.books[1])
        code = F.floor(F.col("cell") / width), F.col("cell") % width
        for i in (0, 1):  # CODEWORDS rows at most
            for r in self.coded.groupBy(code[i].cast("int").alias("c")).agg(F.max(f"d{i + 1}").alias("r")).collect():
                index.radii[i][r["c"]] = r["r"]
        sizes = {r["cell"]: r["count"] for r in self.coded.groupBy("cell").count().collect()}  # CODEWORDS**2 rows at most
        for cell, count in sizes.items():
            index.filled[cell // width, cell % width] = count
        first, parts = shards_of(sizes, index.filled.size, part)
        self.index = spark.sparkContext.broadcast(index)
        self.places = spark.sparkContext.broadcast({c: (int(first[c]), int(parts[c])) for c in sizes})
        table = spark.createDataFrame([(int(c), int(first[c]), int(parts[c])) for c in sizes], "cell long, first long, parts long")
        placed = self.coded.drop("d1", "d2").join(F.broadcast(table), "cell")
        self.rows = placed.withColumn("shard", F.col("first") + F.pmod(F.xxhash64(F.col("ids")[0], F.lit(3)), F.col("parts"))).drop("first", "parts")

    def search(self, asks: DataFrame, most: int, low: int, high: int) -> DataFrame:
        """ask, window, vec_id, score. ``asks``: ask, label, vec, windows (null for the anchor's own label), floor, ceiling."""
        routed = asks.mapInPandas(_route(self.index, self.places, self.probe), "ask long, label long, vec array<long>, windows array<long>, shard long, cells binary")
        routed = materialize(routed, "negatives-routed")
        blocks = routed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / self.block).cast("long").alias("blocks"))
        left = routed.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("ask"), F.col("blocks"))).drop("blocks")
        right = self.rows.join(blocks, "shard").withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).drop("blocks")
        by = ("shard", "block")
        found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_search(most, low, high), FOUND)
        return materialize(_top(found, most).drop("rank"), "negatives-found")

    def certified(self, asks: DataFrame, most: int, low: int, high: int, floor: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Both rounds. ``floor`` makes ask, floor of what the first one found."""
        asks = materialize(asks, "negatives-asks")
        near = self.search(asks.withColumn("floor", F.lit(None).cast("double")), most, low, high)
        rest = self.search(asks.join(floor(near), "ask", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), most, low, high)
        return materialize(_top(near.unionByName(rest), most), "negatives-best")


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, sample: int = SAMPLE, part: int = PART, block: int = BLOCK, probe: int = PROBE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` and ``anchors``: id, label, vec (whole numbers, one dimension; as ``usable`` gives them). For each anchor and
    each of its ``positives`` best other rows of its label, the ``negatives`` best rows of other labels whose score is at
    least ``low`` and at most ``high`` hundredths of the positive's. At most ``IDS`` - 1 of either can be asked for.
    """
    if max(positives, negatives) >= IDS:
        raise ValueError(f"at most {IDS - 1} positives and negatives")
    spark: SparkSession = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    own = materialize(grouped(rows), "negatives-rows")
    anchors = materialize(anchors.select(F.col("id").alias("anchor_id"), "label", "vec"), "negatives-anchors")
    n = own.count()
    if not n or not anchors.limit(1).count():
        return spark.createDataFrame([], schema)
    searcher = Searcher(own, n, sample, part, block, probe)
    # anchors equal in vector and label are one ask
    asks = materialize(anchors.groupBy("label", "vec").agg(F.min("anchor_id").alias("ask")), "negatives-asked")
    named = anchors.join(asks, ["label", "vec"]).select("anchor_id", "ask")

    wanted = positives + 1  # the anchor may be among them
    sixth = lambda found: found.groupBy("ask").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") >= wanted).select("ask", "floor")
    first = asks.select("ask", "label", "vec", F.lit(None).cast("array<long>").alias("windows"), F.lit(float("inf")).alias("ceiling"))
    near = searcher.certified(first, wanted, low, high, sixth).select("ask", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))

    top = F.floor(F.array_max("windows") * high / 100).cast("double") + 1
    windows = near.where("positive_score >= 0").groupBy("ask").agg(F.collect_set("positive_score").alias("windows"))
    second = asks.join(windows, "ask").select("ask", "label", "vec", "windows", top.alias("ceiling"))

    def least(found: DataFrame) -> DataFrame:
        full = found.groupBy("ask", "window").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("score")).where(F.col("n") >= negatives)
        each = windows.select("ask", F.explode("windows").alias("window")).join(full, ["ask", "window"], "left")
        return each.groupBy("ask").agg(F.min(F.coalesce("score", F.floor(F.col("window") * low / 100).cast("double") - 1)).alias("floor"))

    far = searcher.certified(second, negatives, low, high, least).select("ask", F.col("window").alias("positive_score"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    pairs = named.join(near, "ask").where("anchor_id <> positive_id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    return pairs.join(far, ["ask", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query_rows(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registered query's rows (labels of ids that 7 divides moved on by one of ten) and anchors (ids that 100 divides)."""
    rows = usable(vectors).withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    rows = materialize(rows, "negatives-usable")
    return rows, rows.where(F.col("id") % 100 == 0)


def oracle() -> str:
    """DuckDB SQL: every anchor against every row (ids that don't repeat)."""
    return f"""
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS vec
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same, list_inner_product(a.vec, c.vec)::BIGINT AS score
            FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
        ),
        p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
        QUALIFY row_number() OVER w <= 10
    """
