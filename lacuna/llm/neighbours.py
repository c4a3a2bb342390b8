"""Approximate nearest neighbours by inner product: inverted file, product-quantised residuals, exact reranking.

Coarse centroids and the quantiser's codebooks are fitted on a bounded sample (``sample`` vectors in the order of a
hash of the id); every vector is indexed: it goes to the list of its nearest centroid, and its residual is coded by
the nearest codeword of each subspace. A query looks into its ``probes`` best lists, and into further ones until
these hold k vectors beside its own, so no query finds fewer than there are; there a table of inner products
with all codewords scores every code, and the best ``rerank`` of a shard are scored again on the original vectors, in
double precision. ``probes`` and ``rerank`` are measured on the table itself: ``tried`` of the queries are answered by
brute force against every vector, and the two are the least numbers (``rerank`` no less than the one given) that keep
the share ``aim`` of these neighbours each. So they hold for rows that the sample did not fit, for vectors of
different lengths, and for clusters that are tighter than the codes.

Vectors are first made distinct, each with its ids; of one vector's ids the k + 1 smallest can matter, so a vector
that repeats many times costs no more than one (ties go to the smaller id). Small lists share a shard of about ``part``
vectors, long ones are cut into several, and the queries of a shard into blocks, so no task holds more than a shard
and a block. No step emits all pairs: a shard returns at most k rows a query.

Vectors that are null, zero, of another dimension than most, or hold a null or non-finite component take no part.
Null ids take no part. Of rows that repeat an id with different vectors each counts; a query's own id is never its
neighbour. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import materialize

SAMPLE = 12_000  #: vectors that centroids and codebooks are fitted on, at most
SUBSPACES = 16
CODEWORDS = 64
PART = 8192  #: vectors that are searched together, of one or more lists
BLOCK = 4096  #: queries that are answered together
RERANK = 256
TRIED = 256  #: queries that are answered by brute force, to measure how far to look
AIM = 0.99  #: of the true neighbours that the lists looked into hold, and of these that are scored again

SCHEMA = "query_id long, vec_id long, score double"


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), 1)
        n = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        at = np.searchsorted(near[order], np.arange(len(c)))
        sums = np.add.reduceat(x[order], np.minimum(at, len(x) - 1), 0)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), len(c))])
    return c


class Index:
    """Centroids, and codebooks by subspace (columns padded to a multiple)."""

    def __init__(self, x: np.ndarray, lists: int, subspaces: int = SUBSPACES, codewords: int = CODEWORDS):
        self.dim = x.shape[1]
        self.m = min(subspaces, self.dim)
        self.width = -(-self.dim // self.m)
        self.centroids = kmeans(x, lists)
        rest = self.padded(x - self.centroids[self.nearest(x)])
        self.books = np.stack([kmeans(rest[:, i * self.width : (i + 1) * self.width], codewords, 8) for i in range(self.m)])

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.m * self.width - self.dim)))

    def nearest(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.int32)
        for a in range(0, len(x), 8192):
            out[a : a + 8192] = np.argmax(x[a : a + 8192] @ self.centroids.T - 0.5 * (self.centroids**2).sum(1), 1)
        return out

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = self.padded(x - self.centroids[lists])
        out = np.empty((len(x), self.m), np.uint8)
        for i in range(self.m):
            b = self.books[i]
            out[:, i] = np.argmax(rest[:, i * self.width : (i + 1) * self.width] @ b.T - 0.5 * (b * b).sum(1), 1)
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """[query, subspace, codeword]: inner products."""
        p = self.padded(q).reshape(len(q), self.m, self.width)
        return np.einsum("qmw,mcw->qmc", p, self.books)

    def order(self, q: np.ndarray) -> np.ndarray:
        """[query, lists]: all lists, best first."""
        return np.argsort(-(q @ self.centroids.T), 1, kind="stable")

    def best_lists(self, q: np.ndarray, sizes: np.ndarray, least: int, probes: int) -> list[np.ndarray]:
        """For each query, its ``probes`` best lists, or as many as hold ``least`` vectors (all, if there are fewer)."""
        order = self.order(q)
        need = (np.cumsum(sizes[order], 1) < least).sum(1) + 1
        return [own[:n] for own, n in zip(order, np.maximum(need, probes))]


def valid(vectors: DataFrame) -> DataFrame:
    """id, vec (array<double>) of the vectors that take part."""
    vec = F.col("embedding").cast("array<double>")
    ok = F.size("vec") > 0
    ok &= F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok &= F.exists("vec", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(ok)


def distinct_vectors(rows: DataFrame, k: int, salts: int = 64) -> DataFrame:
    """vec, ids: each distinct vector with its k + 1 smallest ids, in two steps so that no vector's rows meet in one task."""
    smallest = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, k + 1)
    salted = Window.partitionBy("key", "vec", "salt").orderBy("id")
    keyed = rows.withColumn("key", F.xxhash64("vec")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    few = keyed.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
    return few.groupBy("key", "vec").agg(F.collect_list("id").alias("ids")).select("vec", smallest(F.col("ids")).alias("ids"))


def _assign(index):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = index.value
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["vec"].to_list())
            lists = ix.nearest(x)
            codes = ix.encode(x, lists)
            yield pd.DataFrame({"ids": pdf["ids"], "vec": pdf["vec"], "list": lists, "code": [c.tobytes() for c in codes]})

    return run


def shards_of(sizes: dict[int, int], lists: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, number of shards) of each list: runs of small lists share a shard of about ``part`` vectors, a
    larger list has several of its own."""
    first, parts = np.zeros(lists, np.int64), np.ones(lists, np.int64)
    shard, room = 0, part
    for i in range(lists):
        n = sizes.get(i, 0)
        if n > part:
            shard += room < part
            first[i], parts[i] = shard, -(-n // part)
            shard, room = shard + parts[i], part
        else:
            if n > room:
                shard, room = shard + 1, part
            first[i] = shard
            room -= n
    return first, parts


def _brute(tried, k: int):
    """Of each task's vectors the k nearest of each tried query, with the list they are in; its own alone is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = tried.value
        score, lists, vec_ids = np.empty((len(q), 0)), np.empty((len(q), 0), np.int64), np.empty((len(q), 0), np.int64)
        for pdf in batches:
            if not len(pdf):
                continue
            new = q @ np.stack(pdf["vec"].to_list()).T
            firsts = np.array([i[0] for i in pdf["ids"]], np.int64)
            alone = np.array([len(i) == 1 for i in pdf["ids"]])
            new[(names[:, None] == firsts) & alone] = -np.inf
            score = np.concatenate([score, new], 1)
            lists = np.concatenate([lists, np.broadcast_to(pdf["list"].to_numpy(np.int64), new.shape)], 1)
            vec_ids = np.concatenate([vec_ids, np.broadcast_to(firsts, new.shape)], 1)
            if score.shape[1] > k:
                best = np.argpartition(-score, k - 1, 1)[:, :k]
                score, lists, vec_ids = (np.take_along_axis(a, best, 1) for a in (score, lists, vec_ids))
        r, c = np.nonzero(score > -np.inf)
        yield pd.DataFrame({"query": r, "list": lists[r, c], "vec_id": vec_ids[r, c], "score": score[r, c]})

    return run


def _route(index, first: np.ndarray, parts: np.ndarray, held: np.ndarray, least: int, probes: int):
    """A row for each query and shard that holds one of its lists, with those lists."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = index.value
        for pdf in batches:
            if not len(pdf):
                continue
            out = []
            for query, vec, near in zip(pdf["id"], pdf["vec"], ix.best_lists(np.stack(pdf["vec"].to_list()), held, least, probes)):
                near = np.sort(near)
                at = np.nonzero(np.diff(first[near], prepend=-1))[0]
                for own in np.split(near, at[1:]):
                    for shard in range(first[own[0]], first[own[0]] + parts[own[0]]):
                        out.append((query, vec, shard, own.astype("<i4").tobytes()))
            yield pd.DataFrame(out, columns=["id", "vec", "shard", "lists"])

    return run


def _code_scores(ix: Index, left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first query, queries, [query, vector]: inner products by codes) of 64 queries at a time; -inf in lists that a
    query doesn't look into."""
    q = np.stack(left["vec"].to_list())
    codes = np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), -1)
    flat = np.ascontiguousarray((codes.astype(np.int64) + np.arange(codes.shape[1]) * ix.books.shape[1]).T)
    lists, member = np.unique(right["list"].to_numpy(), return_inverse=True)
    for a in range(0, len(q), 64):
        part = q[a : a + 64]
        n = len(part)
        tables = ix.tables(part).reshape(n, -1).astype(np.float32)
        base = np.full((n, len(lists)), -np.inf, np.float32)  # the centroids' share of the inner product
        for r, own in enumerate(left["lists"].iloc[a : a + 64]):
            own = np.searchsorted(lists, np.intersect1d(lists, np.frombuffer(own, "<i4")))
            base[r, own] = ix.centroids[lists[own]] @ part[r]
        score = base[:, member]
        for row in range(flat.shape[0]):
            score += tables[:, flat[row]]
        yield a, part, score


def _depth(index, true: dict[int, set[int]]):
    """query_id, depth: how far down by codes each true neighbour is among the vectors of its shard."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            firsts, names = np.array([i[0] for i in right["ids"]], np.int64), left["id"].to_list()
            for a, part, score in _code_scores(index.value, left, right):
                for r in range(len(part)):
                    for j in np.nonzero(np.isin(firsts, list(true[names[a + r]])) & (score[r] > -np.inf))[0]:
                        out.append((names[a + r], int((score[r] >= score[r, j]).sum())))
        return pd.DataFrame(out, columns=["query_id", "depth"])

    return run


def _search(index, k: int, rerank: int):
    columns = ["query_id", "vec_id", "score"]

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=columns)
        ix = index.value
        x = np.stack(right["vec"].to_list())
        ids, names = right["ids"].to_list(), left["id"].to_list()
        out = []
        for a, part, score in _code_scores(ix, left, right):
            n = len(part)
            near = np.argpartition(-score, rerank - 1, 1)[:, :rerank] if rerank < len(x) else np.tile(np.arange(len(x)), (n, 1))
            # inner products summed component by component: a pair's score is the same wherever it is computed
            true = np.zeros(near.shape)
            for i in range(x.shape[1]):
                true += part[:, i, None] * x[near, i]
            true[np.isinf(np.take_along_axis(score, near, 1))] = -np.inf
            for r in range(n):
                # best vectors first, all ids of each; vectors that tie with the last one count too
                taken, last = [], None
                for j in np.argsort(-true[r], kind="stable"):
                    s = true[r, j]
                    if s == -np.inf or len(taken) >= k and s < last:
                        break
                    last = s
                    taken += [(-s, v) for v in ids[near[r, j]] if v != names[a + r]]
                out += [(names[a + r], v, -s) for s, v in sorted(taken)[:k]]
        return pd.DataFrame(out, columns=columns)

    return run


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, sample: int = SAMPLE, rerank: int = RERANK, part: int = PART, block: int = BLOCK, aim: float = AIM, tried: int = TRIED) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found in ``vectors`` of each row of ``queries``, nearest first.

    Both have vec_id and embedding.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = valid(vectors)
    sizes = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return empty
    dim = sizes[0]["dim"]
    rows = materialize(distinct_vectors(rows.where(F.size("vec") == dim), k), "ann-vectors")
    asked = valid(queries).where(F.size("vec") == dim)
    n = rows.count()
    drawn = np.array([r["vec"] for r in rows.select("vec").orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(sample).collect()])
    lists = int(max(1, min(4096, len(drawn) // 8, round(2 * n**0.5))))
    index = spark.sparkContext.broadcast(Index(drawn, lists))  # 4096 centroids and SUBSPACES * CODEWORDS codewords at most
    coded = rows.mapInPandas(_assign(index), "ids array<long>, vec array<double>, list int, code binary")
    coded = materialize(coded, "ann-index")
    sizes = {r["list"]: r["count"] for r in coded.groupBy("list").count().collect()}  # a row a list
    first, parts = shards_of(sizes, len(index.value.centroids), part)
    held = np.array([sizes.get(i, 0) for i in range(len(first))], np.int64)
    place = F.array(*[F.lit(int(v)) for v in first])[F.col("list")], F.array(*[F.lit(int(v)) for v in parts])[F.col("list")]
    coded = coded.withColumn("shard", place[0].cast("long") + F.pmod(F.xxhash64(F.col("ids")[0], F.lit(3)), place[1]))

    def meet(queries: DataFrame, probes: int, task, schema: str) -> DataFrame:
        """``task`` over each shard and block: a shard's queries come in blocks; its vectors go to each."""
        route = _route(index, first, parts, held, k + 1, probes)
        routed = materialize(queries.mapInPandas(route, "id long, vec array<double>, shard long, lists binary"), "ann-routed")
        blocks = routed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
        left = routed.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        right = coded.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        by = ("shard", "block")
        return left.select(*by, "id", "vec", "lists").groupBy(*by).cogroup(right.select(*by, "ids", "vec", "list", "code").groupBy(*by)).applyInPandas(task, schema)

    # how far to look: some queries by brute force
    some = asked.orderBy(F.xxhash64("id"), "id").limit(tried).dropDuplicates(["id"]).collect()
    if not some:
        return empty
    names, q = np.array([r["id"] for r in some], np.int64), np.array([r["vec"] for r in some])
    true = coded.mapInPandas(_brute(spark.sparkContext.broadcast((names, q)), k), "query int, list int, vec_id long, score double")
    true = true.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k).collect()
    probes = 1
    if true:
        rank = np.argsort(index.value.order(q), 1)
        need = [rank[r["query"], r["list"]] for r in true]
        probes = int(np.quantile(need, aim, method="higher")) + 1
        own: dict[int, set[int]] = {int(i): set() for i in names}
        for r in true:
            own[int(names[r["query"]])].add(r["vec_id"])
        sample_of = spark.createDataFrame([(int(r["id"]), r["vec"]) for r in some], "id long, vec array<double>")
        depths = [r["depth"] for r in meet(sample_of, probes, _depth(index, own), "query_id long, depth long").collect()]  # tried * k at most
        rerank = max(rerank, int(np.quantile(depths, aim, method="higher"))) if depths else rerank
    found = meet(asked, probes, _search(index, k, rerank), SCHEMA)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def divisible_queries(vectors: DataFrame, by: int = 20) -> DataFrame:
    return vectors.where(F.col("vec_id") % by == 0)
