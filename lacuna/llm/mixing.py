"""Mixing sources to target weights over a tree of domains, languages and sources.

Every node of the tree has a weight among its siblings. A token budget goes from the root to the leaves in
proportion to the weights. A node cannot take more than its documents hold, ``max_epochs`` times over; what it
leaves goes to its siblings, by their weights, and to other branches only when the whole branch is full. Among
siblings that is the level ``x`` at which sum(min(capacity, x * weight)) meets the budget, found with window sums
over the siblings in order of capacity / weight.

A leaf then takes a prefix of its documents in seeded order: all of them once for each whole epoch that its
budget holds, and from the next epoch, which has an order of its own, documents until the tokens are reached. The
last one counts with the tokens that are left.

All of it is SQL functions. No step gathers a leaf: the order is a hash, tokens are summed by the hash's first
hex digits (``BUCKETS`` sums a leaf), and only the bucket in which a leaf's prefix ends is put in order. Documents
themselves are filtered by a table with one row per leaf and never shuffled.

Null text counts as empty and holds no tokens; documents without tokens are never taken. Nulls in the tree's
columns are a value of their own. Nodes without a weight get ``default_weight``; a weight of 0 or less takes
nothing. Rows that repeat a document count each. A budget above all capacity takes all; an empty table gives an
empty result. Columns of the input named like those of the result give way to them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import materialize

DIGITS = 3  #: hex digits of the order's hash that name a bucket: 4096 a leaf
LEAVES = 50_000  #: a leaf table with no more rows is broadcast

TREE = ("domain", "lang", "source")
SEED = 11


def n_tokens(text: Column) -> Column:
    """Words between spaces and line breaks."""
    return F.size(F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != "")).cast("long")


def order_key(seed: int, epoch: Column | int, doc_id: Column) -> Column:
    """The place of a document in an epoch's order: hex digits, smaller first; then doc_id."""
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def water_fill(nodes: DataFrame, parent: Sequence[str]) -> DataFrame:
    """``nodes`` (columns parent..., capacity, weight, budget of the parent) with ``given``: whole tokens, summing
    to at most the parent's budget."""
    by = Window.partitionBy(*parent)
    nodes = nodes.withColumn("ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")))
    ordered = by.orderBy(F.col("ratio").asc_nulls_first(), "node")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    cap_before = F.coalesce(F.sum(F.when(F.col("ratio").isNotNull(), F.col("capacity"))).over(before), F.lit(0)).cast("double")
    w_before = F.coalesce(F.sum(F.when(F.col("ratio").isNotNull(), F.col("weight"))).over(before), F.lit(0.0))
    w_all = F.sum(F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)).over(by)
    nodes = nodes.withColumn("level", F.when(F.col("ratio").isNotNull(), (F.col("budget") - cap_before) / F.greatest(w_all - w_before, F.lit(1e-300))))
    # the first node whose ratio is above the level that the rest would share sets the level for all after it
    level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "node", "level"))).over(by)["level"]
    given = F.when(F.col("ratio").isNull(), F.lit(0.0)).otherwise(F.least(F.col("capacity").cast("double"), F.coalesce(level * F.col("weight"), F.col("capacity").cast("double"))))
    return nodes.withColumn("given", F.floor(F.greatest(given, F.lit(0.0))).cast("long")).drop("ratio", "level")


def leaf_budgets(leaves: DataFrame, weights: DataFrame | None, budget: Column, tree: Sequence[str] = TREE, max_epochs: int = 1, default_weight: float = 1.0) -> DataFrame:
    """``leaves`` (tree columns, ``tokens``) with ``given``, the tokens that each leaf shall take.

    ``weights``: level int (1: the first column of the tree), path string (values so far joined by "/"), weight double.
    """
    paths = [F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in tree[: i + 1]]) for i in range(len(tree))]
    at = leaves.select(*tree, "tokens", *[p.alias(f"path{i + 1}") for i, p in enumerate(paths)], F.lit("").alias("path0"))
    capacity = F.col("tokens") * max_epochs
    level = at.groupBy("path0").agg(F.sum(capacity).alias("capacity"))
    level = level.select(F.col("path0").alias("parent"), F.least(F.floor(budget), F.col("capacity")).cast("long").alias("budget"))
    for i in range(1, len(tree) + 1):
        nodes = at.groupBy(F.col(f"path{i - 1}").alias("parent"), F.col(f"path{i}").alias("node")).agg(F.sum(capacity).alias("capacity"))
        if weights is None:
            nodes = nodes.withColumn("weight", F.lit(float(default_weight)))
        else:
            own = weights.where(F.col("level") == i).groupBy(F.col("path").alias("node")).agg(F.max("weight").cast("double").alias("weight"))
            nodes = nodes.join(own, "node", "left").withColumn("weight", F.coalesce("weight", F.lit(float(default_weight))))
        nodes = water_fill(nodes.join(level, "parent"), ["parent"])
        level = nodes.select(F.col("node").alias("parent"), F.col("given").alias("budget"))
    return at.join(level.withColumnRenamed("parent", f"path{len(tree)}").withColumnRenamed("budget", "given"), f"path{len(tree)}").select(*tree, "tokens", "given")


def mix(docs: DataFrame, weights: DataFrame | None = None, share: float = 0.5, tree: Sequence[str] = TREE, max_epochs: int = 1, seed: int = SEED, default_weight: float = 1.0) -> DataFrame:
    """The rows of ``docs`` that are taken, once for each epoch, with epoch, n_tokens and take_tokens.

    The budget is ``share`` of all tokens. take_tokens is less than n_tokens for a leaf's last document alone. Texts
    are split into tokens once, for a table of ids, leaves and numbers of tokens that the rest of the work reads; of
    texts that may be taken, the tokens are counted again at the end, as joining the numbers back would shuffle texts.
    """
    own = [c for c in docs.columns if c not in ("epoch", "take_tokens", "n_tokens")]
    row = F.struct(*[F.col(f"`{c}`") for c in own])
    leaf = [F.col(f"`{c}`").alias(f"_t{i}") for i, c in enumerate(tree)]
    by = [f"_t{i}" for i in range(len(tree))]
    # names of our own, so that no column of the input can clash
    counted = docs.select(*leaf, F.col("doc_id").alias("_id"), n_tokens(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_n"))
    tagged = materialize(counted, "mix-tokens").where("_n > 0")  # a filter below would count again
    leaves = materialize(tagged.groupBy(*by).agg(F.sum("_n").alias("tokens")), "mix-leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    given = leaf_budgets(leaves, weights, F.lit(share * total), by, max_epochs, default_weight)
    given = given.select(*by, (F.col("given") / F.col("tokens")).cast("long").alias("whole"), (F.col("given") % F.col("tokens") % F.greatest("tokens", F.lit(1))).alias("left"))
    given = _hint(materialize(given, "mix-given"))

    same = lambda a, b: _all([F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by])
    # the epoch in which a leaf's prefix ends has its own order; tokens by leaf and bucket of that order
    last = tagged.alias("d").join(given.alias("g"), same("d", "g")).where("g.left > 0").select("d.*", "g.whole", "g.left")
    last = last.withColumn("key", order_key(seed, F.col("whole"), F.col("_id"))).withColumn("bucket", F.substring("key", 1, DIGITS))
    sums = last.groupBy(*by, "bucket", "left").agg(F.sum("_n").alias("tokens"))
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    ends = sums.where("before < left and before + tokens >= left").select(*by, "bucket", "before", "left")
    ends = _hint(materialize(ends, "mix-ends"))
    # the documents of that one bucket, in order; equal keys (rows that repeat an id) are told apart by their place
    inner = last.drop("left").alias("d").join(ends.alias("e"), same("d", "e") & (F.col("d.bucket") == F.col("e.bucket"))).select("d.*", "e.before", "e.left")
    in_order = Window.partitionBy(*by).orderBy("key", "_id", "_n")
    inner = inner.groupBy(*by, "key", "_id", "_n", "before", "left").agg(F.count(F.lit(1)).alias("copies"))
    inner = inner.withColumn("start", F.col("before") + F.sum(F.col("_n") * F.col("copies")).over(in_order) - F.col("_n") * F.col("copies"))
    stop = inner.where("start < left").groupBy(*by).agg(F.max(F.struct("key", "_id", "_n", "start", "left", "copies")).alias("stop"))
    cut = given.alias("g").join(stop.alias("s"), same("g", "s"), "left").select("g.*", "s.stop")
    cut = _hint(materialize(cut, "mix-cut"))

    some = cut.where("whole > 0 or stop is not null")
    out = docs.select(*leaf, F.col("doc_id").alias("_id"), row.alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    out = out.alias("d").join(some.alias("c"), same("d", "c")).select("d._id", "d._row", "d._text", "c.whole", "c.stop")
    key = order_key(seed, F.col("whole"), F.col("_id"))
    # what lies past the prefix in order is out by its key alone
    out = out.withColumn("_key", key).where((F.col("whole") > 0) | (F.col("_key") <= F.col("stop.key"))).withColumn("_n", n_tokens(F.col("_text")))
    mine = F.struct(F.col("_key").alias("key"), F.col("_id"), F.col("_n"))
    end = F.struct(F.col("stop.key"), F.col("stop._id"), F.col("stop._n"))
    # rows equal in key, id and tokens are copies; those that the prefix does not reach whole share its rest evenly
    rest = F.floor((F.col("stop.left") - F.col("stop.start")) / F.col("stop.copies"))
    part = F.when(F.col("stop").isNull() | (mine > end), F.lit(0)).when(mine < end, F.col("_n")).otherwise(F.least(F.col("_n"), rest)).cast("long")
    out = out.withColumn("_part", part).withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("whole"))))
    out = out.withColumn("_take", F.when(F.col("_epoch") < F.col("whole"), F.col("_n")).otherwise(F.col("_part"))).where("_take > 0")
    return out.select(*[F.col("_row")[c].alias(c) for c in own], F.col("_n").alias("n_tokens"), F.col("_epoch").alias("epoch"), F.col("_take").alias("take_tokens"))


def _hint(table: DataFrame) -> DataFrame:
    """Broadcast a table of leaves if it is small; else Spark shuffles by leaf and splits large ones (AQE)."""
    return F.broadcast(table) if table.count() <= LEAVES else table


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


# -- the registered query's tree, weights and SQL ----------------------------------------------

#: fixed values of the query: which sources make up a domain (others are "books"), and the weights
DOMAINS = {"web": ("src0", "src1", "src2", "src3"), "forum": ("src4", "src5", "src6", "src7", "src8", "src9")}
WEIGHTS = {1: {"web": 4.0, "forum": 2.0, "books": 2.0}, 2: {"en": 4.0, "de": 2.0, "fr": 1.0, "es": 1.0}}
SHARE, EPOCHS = 0.5, 2


def with_domain(docs: DataFrame) -> DataFrame:
    domain = F.lit("books")
    for name, sources in DOMAINS.items():
        domain = F.when(F.col("source").isin(*sources), name).otherwise(domain)
    return docs.withColumn("domain", domain)


def query_weights(spark) -> DataFrame:
    rows = [(1, d, w) for d, w in WEIGHTS[1].items()] + [(2, f"{d}/{x}", w) for d in WEIGHTS[1] for x, w in WEIGHTS[2].items()]
    return spark.createDataFrame(rows, "level int, path string, weight double")


def oracle() -> str:
    """DuckDB SQL for mix() over the query's tree (ids that don't repeat)."""
    domain = "CASE " + " ".join("WHEN source IN (" + ", ".join(f"'{x}'" for x in v) + f") THEN '{k}'" for k, v in DOMAINS.items()) + " ELSE 'books' END"
    case = lambda col, m: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.items()) + " ELSE 1.0 END"

    def fill(name: str, parent: str, node: str, source: str) -> str:
        by = f"PARTITION BY {parent}" if parent else ""
        return f"""
        {name}_a AS (SELECT *, capacity / weight AS ratio FROM ({source})),
        {name}_b AS (SELECT *, (budget - coalesce(sum(capacity) OVER ({by} ORDER BY ratio, {node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER ({by}) - coalesce(sum(weight) OVER ({by} ORDER BY ratio, {node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM {name}_a),
        {name}_c AS (SELECT *, min(CASE WHEN ratio > level THEN ROW(ratio, {node}, level) END) OVER ({by}) AS first FROM {name}_b),
        {name} AS (SELECT *, floor(greatest(least(capacity::DOUBLE, coalesce(first[3] * weight, capacity::DOUBLE)), 0.0))::BIGINT AS given FROM {name}_c),"""

    return f"""
        WITH d AS (
            SELECT doc_id, lang, source, {domain} AS domain, len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w: w <> '')) AS n_tokens FROM documents
        ),
        leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM d WHERE n_tokens > 0 GROUP BY ALL),
        total AS (SELECT least(floor({SHARE} * sum(tokens)), {EPOCHS} * sum(tokens))::BIGINT AS budget FROM leaves),
        {fill("domains", "", "domain", f"SELECT domain, sum(tokens) * {EPOCHS} AS capacity, ({case('domain', WEIGHTS[1])})::DOUBLE AS weight, any_value(budget) AS budget FROM leaves, total GROUP BY domain")}
        {fill("langs", "domain", "lang", f"SELECT l.domain, l.lang, sum(l.tokens) * {EPOCHS} AS capacity, ({case('l.lang', WEIGHTS[2])})::DOUBLE AS weight, any_value(u.given) AS budget FROM leaves l JOIN domains u USING (domain) GROUP BY l.domain, l.lang")}
        {fill("sources", "domain, lang", "source", f"SELECT l.domain, l.lang, l.source, l.tokens, l.tokens * {EPOCHS} AS capacity, 1.0::DOUBLE AS weight, u.given AS budget FROM leaves l JOIN langs u USING (domain, lang)")}
        cut AS (SELECT domain, lang, source, given // tokens AS whole, given % tokens AS rest FROM sources),
        rows AS (SELECT d.*, whole, rest, unnest(range(0, whole + 1)) AS epoch FROM d JOIN cut USING (domain, lang, source) WHERE n_tokens > 0),
        placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('{SEED}:' || epoch || ':' || doc_id), doc_id) - n_tokens AS start FROM rows)
        SELECT doc_id, domain, lang, source, epoch::BIGINT AS epoch, n_tokens::BIGINT AS n_tokens,
            (CASE WHEN epoch < whole THEN n_tokens ELSE least(n_tokens, rest - start) END)::BIGINT AS take_tokens
        FROM placed WHERE epoch < whole OR start < rest
    """
