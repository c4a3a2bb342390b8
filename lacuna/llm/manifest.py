"""A Merkle manifest of a dataset: leaf coordinates by rank in bitmaps of ids, levels reduced in keyed slot arrays.

Each row is a leaf; leaves of one source ascend by doc_id, and every three consecutive nodes become their hash until one,
the subroot, remains. Subroots in the order of sources (null first, by bytes) likewise give the root.

No leaf is sorted for its place. Per source, doc_ids set bits: 64 to a word, 64 words to a container, and a container
keeps only words that have bits, each with the number of rows before it. Partial words are merged with OR as the
aggregation meets them. Containers get the rows before them from directories over the digits of their number, so no
prefix sum runs over more than 65,536 of them (1,048,576 at the top). A leaf's rank is then the container's start, the
word's, and a popcount of the bits below its own.

``FAN**DEPTH`` = 3**8 consecutive nodes make a block, an array of slots keyed by rank, which one call reduces by eight levels;
blocks of blocks follow until every source has one node: two passes up to 43 million rows of one source. On the way back,
each block gets its path to the root, and each leaf's siblings are those of its block followed by that path.

Rows with a null id come first in their source. Rows of one source that repeat an id (nulls too) are ordered by their
leaf's hash; equal leaves are interchangeable, and each has its own place and proof. Such rows are counted and numbered by
(id, leading hash digits), so that a third of all rows under one id meet in no task. Null and empty texts are different
leaves. A text of any length is hashed by Spark where it is read and moves no further. An empty table gives no rows.
Columns of the input beside doc_id, source, lang, n_chars and text don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lacuna.llm.common import materialize

FAN = 3
DEPTH = 8  #: levels that a block is reduced by
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
GROUP = ["known", "src"]
NODES = "known boolean, src string, slot long, node string, total long"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row: dict[str, Column]) -> Column:
    """H of the fields, each "-" if null, else its UTF-8 byte count, ":" and value."""
    part = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
    return F.sha2(F.concat(*[part(row[f]) for f in FIELDS]), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """known, src (null sources are unknown), doc_id, node and changed: the leaf as it is and with the tampered text.

    ``tampered``: the text that a check finds; by default the text itself.
    """
    row = {f: F.col(f"`{f}`") for f in FIELDS}
    changed = leaf(row | {"text": tampered}) if tampered is not None else leaf(row)
    return docs.select(row["source"].isNotNull().alias("known"), F.coalesce(row["source"].cast("string"), F.lit("")).alias("src"), row["doc_id"].cast("long").alias("doc_id"), leaf(row).alias("node"), changed.alias("changed"))


# -- ranks ------------------------------------------------------------------------------------

def coordinates() -> tuple[Column, Column, Column]:
    """A doc_id's container, word in it and bit; null ids come before all others."""
    high = F.coalesce(F.expr("shiftright(doc_id, 12)"), F.lit(-(1 << 52)))
    spot = F.coalesce(F.expr("shiftright(doc_id & 4095, 6)"), F.lit(0)).cast("int")
    return high, spot, F.coalesce(F.expr("doc_id & 63"), F.lit(0)).cast("int")


def bitmaps(ids: DataFrame) -> DataFrame:
    """known, src, high, spots, bits, before, rows: containers of 4,096 ids with their words, and of each word the rows before it."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    high, spot, bit = coordinates()
    spots = ids.select(*GROUP, high.alias("high"), spot.alias("spot"), bit.alias("bit")).groupBy(*GROUP, "high", "spot").agg(F.bit_or(one).alias("bits"), F.count(F.lit(1)).alias("n"))
    packed = spots.groupBy(*GROUP, "high").agg(F.array_sort(F.collect_list(F.struct("spot", "bits", "n"))).alias("w"), F.sum("n").alias("rows"))
    before = F.transform("w", lambda x, i: F.aggregate(F.slice("w", 1, i), F.lit(0).cast("long"), lambda a, y: a + y["n"]))
    return packed.select(*GROUP, "high", F.col("w.spot").alias("spots"), F.col("w.bits").alias("bits"), F.col("w.n").alias("counts"), before.alias("before"), "rows")


def directory(containers: DataFrame) -> DataFrame:
    """``containers`` with start, the rows of the source before each, and total, those of the source.

    Sums run over one digit of the container's number at a time.
    """
    digits = {"d0": "shiftright(high, 32)", "d1": "shiftright(high, 16) & 65535", "d2": "high & 65535"}
    out = containers.withColumns({k: F.expr(v) for k, v in digits.items()})
    upto = lambda by, at: F.coalesce(F.sum("rows").over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = out.groupBy(*GROUP, "d0").agg(F.sum("rows").alias("rows")).withColumn("s0", upto(GROUP, "d0")).withColumn("total", F.sum("rows").over(Window.partitionBy(*GROUP)))
    middle = out.groupBy(*GROUP, "d0", "d1").agg(F.sum("rows").alias("rows")).withColumn("s1", upto([*GROUP, "d0"], "d1"))
    starts = middle.drop("rows").join(top.drop("rows"), [*GROUP, "d0"])
    out = out.withColumn("s2", upto([*GROUP, "d0", "d1"], "d2")).join(starts, [*GROUP, "d0", "d1"])
    return out.withColumn("start", F.col("s0") + F.col("s1") + F.col("s2")).drop("d0", "d1", "d2", "s0", "s1", "s2")


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (known, src, doc_id, node, changed) with slot, the place in the source from 0, and total, the source's rows."""
    containers = materialize(directory(bitmaps(rows)), "merkle-bitmaps")
    high, spot, bit = coordinates()
    at = rows.withColumn("high", high).join(containers, [*GROUP, "high"])
    i = F.array_position("spots", spot).cast("int") - 1
    word = F.get("bits", i)
    below = F.bit_count(word.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit))))
    at = at.select(*rows.columns, "total", (F.col("start") + F.get("before", i)).alias("_at"), below.alias("_below"), (F.get("counts", i) > F.bit_count(word)).alias("_again"))
    columns = [*rows.columns, "total", "slot"]
    plain = at.where("not _again").withColumn("slot", F.col("_at") + F.col("_below")).select(*columns)
    crowded = containers.where(F.exists(F.arrays_zip("bits", "counts"), lambda x: x["counts"] > F.bit_count(x["bits"])))
    if not crowded.limit(1).count():
        return plain
    return plain.unionByName(_repeats(at.where("_again")).select(*columns))


def _repeats(rows: DataFrame, digits: int = 4) -> DataFrame:
    """The slots of rows in words with a repeated id: by id, then hash. Equal rows are one row with a count until the end."""
    word = [*GROUP, "_at"]
    each = materialize(rows.groupBy(*word, "total", "doc_id", "node", "changed").agg(F.count(F.lit(1)).alias("copies")).withColumn("_head", F.substring("node", 1, digits)), "merkle-repeats")
    before = lambda by, order: F.coalesce(F.sum("copies").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.col("doc_id").asc_nulls_first()
    heads = each.groupBy(*word, "doc_id", "_head").agg(F.sum("copies").alias("copies")).withColumn("_start", before(word, [first, "_head"])).drop("copies")
    names = [*word, "_head", "doc_id"]
    heads = heads.select(*[F.col(c).alias(f"_h{i}") for i, c in enumerate(names)], "_start")
    out = each.join(heads, [F.col(c).eqNullSafe(F.col(f"_h{i}")) for i, c in enumerate(names)]).select(*each.columns, "_start")
    out = out.withColumn("slot", F.col("_at") + F.col("_start") + before([*word, "doc_id", "_head"], ["node", "changed"]))
    # many copies of one row are dealt out before they become rows
    parts = out.withColumn("_part", F.explode(F.expr("sequence(0L, (copies - 1) div 4096)"))).repartition(*GROUP, "slot", "_part")
    return parts.withColumn("slot", F.explode(F.expr("sequence(slot + _part * 4096, slot + least(copies, (_part + 1) * 4096) - 1)")))


# -- levels -----------------------------------------------------------------------------------


def levels(nodes: list[str], total: int, depth: int) -> list[list[str]]:
    """The nodes of a block and of the levels above, while the source has more than one node and the block levels left."""
    out = [nodes]
    while total > 1 and len(out) <= depth:
        nodes = out[-1]
        out.append([digest("".join(nodes[i : i + FAN])) for i in range(0, len(nodes), FAN)])
        total = -(-total // FAN)
    return out


def siblings(found: list[list[str]], i: int) -> list[tuple[str, str]]:
    """Of the block's i-th node, level by level, the nodes of its run left and right of its way up."""
    out = []
    for level in found[:-1]:
        run = i - i % FAN
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + FAN])))
        i //= FAN
    return out


def path_text(path: list[tuple[str, str]]) -> str:
    return "/".join(f"{left}:{right}" for left, right in path)


def path_of(text: str) -> list[tuple[str, str]]:
    return [tuple(x.split(":")) for x in text.split("/")] if text else []


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest(left + node + right)
    return node


def _by_block(rows: DataFrame, of_block: Callable[[list[dict]], list[dict]], schema: str, depth: int) -> DataFrame:
    """``of_block`` of the rows of every block, in the order of slots; a block's rows are all that a call holds."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    width = FAN**depth

    def batch(out: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: [r[n] for r in out] for n in arrow.names}, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, key, out = [], None, []
        for b in batches:
            for row in b.to_pylist():
                own = row["known"], row["src"], row["block"]
                if own != key and block:
                    out += of_block(block)
                    block = []
                    if len(out) >= 4096:
                        yield batch(out)
                        out = []
                key = own
                block.append(row)
        if block:
            out += of_block(block)
        if out:
            yield batch(out)

    by = [*GROUP, "block"]
    return rows.withColumn("block", F.expr(f"slot div {width}")).repartition(*by).sortWithinPartitions(*by, "first", "slot").mapInArrow(run, schema)


def _up(depth: int) -> Callable[[list[dict]], list[dict]]:
    def of_block(block: list[dict]) -> list[dict]:
        head = block[0]
        found = levels([r["node"] for r in block], head["total"], depth)
        return [{"known": head["known"], "src": head["src"], "slot": head["block"], "node": found[-1][0], "total": -(-head["total"] // FAN**depth)}]

    return of_block


def _down(depth: int) -> Callable[[list[dict]], list[dict]]:
    def of_block(block: list[dict]) -> list[dict]:
        """``block``: the block's own path, then its nodes. Their paths."""
        above, nodes = block[0], block[1:]
        found = levels([r["node"] for r in nodes], nodes[0]["total"], depth)
        rest = [above["path"]] if above["path"] else []
        return [{"known": r["known"], "src": r["src"], "slot": r["slot"], "path": "/".join(filter(None, [path_text(siblings(found, i)), *rest])), "subroot": above["subroot"]} for i, r in enumerate(nodes)]

    return of_block


def _prove(depth: int) -> Callable[[list[dict]], list[dict]]:
    def of_block(block: list[dict]) -> list[dict]:
        above, nodes = block[0], block[1:]
        found = levels([r["node"] for r in nodes], nodes[0]["total"], depth)
        rest = path_of(above["path"])
        out = []
        for i, r in enumerate(nodes):
            path = siblings(found, i) + rest
            out.append({"doc_id": r["doc_id"], "leaf": r["node"], "subroot": above["subroot"], "proof_sha256": digest("".join(a + b for a, b in path)), "folded_root": fold(r["changed"], path)})
        return out

    return of_block


def passes(total: int, depth: int = DEPTH) -> int:
    """Blocks of blocks until one node is left of ``total``; a block is made of a lone node too."""
    n, width = 1, FAN**depth
    while total > width:
        total = -(-total // width)
        n += 1
    return n


def climb(nodes: DataFrame, most: int, depth: int) -> list[DataFrame]:
    """``nodes`` and the blocks above, written tables; the last has one node for each source. ``most``: rows of the largest."""
    out = [nodes]
    for _ in range(passes(most, depth)):
        out.append(materialize(_by_block(out[-1].select(*GROUP, "slot", "node", "total").withColumn("first", F.lit(0)), _up(depth), NODES, depth), "merkle-level"))
    return out


def _with_paths(nodes: DataFrame, paths: DataFrame, depth: int) -> DataFrame:
    """The nodes, and before those of each block its path: paths' slots are the nodes' blocks."""
    own = nodes.withColumns({"first": F.lit(1), "path": F.lit(None).cast("string"), "subroot": F.lit(None).cast("string")})
    head = paths.select(*GROUP, (F.col("slot") * FAN**depth).alias("slot"), F.lit(0).alias("first"), "path", "subroot")
    return own.unionByName(head, allowMissingColumns=True)


def descend(tables: list[DataFrame], paths: DataFrame, depth: int) -> DataFrame:
    """The paths of the nodes of the first table from those of the last."""
    for nodes in reversed(tables[:-1]):
        paths = materialize(_by_block(_with_paths(nodes, paths, depth), _down(depth), "known boolean, src string, slot long, path string, subroot string", depth), "merkle-paths")
    return paths


def _numbered(sources: DataFrame) -> DataFrame:
    """``sources`` (known, src, node) with number: their place in order. Sorted by ranges, whose sizes are summed."""
    spread = materialize(sources.repartitionByRange("known", "src").withColumn("_range", F.spark_partition_id()), "merkle-sources")
    spread = spread.withColumn("_in", F.row_number().over(Window.partitionBy("_range").orderBy("known", "src")) - 1)
    sizes = spread.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    starts = sizes.withColumn("_start", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return spread.join(F.broadcast(starts), "_range").withColumn("number", F.col("_start") + F.col("_in")).drop("_range", "_start", "_in")


def manifest(docs: DataFrame, tampered: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: a row for each row of ``docs``.

    ``tampered``: the text that the check finds in place of the original one (a column over ``docs``).
    """
    rows = materialize(leaves(docs, tampered), "merkle-leaves")
    nodes = materialize(ranked(rows), "merkle-ranked")
    most = nodes.agg(F.max("total")).first()[0] or 0
    tables = climb(nodes, most, depth)
    numbered = materialize(_numbered(tables[-1].select(*GROUP, "node")), "merkle-subroots")
    n = numbered.count()
    top = climb(numbered.select(F.lit(True).alias("known"), F.lit("").alias("src"), F.col("number").alias("slot"), "node", F.lit(n).cast("long").alias("total")), n, depth)
    root = F.lit((top[-1].first() or {"node": None})["node"]).cast("string")
    start = top[-1].select(*GROUP, "slot", F.lit("").alias("path"), F.lit("").alias("subroot"))
    paths = descend(top, start, depth).select(F.col("slot").alias("number"), "path").join(numbered, "number")
    paths = descend(tables[1:], paths.select(*GROUP, F.lit(0).cast("long").alias("slot"), "path", F.col("node").alias("subroot")), depth)
    # ids as text: Python would take a column with nulls for floats
    last = nodes.select(*GROUP, "slot", "node", "total", "changed", F.col("doc_id").cast("string").alias("doc_id"))
    out = _by_block(_with_paths(last, paths, depth), _prove(depth), "doc_id string, leaf string, subroot string, proof_sha256 string, folded_root string", depth)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def without_breaks(doc_id: Column, text: Column) -> Column:
    """The registered query's tampering: text loses its line breaks where 2 divides the CRC-32 of the decimal id."""
    return F.when(F.crc32(doc_id.cast("string")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def oracle() -> str:
    """DuckDB SQL for manifest() with without_breaks (ids that don't repeat within a source)."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    h = lambda text: f"sha256({part('doc_id')} || {part('source')} || {part('lang')} || {part('n_chars')} || {text})"
    bit = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: {bit}), 4294967295)"

    def tree(name: str, start: str) -> str:
        """Levels of runs of three by group, and per first node its siblings level by level and its way up."""
        return f"""
        {name} AS (
            SELECT g, slot, node, 0 AS lvl, count(*) OVER (PARTITION BY g) AS n FROM ({start})
            UNION ALL
            SELECT g, slot // 3, sha256(string_agg(node, '' ORDER BY slot)), any_value(lvl) + 1, any_value((n + 2) // 3) FROM {name} WHERE n > 1 GROUP BY g, slot // 3
        ),
        {name}_sib AS (
            SELECT a.g, a.lvl, a.slot, coalesce(string_agg(b.node, '' ORDER BY b.slot) FILTER (b.slot < a.slot), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.slot) FILTER (b.slot > a.slot), '') AS r
            FROM {name} a JOIN {name} b ON a.g = b.g AND a.lvl = b.lvl AND a.slot // 3 = b.slot // 3 WHERE a.n > 1 GROUP BY a.g, a.lvl, a.slot
        ),"""

    return f"""
        WITH RECURSIVE
        d AS (
            SELECT doc_id, source AS src, coalesce('1' || source, '0') AS g, {h(part('text'))} AS leaf,
                CASE WHEN {crc} % 2 = 0 THEN {h(part("replace(text, chr(10), '')"))} ELSE {h(part('text'))} END AS changed,
                row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS slot
            FROM documents
        ),
        {tree("t", "SELECT g, slot, leaf AS node FROM d")}
        subs AS (SELECT g, node, row_number() OVER (ORDER BY g) - 1 AS number FROM t WHERE n = 1),
        {tree("u", "SELECT '' AS g, number AS slot, node FROM subs")}
        steps AS (
            SELECT d.g, d.slot AS own, s.lvl, s.l, s.r FROM d JOIN t_sib s ON s.g = d.g AND s.slot = d.slot // (3 ** s.lvl)::BIGINT
            UNION ALL
            SELECT d.g, d.slot, 1000 + s.lvl, s.l, s.r FROM d JOIN subs ON subs.g = d.g JOIN u_sib s ON s.slot = subs.number // (3 ** s.lvl)::BIGINT
        ),
        ways AS (SELECT g, own, list(struct_pack(l := l, r := r) ORDER BY lvl) AS way, string_agg(l || r, '' ORDER BY lvl) AS sib FROM steps GROUP BY g, own),
        folds AS (
            SELECT d.g, d.slot, d.changed AS node, 0 AS i, coalesce(way, []) AS way FROM d LEFT JOIN ways ON ways.g = d.g AND ways.own = d.slot
            UNION ALL
            SELECT g, slot, sha256(way[i + 1].l || node || way[i + 1].r), i + 1, way FROM folds WHERE i < len(way)
        ),
        top AS (SELECT node AS root FROM u WHERE n = 1)
        SELECT doc_id, leaf, subs.node AS subroot, root, sha256(coalesce(sib, '')) AS proof_sha256, folds.node AS folded_root, folds.node = root AS verified
        FROM d JOIN subs ON subs.g = d.g JOIN top ON true LEFT JOIN ways ON ways.g = d.g AND ways.own = d.slot
        JOIN folds ON folds.g = d.g AND folds.slot = d.slot AND folds.i = len(folds.way)
    """
