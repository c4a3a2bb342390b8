"""Self-join of documents on the Jaccard similarity of their n-gram sets, by prefix trees.

A document's set holds the hashes of its word n-grams, sorted in one global order: n-grams that a sample shows to
be common come last. Two sets whose similarity reaches the threshold share an element among their first ones, and
several among a few more. Sets that share too few with all others are out; the rest meet in *bundles*, one for each
shared element among the first. Inside a bundle the sets are the paths
of a trie (with unary runs as one node); a query walks down, counts overlap once for all sets that share a path,
and leaves a subtree when the elements that remain cannot reach the threshold for any size in it, or when all of
it is already in the query's component. Components are what is wanted, so no pairs are listed.

To keep sets from travelling to each of their bundles, bundles go in rounds, and between rounds linked sets get one
label: first every set in one bundle only; then one set for each label of a bundle; last, exactly, all members of the
bundles that still hold two labels, bundles with the same members once. In the last two rounds only sizes and parity
sketches travel first: two sets differ in at least as many elements as their sketches do in bits, so what cannot
reach the threshold is out for certain. The sets of two labels that are left form a bundle of their own, which a trie
joins; each of them goes there once, so what travels does not grow with the product of two families' sizes. A bundle
of more than ``part`` sets (or very many elements) is cut into parts; the first round joins inside parts, the others
every two parts, so that no task holds a whole bundle and no link between sets is lost.

Equal sets are one set from the start. Documents without words have an empty set and no link. Null text counts as
empty; null ids take no part in links (component_id null). Rows that repeat an id count as documents of their
own. An empty table gives an empty result. Other columns are ignored. N-grams are told apart by 42 hash bits, within
a pair of sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import int_column, materialize, mix64, pieces, release, text_or_empty

N = 3  #: words in an n-gram
THRESHOLD = 90  #: hundredths of Jaccard similarity that link
SAMPLE = 4000  #: documents whose n-grams show which are common
COMMON = 100_000  #: n-grams that are known as common, at most
PART = 2000  #: sets of a bundle that are joined together
PART_ELEMENTS = 2_000_000  #: and their elements
HEADS = 32  #: shared elements of a set that travel with it, to tell where two sets meet first

HASH_BITS, CLASS_BITS = 42, 6
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_B = 0x9E3779B97F4A7C15
_INV = pow(_B, -1, 1 << 64)
EXTRA = 15  #: hundredths of a set that its prefix is longer than one common element needs, for a count of common ones
_SETS = "doc_id long, set_id long, n_shingles long, short int, prefix array<long>"


class _Powers:
    """Powers of the hash base and of its inverse; up to KEPT of each are remembered, longer runs are made anew."""

    KEPT = 1 << 16
    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = cls.up, cls.down
        while len(up) < n:
            k = len(up)
            with np.errstate(over="ignore"):
                up = np.concatenate([up, up * np.uint64(pow(_B, k, 1 << 64))])
                down = np.concatenate([down, down * np.uint64(pow(_INV, k, 1 << 64))])
        if len(up) <= cls.KEPT:
            cls.up, cls.down = up, down
        return up[:n], down[:n]


def shingles(text: str, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams (of the whole sequence, if it has fewer words)."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(LOWER), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    edge = np.diff(np.concatenate([[True], _IS_SPACE[raw], [True]]).astype(np.int8))
    starts, ends = np.nonzero(edge < 0)[0], np.nonzero(edge > 0)[0]
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _Powers.get(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1])])
        word = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        k = min(n, len(word))
        grams = np.full(len(word) - k + 1, k, np.uint64)
        for i in range(k):
            grams = mix64(grams * np.uint64(_B) + word[i : len(word) - k + 1 + i])
    return np.unique(grams)


def pack48(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _sample(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches):
            made = [shingles(t, n) for t in pdf["text"]]
            yield pd.DataFrame({"gram": np.concatenate(made).view(np.int64) if made else np.empty(0, np.int64)})

    return run


def ordered_set(grams: np.ndarray, known: np.ndarray, klass: np.ndarray) -> np.ndarray:
    """The set in the global order: common n-grams last, by class, and by hash in a class."""
    order = grams >> np.uint64(64 - HASH_BITS)
    if len(known) and len(grams):
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        order |= np.where(known[at] == grams, klass[at], np.uint64(0)) << np.uint64(HASH_BITS)
    return np.sort(order)


def set_id(grams: np.ndarray) -> int | None:
    return int.from_bytes(blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True) if len(grams) else None


def _sets(common, n: int, threshold: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches):
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                s = shingles(text, n)
                size = len(s)
                first = size - (threshold * size + 99) // 100 + 1 if size else 0
                more = EXTRA * size // 100
                out.append((None if pd.isna(doc_id) else int(doc_id), set_id(s), size, first, ordered_set(s, *common.value)[: first + more].astype(np.int64)))
            ids, sids, sizes, firsts, prefixes = zip(*out) if out else ([],) * 5
            yield pd.DataFrame({"doc_id": int_column(ids), "set_id": int_column(sids), "n_shingles": sizes, "short": firsts, "prefix": prefixes})

    return run


def parity(elements: np.ndarray) -> bytes:
    """A bit for each of about as many cells as there are elements: whether an odd number of them falls there.

    The cells in which two sets differ are no more than the elements in which they do.
    """
    width = min(max(64, 1 << (len(elements) - 1).bit_length()), 1 << 16)
    return np.packbits(np.bincount((mix64(elements) % np.uint64(width)).astype(np.int64), minlength=width) & 1, bitorder="little").tobytes()


def _elements(common, n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches):
            out = []
            for sid, text in zip(pdf["set_id"], pdf["text"]):
                s = shingles(text, n)
                if set_id(s) == sid:  # another row may repeat the id
                    s = ordered_set(s, *common.value)
                    out.append((sid, pack48(s), len(s), parity(s)))
            yield pd.DataFrame(out, columns=["set_id", "elements", "size", "parity"])

    return run


class _Node:
    __slots__ = ("start", "end", "owner", "children", "low", "high", "label", "mixed")

    def __init__(self, start, end, owner):
        self.start, self.end, self.owner = start, end, owner
        self.children, self.label, self.mixed = [], -1, False


def build_trie(sets: list[np.ndarray]) -> tuple[_Node, list[list[_Node]]]:
    """The root, and each set's nodes from the root down. ``sets`` are distinct and in lexicographic order."""
    root = _Node(0, 0, 0)
    paths: list[list[_Node]] = []
    stack = [root]
    for i, s in enumerate(sets):
        common = 0
        if i:
            prev = sets[i - 1]
            m = min(len(prev), len(s))
            differ = np.nonzero(prev[:m] != s[:m])[0]
            common = int(differ[0]) if len(differ) else m
        while stack[-1].start >= common and len(stack) > 1:
            stack.pop()
        top = stack[-1]
        if top.end > common:  # the run is split where the new set leaves it
            lower = _Node(common, top.end, top.owner)
            lower.children, top.children, top.end = top.children, [lower], common
            lower.low, lower.high = top.low, top.high
            for p in paths[top.owner :]:
                at = p.index(top)
                p.insert(at + 1, lower)
        leaf = _Node(common, len(s), i)
        leaf.low = leaf.high = len(s)
        top.children.append(leaf)
        stack.append(leaf)
        for node in stack[:-1]:
            node.low = min(getattr(node, "low", len(s)), len(s))
            node.high = max(getattr(node, "high", len(s)), len(s))
        paths.append(stack.copy())
    return root, paths


def trie_join(sets: list[np.ndarray], labels: list[int], threshold: int = THRESHOLD) -> list[int]:
    """A component number for each set: sets with one label, and sets linked inside the bundle, share it."""
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    ordered = [sets[i] for i in order]
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(i: int, j: int) -> None:
        i, j = find(i), find(j)
        if i != j:
            parent[max(i, j)] = min(i, j)

    seen: dict[int, int] = {}
    for k, i in enumerate(order):
        union(k, seen.setdefault(labels[i], k))
    root, paths = build_trie(ordered)
    for k, q in enumerate(ordered):
        size = len(q)
        stack = [(root, 0, 0)]  # node, overlap above it, elements of the query up to there
        while stack:
            node, overlap, used = stack.pop()
            if node.label < 0:
                continue  # nothing inserted below yet
            if not node.mixed and find(node.label) == find(k):
                continue
            d = node.start
            rest = size - used
            best = min(max(d + rest, node.low), node.high)
            if (100 + threshold) * (overlap + min(best - d, rest)) < threshold * (size + best):
                continue
            if node.end > d:
                run = ordered[node.owner][d : node.end]
                at = np.searchsorted(q[used:], run)
                hit = at < rest
                overlap += int((q[used:][at[hit]] == run[hit]).sum())
                used += int(at[-1]) + (int(at[-1]) < rest and q[used + int(at[-1])] == run[-1])
            if not node.children:
                other = len(ordered[node.owner])
                if (100 + threshold) * overlap >= threshold * (size + other):
                    union(k, node.owner)
                continue
            if node.end == len(ordered[node.owner]) and node.owner < k and (100 + threshold) * overlap >= threshold * (size + node.end):
                union(k, node.owner)  # a set that is the beginning of others ends here
            for child in node.children:
                stack.append((child, overlap, used))
        mine = find(k)
        for node in paths[k]:
            if node.label < 0:
                node.label = k
            elif node.mixed or find(node.label) != mine:
                # mixed until what has been inserted below agrees again
                own = [c for c in node.children if c.label >= 0]
                node.mixed = True
                if own and not any(c.mixed for c in own):
                    node.mixed = len({find(c.label) for c in own} | {mine}) > 1
                node.label = k
    out = [0] * len(sets)
    for k, i in enumerate(order):
        out[i] = find(k)
    return out


def _bundles(threshold: int):
    """Joins each run of rows with one key; partitions come sorted by it."""

    def solve(rows: list[tuple]) -> list[tuple]:
        rows = list({r[0]: r for r in rows}.values())
        if len({r[1] for r in rows}) < 2:
            return []
        sets = [unpack48(r[2]) for r in rows]
        labels: dict[int, int] = {}
        own = [labels.setdefault(r[1], len(labels)) for r in rows]
        least: dict[int, int] = {}
        comps = trie_join(sets, own, threshold)
        for r, c in zip(rows, comps):
            least[c] = min(least.get(c, r[1]), r[1])
        return [(a, b) for a, b in {(r[1], least[c]) for r, c in zip(rows, comps)} if a != b]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows = None, []
        for pdf in batches:
            out = []
            for token, i, j, sid, label, elements in zip(pdf["token"], pdf["i"], pdf["j"], pdf["set_id"], pdf["label"], pdf["elements"]):
                if (token, i, j) != key:
                    out += solve(rows) if len(rows) > 1 else []
                    key, rows = (token, i, j), []
                rows.append((sid, label, elements))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])
        if len(rows) > 1 and (out := solve(rows)):
            yield pd.DataFrame(out, columns=["a", "b"])
        key, rows = None, []
        release()

    return run


def _place(members: DataFrame, every_two_parts: bool, part: int) -> DataFrame:
    """``members`` (token, set_id, label, size and what else travels) with the parts i <= j of their bundle that are joined."""
    n = F.greatest(F.count(F.lit(1)) / part, F.sum("size") / PART_ELEMENTS)
    sizes = members.groupBy("token").agg(F.ceil(n).cast("int").alias("parts"))
    placed = members.join(sizes, "token").withColumn("p", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int"))
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)) if every_two_parts else F.col("p"))
    return placed.withColumn("i", F.least("p", "o")).withColumn("j", F.greatest("p", "o")).drop("p", "o", "parts")


def _dealt(placed: DataFrame) -> DataFrame:
    return placed.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "set_id")


def join_bundles(members: DataFrame, sets: DataFrame, threshold: int, part: int, every_two_parts: bool = False) -> DataFrame:
    """Edges (a, b) between labels of sets that are linked inside a part, or two parts, of a bundle.

    ``members``: token, set_id, label, size; ``sets``: set_id, elements.
    """
    full = _dealt(_place(members, every_two_parts, part).join(sets.select("set_id", "elements"), "set_id"))
    return full.select("token", "i", "j", "set_id", "label", "elements").mapInPandas(_bundles(threshold), "a long, b long")


def _candidates(threshold: int):
    """Sets of a bundle that sizes and parities allow to be linked to a set of another label: a row for each set and pair of labels.

    Two sets that have met in an earlier bundle, as the first of their shared elements (``heads``) show, are left out.
    """

    def solve(token: int, rows: list[tuple]) -> set[tuple]:
        rows = sorted({r[0]: r for r in rows}.values(), key=lambda r: (r[2], r[0]))
        if len({r[1] for r in rows}) < 2:
            return set()
        label = np.array([r[1] for r in rows])
        size = np.array([r[2] for r in rows], np.int64)
        bits = [np.frombuffer(r[3], "<u8") for r in rows]
        before = [frozenset(h for h in r[4] if h < token) for r in rows]
        out = set()
        for words in {len(b) for b in bits}:
            # like sizes have the same width or twice it; a wider one folds onto the narrower
            at = np.array([i for i, b in enumerate(bits) if len(b) in (words, 2 * words)])
            flat = np.stack([bits[i] if len(bits[i]) == words else bits[i][:words] ^ bits[i][words:] for i in at])
            own = np.array([len(bits[i]) == words for i in at])
            n, lab = size[at], label[at]
            ends = np.searchsorted(n, n * 100 // threshold, side="right")
            for k in np.nonzero(own)[0]:
                span = slice(k + 1, ends[k])
                if span.start >= span.stop:
                    continue
                both = n[span] + n[k]
                allowed = both - 2 * ((threshold * both + 99 + threshold) // (100 + threshold))
                near = (np.bitwise_count(flat[span] ^ flat[k]).sum(1) <= allowed) & (lab[span] != lab[k])
                x, seen = rows[at[k]], before[at[k]]
                for j in np.nonzero(near)[0] + k + 1:
                    if not seen.isdisjoint(before[at[j]]):
                        continue
                    y = rows[at[j]]
                    pair = (x[1], y[1]) if x[1] < y[1] else (y[1], x[1])
                    out.add((*pair, x[0], x[1], x[2]))
                    out.add((*pair, y[0], y[1], y[2]))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["x_label", "y_label", "set_id", "label", "size"]
        key, rows, out = None, [], set()
        for pdf in batches:
            for token, i, j, sid, label, size, bits, heads in zip(pdf["token"], pdf["i"], pdf["j"], pdf["set_id"], pdf["label"], pdf["size"], pdf["parity"], pdf["heads"]):
                if (token, i, j) != key:
                    out |= solve(key[0], rows) if len(rows) > 1 else set()
                    key, rows = (token, i, j), []
                rows.append((sid, label, size, bits, heads))
            if len(out) > 100_000:
                yield pd.DataFrame(list(out), columns=columns)
                out = set()
        if len(rows) > 1:
            out |= solve(key[0], rows)
        if out:
            yield pd.DataFrame(list(out), columns=columns)
        key, rows, out = None, [], set()
        release()

    return run


def candidate_bundles(members: DataFrame, sets: DataFrame, threshold: int, part: int) -> DataFrame:
    """A bundle for each two labels that meet in one of ``members``' bundles, with their sets that may be linked.

    A set travels once for each two labels, however many sets of the other label it is near to and bundles it shares with them.
    """
    full = _dealt(_place(members.join(sets.select("set_id", "size", "parity", "heads"), "set_id"), True, part))
    rows = full.select("token", "i", "j", "set_id", "label", "size", "parity", "heads").mapInPandas(_candidates(threshold), "x_label long, y_label long, set_id long, label long, size long").distinct()
    return rows.select(F.xxhash64("x_label", "y_label").alias("token"), "set_id", "label", "size")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each node's component, by contraction.

    Each round gives a node the least of itself and its neighbours, then joins edges of the contracted graph. Nodes
    must be hashes (here, of sets): then no long chain has its nodes in order, and a few of them are left each time.
    """
    spark = edges.sparkSession
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = None
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "cc-edges")
    while edges.count():
        step = materialize(both(edges).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("b")).withColumnsRenamed({"a": "node", "b": "label"}), "cc-step")
        # a chain of steps ends where a node is its own label; one jump shortens it
        jump = step.alias("s").join(step.alias("t"), F.col("s.label") == F.col("t.node"), "left").select("s.node", F.coalesce("t.label", "s.label").alias("label"))
        jump = materialize(jump, "cc-jump")
        if labels is None:
            labels = jump
        else:
            moved = labels.alias("l").join(jump.alias("j"), F.col("l.label") == F.col("j.node"), "left").select("l.node", F.coalesce("j.label", "l.label").alias("label"))
            labels = materialize(moved, "cc-labels")
        ends = edges.alias("e").join(jump.alias("x"), F.col("e.a") == F.col("x.node")).join(jump.alias("y"), F.col("e.b") == F.col("y.node"))
        edges = materialize(ends.select(F.col("x.label").alias("a"), F.col("y.label").alias("b")).where("a <> b").distinct(), "cc-edges")
    if labels is None:
        return spark.createDataFrame([], "node long, label long")
    return labels


def ngram_components(docs: DataFrame, n: int = N, threshold: int = THRESHOLD, sample: int = SAMPLE, common: int = COMMON, part: int = PART) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) for every row, and set_id (null: empty)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # which n-grams are common decides only how many sets meet, not which are linked
    key = F.xxhash64("doc_id", "text")
    drawn = docs.select(key.alias("key")).orderBy("key").limit(sample)
    grams = docs.withColumn("key", key).join(F.broadcast(drawn.distinct()), "key").dropDuplicates(["key"]).select("text").mapInPandas(_sample(n), "gram long")
    top = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "gram").limit(common).collect()
    known = np.array([r["gram"] for r in top], np.int64).view(np.uint64)
    klass = np.array([min(r["n"].bit_length(), (1 << CLASS_BITS) - 1) for r in top], np.uint64)
    by = np.argsort(known)
    sent = spark.sparkContext.broadcast((known[by], klass[by]))  # ``common`` entries at most
    sets = materialize(docs.mapInPandas(_sets(sent, n, threshold), _SETS), "ngram-sets")

    distinct = sets.where("set_id is not null and doc_id is not null")
    one = distinct.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))  # one row to stand for each set
    tokens = distinct.groupBy("set_id").agg(F.first("n_shingles").alias("n_shingles"), F.first("short").alias("short"), F.first("prefix").alias("prefix"))
    tokens = tokens.select(F.posexplode("prefix").alias("at", "token"), "set_id", "n_shingles", "short")

    def near(rows: DataFrame) -> DataFrame:
        """Rows that share their token with a set of like size: one next to it in order of size.

        A token that the sample shows to be common may be held by a large part of all sets; of these, the different
        sizes are counted first and ordered, and the rows meet the sizes found, so no task sorts all rows of one token.
        """

        def like(by: Window, alone=F.lit(False)):
            smaller, larger = F.lag("n_shingles").over(by), F.lead("n_shingles").over(by)
            return alone | (smaller * 100 >= F.col("n_shingles") * threshold) | (F.col("n_shingles") * 100 >= larger * threshold)

        is_common = F.col("token") >= F.lit(1 << HASH_BITS)  # the class is in the upper bits
        one_by_one = Window.partitionBy("token").orderBy("n_shingles", "set_id")
        rare = rows.where(~is_common).withColumn("like", like(one_by_one)).where("like").drop("like")
        sizes = rows.where(is_common).groupBy("token", "n_shingles").agg(F.count(F.lit(1)).alias("n"))
        sizes = sizes.withColumn("like", like(Window.partitionBy("token").orderBy("n_shingles"), F.col("n") > 1)).where("like")
        return rare.unionByName(rows.where(is_common).join(sizes.select("token", "n_shingles"), ["token", "n_shingles"], "left_semi"))

    # Linked sets of sizes a <= b have 1 + EXTRA * a / 100 elements or more in common among their prefixes, as these
    # are longer by as much; a set that shares fewer with all sets of like size together has no link.
    shared = materialize(near(tokens), "ngram-shared")
    least = F.floor(F.ceil(F.col("n_shingles") * threshold / F.lit(100)) * EXTRA / F.lit(100)) + 1
    enough = shared.groupBy("set_id", "n_shingles").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("set_id")
    shared = near(shared.where("at < short").join(enough, "set_id", "left_semi")).select("token", "set_id")
    shared = materialize(shared, "ngram-shared")
    met = shared.select("set_id").distinct().join(one, "set_id")
    elements = docs.join(met, "doc_id").select("set_id", "text").mapInPandas(_elements(sent, n), "set_id long, elements binary, size long, parity binary")
    heads = shared.groupBy("set_id").agg(F.slice(F.array_sort(F.collect_list("token")), 1, HEADS).alias("heads"))  # a set's own elements
    elements = materialize(elements.join(heads, "set_id"), "ngram-elements")

    # round 1: every set in the bundle of its first shared element
    home = shared.groupBy("set_id").agg(F.min("token").alias("token")).withColumn("label", F.col("set_id"))
    edges = materialize(join_bundles(home.join(elements.select("set_id", "size"), "set_id"), elements, threshold, part), "ngram-edges")
    labels = components(edges)

    def labelled() -> DataFrame:
        """Members of the bundles that still hold two labels."""
        got = shared.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
        several = got.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("mark")).where("least <> most")
        return got, several

    def merged(found: DataFrame) -> DataFrame:
        """Labels after links between them."""
        more = components(found)
        old = labels.alias("l").join(more.alias("m"), F.col("l.label") == F.col("m.node"), "left").select("l.node", F.coalesce("m.label", "l.label").alias("label"))
        return materialize(old.unionByName(more.alias("m").join(labels.alias("l"), F.col("m.node") == F.col("l.node"), "left_anti").select("node", "label")), "ngram-labels")

    # round 2: one set for each label of a bundle
    got, several = labelled()
    spokes = got.join(several.select("token"), "token", "left_semi").groupBy("token", "label").agg(F.min("set_id").alias("set_id"))
    spokes = spokes.select("token", "set_id", "label")
    marks = spokes.groupBy("token").agg(F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("mark"), F.count(F.lit(1)).alias("size"))
    once = marks.groupBy("mark", "size").agg(F.min("token").alias("token")).select("token")
    # (sets that stand for a label do so in one bundle and not in the other, so earlier bundles don't count)
    anywhere = elements.withColumn("heads", F.array().cast("array<long>"))
    pairs = materialize(candidate_bundles(spokes.join(once, "token", "left_semi"), anywhere, threshold, part), "ngram-pairs")
    found = materialize(join_bundles(pairs, elements, threshold, part, every_two_parts=True), "ngram-edges")
    labels = merged(found)

    # round 3: all that is left, whole
    got, several = labelled()
    once = several.groupBy("mark", "size").agg(F.min("token").alias("token")).select("token")
    pairs = materialize(candidate_bundles(got.join(once, "token", "left_semi").select("token", "set_id", "label"), elements, threshold, part), "ngram-pairs")
    found = materialize(join_bundles(pairs, elements, threshold, part, every_two_parts=True), "ngram-edges")
    labels = merged(found)

    labels = labels.withColumnRenamed("node", "set_id")
    # the smallest id of each set, then of each component; only sets that have links are in labels
    least = one.join(labels, "set_id").groupBy("label").agg(F.min("doc_id").alias("least"))
    of_set = one.join(labels, "set_id", "left").join(least, "label", "left").select("set_id", F.coalesce("least", "doc_id").alias("component_id"))
    out = sets.select("doc_id", "n_shingles", "set_id").join(of_set, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "set_id")
