"""Hard negatives, manifest and decontamination against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import decontamination, manifest, negatives

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string, slot long, known int, bits string"


def documents(spark, rows):
    """(doc_id, text, lang, source, n_chars); other columns clash with names that the operators use."""
    return spark.createDataFrame([(*r, "x", None, 7, 1, "y") for r in rows], DOCS).repartition(3)


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, text):
    doc_id, _, lang, source, n = r
    return h("".join(part(v) for v in (doc_id, source, lang, n, text)))


def brute_tree(nodes):
    """Root, and for each node its siblings (left, right) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            run = at[i] // 3 * 3
            p.append(("".join(nodes[run : at[i]]), "".join(nodes[at[i] + 1 : run + 3])))
            at[i] //= 3
        nodes = [h("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute_manifest(rows):
    by_source = defaultdict(list)
    for r in rows:
        tampered = r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
        by_source[r[3]].append((r[0] is not None, r[0] or 0, leaf_of(r, r[1]), leaf_of(r, tampered), r[0]))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subs = []
    for s in sources:
        by_source[s].sort(key=lambda x: x[:4])
        subs.append(brute_tree([x[2] for x in by_source[s]]))
    root, above = brute_tree([s[0] for s in subs])
    out = []
    for s, (sub, paths), up in zip(sources, subs, above):
        for (_, _, leaf, changed, doc_id), path in zip(by_source[s], paths):
            node = changed
            for a, b in path + up:
                node = h(a + node + b)
            out.append((doc_id, leaf, sub, root, h("".join(a + b for a, b in path + up)), node, node == root))
    return sorted(out, key=repr)


def manifest_rows(spark, rows, depth=manifest.DEPTH):
    docs = documents(spark, rows)
    out = manifest.manifest(docs, manifest.without_breaks(F.col("doc_id"), F.col("text")), depth)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("depth", [1, 3])
def test_manifest_is_that_of_sorted_leaves(spark, depth):
    rng = random.Random(depth)
    ids = rng.sample(range(-9000, 9000), 140) + [2**62, -(2**62), 2**40 + 1, 2**40]
    rows = [(i, rng.choice(["a\nb", "\n", "", None, "é中\n", "long " * 3000 + "\n"]), rng.choice(["en", None]), rng.choice(["hot", "hot", "hot", "b", "é", "B", None, "lone%d" % i]), rng.choice([None, i % 7])) for i in ids]
    assert manifest_rows(spark, rows, depth) == brute_manifest(rows)


def test_manifest_of_repeated_and_null_ids(spark):
    rows = [(5, "a\n", "en", "s", 1)] * 40 + [(5, "t%d\n" % i, "en", "s", i) for i in range(30)] + [(None, "n%d" % (i % 4), None, "s", None) for i in range(9)] + [(4, "x", "en", "s", 1), (6, "y\n", "en", "s", 2), (5, None, None, None, None)]
    assert manifest_rows(spark, rows) == brute_manifest(rows)


def test_manifest_of_few_rows(spark):
    one = [(1, "a\nb", "en", "s", 3)]
    got = manifest_rows(spark, one)
    assert got == brute_manifest(one)
    assert got[0][4] == h("")
    assert manifest_rows(spark, []) == []


def test_blocks_of_blocks():
    width = manifest.FAN**manifest.DEPTH
    assert [manifest.passes(n) for n in (0, 1, width, width + 1, width**2, width**2 + 1)] == [1, 1, 1, 2, 2, 3]


# -- decontamination


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute_hits(docs, items):
    wins = defaultdict(set)
    for item, text in items:
        w = split(text)
        for i in range(max(len(w) - 10, 0) + 1 if w else 0):
            wins[tuple(w[i : i + 10])].add("" if item is None else str(item))
    sizes = {len(w) for w in wins}
    out = []
    for doc_id, text in docs:
        w, hit, ids = split(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := wins.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    ids |= found
        out.append((doc_id, len(w), len(hit), len(ids), h(",".join(sorted(ids))), bool(hit)))
    return sorted(out, key=repr)


def hit_rows(spark, docs, items):
    d = spark.createDataFrame([(*r, 1, "k", 2) for r in docs], "doc_id long, text string, row long, words string, n int").repartition(3)
    b = spark.createDataFrame([(*r, "w") for r in items], "item_id long, text string, win string")
    out = decontamination.decontaminate(d, b)
    assert out.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_decontamination_is_that_of_all_windows(spark):
    rng = random.Random(3)
    vocab = ["the", "of", "É", "é", "ß", "İ", "x1", "中文", "Σ", "ς"] + ["w%d" % i for i in range(30)]
    text = lambda n, words=vocab: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([11, 14, 25]))) for i in range(12)] + [(12, text(10)), (13, "The É, x1!"), (14, "solo"), (15, ""), (16, None), (17, "..."), (None, text(13)), (3, text(12)), (18, "a " * 15), (100, text(12))]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    docs += [(50 + i, text(7) + "\n" + (t or "").upper().replace("É", "É") + ". " + text(5)) for i, (_, t) in enumerate(items)]
    docs += [(90, items[0][1] + " " + items[0][1]), (91, " ".join(items[1][1].split()[:9])), (92, "a " * 40), (93, None), (94, ""), (95, "solo"), (None, items[2][1]), (95, "solo"), (96, text(30000) + " " + items[5][1]), (97, "the, É; X1"), (98, items[4][1] + items[3][1])]
    got = hit_rows(spark, docs, items)
    assert got == brute_hits(docs, items)
    assert sum(r[-1] for r in got) > 15


def test_decontamination_with_few_words_and_many_repeats(spark):
    """Every shingle is frequent, windows overlap themselves, many rows are equal."""
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("ab") for _ in range(12))) for i in range(6)]
    docs = [(i, " ".join(rng.choice("ab") for _ in range(150))) for i in range(20)] + [(7, items[0][1])] * 30
    assert hit_rows(spark, docs, items) == brute_hits(docs, items)


def test_decontamination_of_empty_tables(spark):
    assert hit_rows(spark, [], [(1, "a b c")]) == []
    assert hit_rows(spark, [(1, "a b")], []) == [(1, 2, 0, 0, h(""), False)]


def test_decontamination_runs_no_python(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    plan = decontamination.decontaminate(d, b)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions", plan)


# -- hard negatives


def brute_negatives(rows):
    seen = {}
    for i, label, vec in rows:
        if i is None or label is None or not vec or any(v is None or not np.isfinite(v) for v in vec):
            continue
        whole = [int(np.floor(256 * v)) for v in vec]
        seen[i] = min(seen.get(i, (label, whole)), (label, whole))
    dims = defaultdict(int)
    for _, v in seen.values():
        dims[len(v)] += 1
    dim = min(dims, key=lambda d: (-dims[d], d)) if dims else 0
    items = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, (label, v) in seen.items() if len(v) == dim]
    out = []
    for a, la, va in items:
        if a % 100:
            continue
        score = {i: sum(p * q for p, q in zip(va, v)) for i, _, v in items}
        order = sorted((x for x in items if x[0] != a), key=lambda x: (-score[x[0]], x[0]))
        for p in [x[0] for x in order if x[1] == la][:5]:
            good = [x[0] for x in order if x[1] != la and 30 * score[p] <= 100 * score[x[0]] <= 90 * score[p]][:10]
            out += [(a, p, n + 1, g, score[p], score[g]) for n, g in enumerate(good)]
    return sorted(out)


def negative_rows(spark, rows, **how):
    v = spark.createDataFrame([(*r, "c", 1, None) for r in rows], "vec_id long, label int, embedding array<float>, cell string, shard int, ids string").repartition(3)
    out = negatives.hard_negatives(*negatives.query_rows(v), **how)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("probe", [4, 1024])
def test_negatives_are_those_of_all_pairs(spark, probe):
    """Clusters, so that bounds exclude cells; ties, equal vectors, and rows that take no part."""
    rng = np.random.default_rng(probe)
    centres = rng.normal(size=(6, 9))
    vec = lambda: (centres[rng.integers(6)] + 0.15 * rng.normal(size=9)).astype(np.float32).tolist()
    rows = [(i, int(rng.integers(3)), vec()) for i in range(1, 420)] + [(1000, 0, vec()), (1100, 1, vec()), (1200, 2, vec()), (-100, 1, vec()), (0, 2, vec())]
    rows += [(2000 + i, i % 3, [0.5] * 9) for i in range(90)] + [(3000 + i, i % 2, rows[7][2]) for i in range(60)]
    rows += [(5000, None, vec()), (5001, 1, None), (5100, 1, [None] + [0.5] * 8), (5200, 1, [float("nan")] * 9), (5300, 1, [float("inf")] * 9), (None, 1, vec()), (5400, 1, []), (5500, 1, [0.5] * 4), (12, 2, vec()), (12, 2, vec()), (14, 1, rows[3][2])]
    got = negative_rows(spark, rows, part=64, block=2, probe=probe)
    assert got == brute_negatives(rows)
    assert len(got) > 100


def test_negatives_visit_cells_in_order_and_stop():
    rng = np.random.default_rng(1)
    x = np.concatenate([c + 0.05 * rng.normal(size=(60, 8)) for c in 4 * rng.normal(size=(12, 8))]) * 256
    index = negatives.MultiIndex(x, 8)
    cells, far = index.encode(x)
    for half in (0, 1):
        code = cells // 8 if half == 0 else cells % 8
        for c in range(8):
            index.radii[half][c] = far[half][code == c].max(initial=0)
    for c in cells:
        index.filled[c // 8, c % 8] += 1
    q = x[5]
    seen = list(index.visit(q))
    assert [s[0] for s in seen] == sorted((s[0] for s in seen), reverse=True)
    assert sorted(s[2] for s in seen) == sorted(set(cells.tolist()))
    score = x @ q
    for upper, lower, cell, n in seen:
        mine = score[cells == cell]
        assert len(mine) == n and mine.max() <= upper and mine.min() >= lower
    floor = float(np.sort(score)[-6])
    first, rest = index.cells(q, 50), index.cells(q, 50, floor)
    assert set(cells[score >= floor].tolist()) <= set(first) | set(rest) and not set(first) & set(rest)
    assert len(first) + len(rest) < len(seen) / 2


def test_negatives_with_huge_components(spark):
    """Products beyond what doubles hold exactly; scores beyond 64 bits count as the largest that fits."""
    rows = [(i, i % 2, [float(2.0**15) * (1 + i % 5), 1.5 * i]) for i in range(1, 30)] + [(100, 1, [2.0**15, 3.0]), (200, 0, [2.0**14, 2.0])]
    assert negative_rows(spark, rows) == brute_negatives(rows)
    q, x = np.array([[2**40, 3]]), np.array([[2**40, 1], [5, 7], [-(2**40), 0]])
    assert negatives.exact_scores(q, x).tolist() == [[negatives.LIMIT, 5 * 2**40 + 21, -negatives.LIMIT]]


def test_negatives_of_empty_tables(spark):
    assert negative_rows(spark, []) == []
    assert negative_rows(spark, [(1, 2, [1.0, 2.0])]) == []
    assert negative_rows(spark, [(100, 2, [1.0, 2.0])]) == []
