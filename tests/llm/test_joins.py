"""N-gram join, suffix dedup, neighbours, mixing, pipeline."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna.llm import mixing, neighbours, ngram_join, suffix_dedup

DOCS = "doc_id long, text string, lang string, set_id string, label string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "k", "s") for i, t in rows], DOCS).repartition(4)


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def union(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# -- n-gram join


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets, u = {i: grams(t or "") for i, t in rows}, Union()
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                u.union(a, b)
    return {i: (len(sets[i]), u.find(i)) for i in ids}


@pytest.mark.parametrize("part", [3, 2000])
def test_components_are_those_of_all_pairs(spark, part):
    rng = random.Random(part)
    vocab = ["w%d" % i for i in range(400)] + ["É", "é", "The", "the"]
    bases = [[rng.choice(vocab) for _ in range(rng.randint(5, 120))] for _ in range(9)]
    common = [rng.choice(vocab) for _ in range(25)]
    rows = []
    for i in rng.sample(range(100000), 170):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.3:
            w = [rng.choice(vocab) for _ in range(20)] + common
        rows.append((i, rng.choice([" ", "\n ", "\t"]).join(w)))
    rows += [(200001, None), (200002, " \n"), (200003, "one two"), (200004, "ONE  two"), (200005, "two one")]
    want = brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs(spark, rows), sample=60, part=part).collect()}
    assert got == want


def test_join_of_odd_tables(spark):
    assert ngram_join.ngram_components(docs(spark, [(1, "a")]).limit(0)).count() == 0
    got = ngram_join.ngram_components(docs(spark, [(2, "a b c d"), (2, "a b c d"), (1, "A b c d"), (None, "a b c d"), (None, None)])).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got if r.doc_id) == [(1, 1), (2, 1), (2, 1)] and len(got) == 5
    assert {r.component_id for r in got if r.doc_id is None} == {None}


def test_trie_join_with_labels():
    rng = random.Random(1)
    for _ in range(300):
        base = [rng.sample(range(60), rng.randint(1, 25)) for _ in range(3)]
        sets = set()
        for _ in range(rng.randint(2, 12)):
            b = set(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                b ^= {rng.randrange(60)}
            if b:
                sets.add(tuple(sorted(b)))
        sets = [np.array(s, np.uint64) for s in sets]
        labels, t, u = [rng.randrange(20) for _ in sets], rng.choice([60, 80, 90]), Union()
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if labels[i] == labels[j] or 100 * both >= t * (len(sets[i]) + len(sets[j]) - both):
                    u.union(i, j)
        got = ngram_join.trie_join(sets, labels, t)
        assert len({(u.find(i), got[i]) for i in range(len(sets))}) == len({u.find(i) for i in range(len(sets))}) == len(set(got))


def test_long_chain_of_edges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in ngram_join.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# -- suffix dedup


def brute_repeats(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(i, first.get(s, i))
    out = defaultdict(list)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone) if not y)
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out[i].append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return {i: sorted(v) for i, v in out.items()}


def test_repeats_are_those_of_all_strings(spark):
    rng = random.Random(5)
    pieces = ["".join(rng.choice("abcé \n") for _ in range(rng.randint(30, 130))) for _ in range(25)]
    rows = [(i, "".join(rng.choice(pieces)[rng.randint(0, 20) :][: rng.randint(10, 120)] for _ in range(rng.randint(0, 6))) + rng.choice(["", "a" * rng.randint(0, 150), "ab" * rng.randint(20, 90)])) for i in rng.sample(range(10000), 200)]
    rows += [(10001, None), (10002, ""), (10003, "x" * 49), (10004, "x" * 50), (10005, "x" * 3000)]
    rows += [(5, rows[0][1]), (5, rows[1][1] + rows[2][1]), (5, rows[1][1] + rows[2][1])]  # rows that repeat an id
    got = defaultdict(list)
    for r in suffix_dedup.remove_repeats(docs(spark, rows)).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {i: sorted(v) for i, v in got.items()} == brute_repeats(rows, 50)


def test_repeats_keep_texts_and_other_lengths(spark):
    rows = [(2, "0123456789" * 3 + "tail"), (1, "head" + "0123456789" * 3), (None, "0123456789" * 3)]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs(spark, rows), length=20, gram=8, keep_text=True, carry=("label",)).collect()}
    assert bytes(got[2].kept) == b"tail" and got[2].spans == [[0, 30]] and got[1].n_removed == 0 and got[2].label == "s"
    assert bytes(got[None].kept) == b""
    assert suffix_dedup.remove_repeats(docs(spark, rows).limit(0)).count() == 0


def test_suffix_ranks_order_suffixes():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 2, (12, 84)).astype(np.uint8)
    rank = suffix_dedup.suffix_ranks(rows, 50)[:, :35]
    flat = [(rows[i, s : s + 50].tobytes(), rank[i, s]) for i in range(12) for s in range(35)]
    ordered = sorted(flat)
    assert [r for _, r in ordered] == sorted(r for _, r in flat)
    assert len({b for b, _ in flat}) == len({r for _, r in flat}) == len(set(flat))


def test_previous_factors_are_the_longest_shared_with_a_smaller_document():
    rng = np.random.default_rng(3)
    for n, letters in ((1, 2), (2, 1), (60, 1), (400, 2), (300, 3)):
        strings = rng.integers(0, letters, (n, 6)).astype(np.uint8)
        doc = rng.integers(0, 9, n)
        got = suffix_dedup.previous_factors(suffix_dedup.row_ranks(strings), doc, strings.__getitem__)
        alike = (strings[:, None] == strings[None]).all(2).sum(1)
        for i in range(n):
            others = [int(np.append(np.nonzero(strings[i] != strings[j])[0], 6)[0]) for j in np.nonzero(doc < doc[i])[0]]
            want = max(others, default=0)
            assert (got[i] == 6) == (want == 6)
            # among suffixes that occur again; a shorter factor may lie with one that doesn't
            assert got[i] <= want and (alike[i] > 1 or got[i] == 0)
        order = np.lexsort((doc, suffix_dedup.row_ranks(strings)))
        value = doc[order]
        at, way = suffix_dedup.smaller_before(value, common := suffix_dedup.common_prefixes(strings[order]))
        for i in range(n):
            j = next((j for j in range(i - 1, -1, -1) if value[j] < value[i]), -1)
            assert at[i] == j and way[i] == (common[j + 1 : i + 1].min() if j >= 0 else 0)


def test_anchor_with_very_many_contexts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 3)
    rng = np.random.default_rng(4)
    word = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    hot, tails = word(40), [word(15) for _ in range(4)]
    rows = [(i, word(40) + hot + tails[i % 4] + word(30)) for i in range(24)]
    doc = np.array([r[0] for r in rows])
    blob = np.array([np.frombuffer(t[20:104].encode(), np.uint8) for _, t in rows])  # contexts of the anchor at byte 54
    n = len(rows)
    data = np.array([n], "<u4").tobytes() + doc.astype("<i8").tobytes() + np.zeros(n, "<i8").tobytes() + np.full(n, 54, "<u4").tobytes() + np.full(n, 34, "<u1").tobytes() + np.full(n, 50, "<u1").tobytes() + blob.tobytes()
    home = suffix_dedup._compare(50, 16, 1)((0,), pd.DataFrame({"blob": [data]}))
    got = suffix_dedup._at_home((0,), home)
    spans = {int(d): np.frombuffer(s, "<u4").reshape(-1, 2).tolist() for d, s in zip(got["doc"], got["spans"])}
    windows = {}
    for i, t in rows:
        for a in range(20, 55):
            windows.setdefault(t[a : a + 50], []).append(i)
    for i, t in rows:
        covered = {x for a in range(20, 55) if min(windows[t[a : a + 50]]) < i for x in range(a, a + 50)}
        assert covered == {x for a, b in spans.get(i, []) for x in range(a, b)}
    assert len(spans) == 20


# -- neighbours


def test_neighbours_in_small_lists_are_all_found(spark):
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(6, 8)) * 40
    rows = [(i, (middles[i % 5] + rng.normal(size=8)).tolist()) for i in range(600)] + [(1000 + i, (middles[5] + rng.normal(size=8)).tolist()) for i in range(3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(frame, neighbours.divisible_queries(frame, 100)).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {i: 20 for i in [*range(0, 600, 100), 1000]}


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2500, 24))
    x[100:1100] = x[100]  # one vector for two fifths of the ids
    data = [(int(i), [float(v) for v in x[i]], "s") for i in range(2500)]
    odd = [(5000, None, ""), (5020, [0.0] * 24, ""), (5040, [float("nan")] + [1.0] * 23, ""), (5060, [None] + [1.0] * 23, ""), (5080, [1.0], ""), (None, [1.0] * 24, "")]
    frame = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, score string")
    got = defaultdict(list)
    for r in neighbours.nearest_neighbours(frame, neighbours.divisible_queries(frame), k=20, part=300, block=40).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 2500, 20))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(2500), -s))[:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(s[v] - w) < 1e-9 for _, v, w in found)
        assert [(-w, v) for _, v, w in found] == sorted((-w, v) for _, v, w in found)
        hits += len({v for _, v, _ in found} & set(best.tolist()))
    assert hits / (20 * len(got)) >= 0.9
    assert [v for _, v, _ in sorted(got[200])] == list(range(100, 120))  # a tie goes to the smaller ids


def test_neighbours_in_clusters_tighter_than_codes_and_off_the_origin(spark):
    """Inner products that codes can't tell apart, and vectors that the lists' order says little about."""
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(6, 48)) * 3
    tight = middles[rng.integers(0, 6, 5000)] + rng.normal(size=(5000, 48)) * 0.01
    for x in (tight / np.linalg.norm(tight, axis=1, keepdims=True), rng.normal(size=(4000, 48)) * 0.05 + 1):
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = defaultdict(set)
        for r in neighbours.nearest_neighbours(frame, neighbours.divisible_queries(frame)).collect():
            got[r.query_id].add(r.vec_id)
        hits = 0
        for q, found in got.items():
            s = x @ x[q]
            s[q] = -np.inf
            hits += len(found & set(np.argsort(-s)[:20].tolist()))
        assert len(got) == -(-len(x) // 20) and hits / (20 * len(got)) >= 0.95


def test_neighbours_of_small_tables(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(frame, neighbours.divisible_queries(frame)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.nearest_neighbours(frame.limit(0), frame.limit(0)).count() == 0


# -- mixing


def test_water_fill_gives_shortages_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("b", "x", "3", 1000), ("c", "y", "4", 5), (None, "y", "5", 100)], "domain string, lang string, source string, tokens long")
    weights = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (1, "c", 1.0), (1, "\\N", 0.0)], "level int, path string, weight double")
    got = {r.source: r.given for r in mixing.leaf_budgets(leaves, weights, F.lit(300.0)).collect()}
    # c is short of 95, which a and b share; a's first leaf is short, and its sibling takes that
    assert got == {"1": 10, "2": 137, "3": 147, "4": 5, "5": 0}
    assert sum(r.given for r in mixing.leaf_budgets(leaves, None, F.lit(1e9)).collect()) == 2115


def test_prefixes_of_seeded_epochs(spark):
    rng = random.Random(7)
    rows = [(i, " ".join("w" * rng.randint(0, 9)), "en", f"s{rng.randrange(3)}", "d") for i in range(200)] + [(900, None, None, "s0", "d"), (901, "", "en", "s1", "d"), (7, "a b", "en", "s0", "d"), (7, "a b", "en", "s0", "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string").withColumn("epoch", F.lit("clash"))
    total = sum(len((t or "").split()) for _, t, *_ in rows)
    for share, epochs in ((0.4, 1), (1.7, 3), (9.0, 2), (0.0, 1)):
        got = mixing.mix(frame, None, share, max_epochs=epochs).collect()
        taken = sum(r.take_tokens for r in got)
        assert abs(taken - min(share * total, epochs * total)) <= 20
        assert all(0 < r.take_tokens <= r.n_tokens for r in got)
        again = mixing.mix(frame, None, share, max_epochs=epochs).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(frame.limit(0)).count() == 0


# -- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    rows, labels, passage = [], [], text(60)
    for i in range(240):
        t = ". ".join(text(15) for _ in range(6))
        bad = i % 6 == 0
        if bad:
            t += " zzvile people."
        rows.append([i, t, "en", f"src{i % 5}", len(t)])
        labels.append((i, 0, int(bad)))
    rows += [[300, rows[1][1], "en", "src1", 0], [301, rows[2][1] + " extra", "en", "src1", 0], [302, text(80) + passage, "de", "src2", 0], [303, text(70) + passage + text(30), "de", "src2", 0], [304, None, None, None, None]]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([tuple(r) for r in rows], columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, kept = corpus_pipeline.read(spark, str(tmp_path), "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.materialize(stage(spark, at, str(tmp_path)), name)
        assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r.text for r in at.collect()}
    clean = {i for i, r in enumerate(rows[:240]) if i % 6}
    assert len(kept["toxicity"].keys() & clean) >= 0.97 * len(clean) and len(set(range(0, 240, 6)) & kept["toxicity"].keys()) <= 3
    assert {300, 301} & kept["ngram_join"].keys() == set() and {1, 2, 302, 303} <= kept["ngram_join"].keys()
    assert passage in kept["suffix_dedup"][302] and passage not in kept["suffix_dedup"][303]
    assert set(kept["mixing"]) < set(kept["suffix_dedup"])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept["mixing"])


def test_pipeline_drops_near_copies(spark):
    import corpus_pipeline

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [[word() for _ in range(n)] for n in (200, 1000, 200)]
    longer = base[0] + [word() for _ in range(30)]
    changed = [word() if i % 50 == 25 else w for i, w in enumerate(base[1])]
    other = [word() if i % 20 == 10 else w for i, w in enumerate(base[2])]  # 5-word similarity 0.59
    for a, b in ((base[0], longer), (base[1], changed)):
        x, y = grams(" ".join(a)), grams(" ".join(b))
        assert 100 * len(x & y) < 90 * len(x | y)
    rows = [(i, " ".join(w)) for i, w in enumerate([*base, longer, changed, other])]
    frame = docs(spark, rows).selectExpr("doc_id", "text", "lang", "'s' as source", "0L as n_chars")
    assert sorted(r.doc_id for r in corpus_pipeline.ngram_join(spark, frame, "").collect()) == [0, 1, 2, 5]


def brute_five(rows, threshold):
    sets, u = {}, Union()
    for i, t in rows:
        w = t.split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1)))
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                u.union(a, b)
    return {i: u.find(i) for i in sets}


def test_components_at_the_pipeline_bounds(spark):
    rng = random.Random(13)
    bases = [[f"w{rng.randrange(500)}" for _ in range(rng.randint(6, 150))] for _ in range(8)]
    rows = []
    for i in rng.sample(range(10000), 150):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"w{rng.randrange(500)}"
        rows.append((i, " ".join(w + [f"x{rng.randrange(9)}" for _ in range(rng.choice([0, 0, len(w) // 6]))])))
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs(spark, rows), n=5, threshold=80, sample=60, part=20).collect()}
    assert got == brute_five(rows, 80) != brute_five(rows, 90)


def test_pipeline_keeps_one_row_of_near_copies(spark):
    import corpus_pipeline

    rng = random.Random(14)
    a, b, c, d, e = (" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)) for _ in range(5))
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c), (None, a), (None, b + " more"), (None, d), (None, d + " more"), (2, e + " more"), (2, e), (9, None), (9, None), (None, None), (None, " "), (None, " ")]
    frame = docs(spark, rows).selectExpr("doc_id", "text", "lang", "'s' as source", "0L as n_chars")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.ngram_join(spark, frame, "").collect()]
    words = [(i, t) for i, t in got if (t or "").strip()]
    assert {(3, a), (5, b), (7, c)} < set(words) and len(words) == 5
    assert [t in (d, d + " more") for i, t in words if i is None] == [True]
    assert [t in (e, e + " more") for i, t in words if i == 2] == [True]
    assert len(got) - len(words) == 5
    assert corpus_pipeline.ngram_join(spark, frame.limit(0), "").count() == 0
