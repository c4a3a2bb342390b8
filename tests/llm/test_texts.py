"""Licences, fingerprints, packing, toxicity, quality."""

import hashlib
import pathlib
import random
import zlib

import numpy as np
import pytest

from lacuna.llm import fingerprints, licenses, packing, quality, toxicity
from lacuna.llm.common import rolling_hash, sliding_min

DOCS = "doc_id long, text string, lang string, key string, score string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "k", "s") for i, t in rows], DOCS)


def test_rolling_hash_and_minimum():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, 300).astype(np.uint32)
    for k in (1, 2, 5, 16, 20, 31):
        h = rolling_hash(x, k)
        same = {}
        for i in range(len(x) - k + 1):
            assert same.setdefault(x[i : i + k].tobytes(), h[i]) == h[i]
        assert len(set(same.values())) == len(same)
        assert (sliding_min(h, 7) == [h[i : i + 7].min() for i in range(len(h) - 6)]).all()


# -- licences


def test_license_variants(spark):
    mit = licenses.LICENSES["MIT"]
    changed = mit.replace("License", "LICENCE", 1).replace("Copyright (c) <year> <copyright holders>", "  * Copyright 2020, 2021 Someone\n(c) Someone Else").replace("\n", "\r\n\t ").replace('"', "“").replace(",", " ;")
    rows = [(1, mit), (2, changed), (3, mit + " and more"), (4, None), (5, ""), (None, "Released under the MIT License."), (1, mit), (7, "Copyright 2020\nAll rights reserved.")]
    got = [(r.doc_id or 0, r.license_id) for r in licenses.license_scan(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(0, "MIT-notice"), (1, "MIT"), (1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (7, None)], key=str)
    assert licenses.license_scan(docs(spark, rows).limit(0)).count() == 0


def test_license_digests_are_distinct(spark):
    known = licenses.known_licenses(spark).where("digest is null").select(licenses.canonical(licenses.text_or_empty()).alias("c")).distinct()
    assert known.count() == len(licenses.LICENSES)


def test_license_titles_and_notices(spark):
    body = licenses.LICENSES["MIT"].split("\n\n", 2)[2]
    own = "Copyright (c) 2020 Jo Doe"
    found = [
        f"The MIT License (MIT)\n\n{own}\n\n{body}",
        f"{own}\n\n{body}",
        body,
        f"MIT License\n\nCopyright Jo Doe 2020\n\n{body}",
        f"MIT License\n\n(c) Jo Doe, 2020\n\n{body}",
        f"MIT License\n\n{own}\nPortions Copyright (c) 2019 Al\n\n{body}",
        f"MIT License\n\n{own} and a long list of\ncontributors, who are named in AUTHORS\n\n{body}",
        f"Copyright Node.js contributors. All rights reserved.\n\n{body}",
        f"Copyright The Go Authors. All rights reserved.\n\n{body}",
        f"# MIT License\r\n\r\n{own}\r\n\r\n{body}",
        f"MIT License\n===========\n\n{own}\nCopyright (c) 2021 Al\n\n{body}",
    ]
    other = [f"{body}\n\nand more", f"A story of a license\n\n{own}\n\nOnce upon a time", f"{body[:200]}\nCopyright law of 1976 holds.\n{body[200:]}"]
    notices = ["Copyright (c) 2020 X\nReleased under the MIT License.\n\n", "Released under the MIT License.\n\n"]
    long = [body + " x" * 2_000_000]
    rows = list(enumerate(found + other + notices + long))
    got = {r.doc_id: r.license_id for r in licenses.license_scan(docs(spark, rows).withColumnsRenamed({"key": "digest", "score": "canonical"})).collect()}
    assert [got[i] for i, _ in rows] == ["MIT"] * len(found) + [None] * len(other) + ["MIT-notice"] * 2 + [None]


@pytest.mark.parametrize("name", sorted(licenses.DIGESTS))
def test_license_digests_are_those_of_the_texts(spark, name):
    path = pathlib.Path("/usr/share/common-licenses") / (name.removesuffix(".0") if name[0] in "GL" else name)
    if not path.exists():
        pytest.skip("no copy of the text here")
    text = path.read_text()
    wrapped = "\n".join("// " + line.strip() for line in text.splitlines())
    got = licenses.license_scan(docs(spark, [(1, text), (2, wrapped), (3, text + "\n.x")])).collect()
    assert {r.doc_id: r.license_id for r in got} == {1: name, 2: name, 3: None}


# -- fingerprints


def brute_winnow(text, k, w):
    if len(text) < k:
        return fingerprints.winnow(text, k, w)
    h = (rolling_hash(np.array([ord(c) for c in text], np.uint32), k) >> np.uint64(32)).tolist()
    kept = set()
    for i in range(max(1, len(h) - w + 1)):
        part = h[i : i + w]
        kept.add(max(i + j for j, x in enumerate(part) if x == min(part)))
    pos = sorted(kept)
    return np.array([h[p] for p in pos], np.uint32), np.array(pos, np.uint32)


@pytest.mark.parametrize("segment", [1 << 20, 7])
def test_winnow_is_the_definition(monkeypatch, segment):
    monkeypatch.setattr(fingerprints, "SEGMENT", segment)
    rng = random.Random(2)
    for _ in range(60):
        t = "".join(rng.choice("abñ𝄞") for _ in range(rng.randint(0, 150)))
        h, p = fingerprints.winnow(t, 5, 8)
        bh, bp = brute_winnow(t, 5, 8)
        assert h.tolist() == bh.tolist() and p.tolist() == bp.tolist()
        dh, dp = fingerprints.decode(fingerprints.encode(h, p))
        assert dh.tolist() == h.tolist() and dp.tolist() == p.tolist()


def test_common_passage_is_found():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common = text(fingerprints.K + fingerprints.W - 1)
    a, _ = fingerprints.winnow(text(100) + common + text(30))
    b, _ = fingerprints.winnow(text(7) + common + text(300))
    assert set(a.tolist()) & set(b.tolist())


def test_fingerprints_follow_descending_ids(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab cd") for _ in range(rng.randint(0, 200)))) for i in rng.sample(range(500), 60)] + [(700, None), (701, ""), (702, "x")]
    got = {r.doc_id: r for r in fingerprints.document_fingerprints(docs(spark, rows), blocks=9).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    assert len(got) == len(rows)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert got[i].fingerprint == fingerprints.encode(*fingerprints.winnow(t)) and got[i].edited_fingerprint == fingerprints.encode(*fingerprints.winnow(e))
        assert 0 <= got[i].near_next <= 1


def test_fingerprints_of_odd_tables(spark):
    assert fingerprints.document_fingerprints(docs(spark, [(1, "a")]).limit(0)).count() == 0
    assert fingerprints.document_fingerprints(docs(spark, [(1, "a")])).first().near_next == 1.0
    assert fingerprints.document_fingerprints(docs(spark, [(1, "abc"), (1, "abc"), (1, "xyz"), (None, "q"), (None, None)]), blocks=3).count() == 5


# -- packing


def test_first_fit_decreasing_by_definition():
    rng = random.Random(5)
    for _ in range(80):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(0, 50))]
        bins = []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            for b in bins:
                if sum(sizes[j] for j in b) + sizes[i] <= 64:
                    b.append(i)
                    break
            else:
                bins.append([i])
        assert packing.first_fit_decreasing(sizes, 64) == bins


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(6)
    words = ["alpha", "Beta's", "γάμμα", "Ünïcode", "é", "x\x1cy", "12,5", "###", "日本語", "ΣΑΣ", "<|endoftext|>"]
    rows = [(i, rng.choice([" ", "\n", "  \t"]).join(rng.choice(words) for _ in range(rng.randint(0, 400)))) for i in range(60)] + [(60, None), (61, ""), (3, "again")]
    out = packing.pack(docs(spark, rows), path, length=256, group_docs=20).collect()
    tok = Tokenizer.from_file(path)
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    assert sum(r.length for r in out) == sum(len(x) for v in ids.values() for x in v)
    for r in out:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append(r)
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256 and (at == 256 or at & (at - 1) == 0)
    assert packing.pack(docs(spark, [(1, "a")]).limit(0), path).count() == 0


# -- toxicity and quality


def corpus(n, seed):
    rng = random.Random(seed)
    good = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(good) for _ in range(rng.randint(4, 12))) for _ in range(rng.randint(1, 12))]
        bad = rng.random() < 0.2
        if bad:
            k = rng.randrange(len(sentences))
            sentences[k] += " " + rng.choice(["zzvile", "zzscum", "zzrot"])
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark):
    rows, labels = corpus(900, 8)
    rows += [(5000, None), (5001, ""), (5002, "zzvile " * 5000), (None, "zzscum.")]
    frame = spark.createDataFrame(labels + [(5001, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs(spark, rows), frame).collect()}
    assert len(got) == len(rows)
    held = [(got[i], y) for i, y in labels if got[i].held_out]
    assert len(held) > 100 and sum(r.predicted == y for r, y in held) / len(held) > 0.97
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == got[i].held_out for i, _ in labels)
    assert got[5000].score == got[5001].score == 0 and got[5002].predicted == 1
    text = dict(rows)
    found = [text[i][got[i].worst_start : got[i].worst_end] for i, y in labels if y and got[i].predicted]
    assert sum("zz" in s for s in found) / len(found) > 0.98
    kept = toxicity.drop_toxic(docs(spark, rows), frame)
    assert kept.columns == DOCS.replace(",", "").split()[::2] and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(docs(spark, [(1, "a b. c")]), none).first().score < 1e-6
    assert toxicity.toxicity(docs(spark, [(1, "a")]).limit(0), none).count() == 0


def test_quality_tells_junk_apart(spark):
    rows, _ = corpus(300, 9)
    rng = random.Random(10)
    junk = []
    for i in range(80):
        w = ["word%d" % rng.randrange(50) for _ in range(60)]
        junk.append((1000 + i, [" ".join(x.upper() + "!!" for x in w), " ".join(x + "###" for x in w), " | ".join(w), " ".join([w[0]] * 60)][i % 4]))
    extra = [(2000, None), (2001, ""), (2002, "short")]
    got = {r.doc_id: r for r in quality.quality(docs(spark, rows + junk + extra)).collect()}
    assert len(got) == 383
    assert sum(got[i].keep for i, _ in rows) / len(rows) > 0.97 and sum(got[i].keep for i, _ in junk) / len(junk) < 0.1
    assert quality.quality(docs(spark, rows).limit(0)).count() == 0


def test_label_model_finds_the_rates():
    rng = np.random.default_rng(3)
    n = 20000
    kind = np.where(rng.random(n) < 0.8, 0, rng.integers(1, 5, n))
    fire = np.stack([rng.random(n) < np.where(kind == j + 1, 0.9, 0.01) for j in range(4)], 1)
    votes = ["".join("b" if f else "-" for f in row) for row in fire]
    names, counts = np.unique(votes, return_counts=True)
    post, shares, rates = quality.estimate(names.tolist(), counts.astype(float))
    at = dict(zip(names, post))
    right = np.mean([(at[v] >= 0.5) == (k == 0) for v, k in zip(votes, kind)])
    assert right > 0.95 and abs(shares[0] - 0.8) < 0.06


def test_wrapped_licenses_are_found(spark):
    import textwrap

    rows, want = [], {}
    for name, text in licenses.LICENSES.items():
        body = text.replace("<year>", "2019").replace("<copyright holders>", "The Example Authors").replace("<owner>", "Example Inc.")
        for width in range(60, 100):
            want[len(rows)] = name
            rows.append((len(rows), "\n\n".join(textwrap.fill(p, width) for p in body.split("\n\n"))))
    got = {r.doc_id: r.license_id for r in licenses.license_scan(docs(spark, rows)).collect()}
    assert got == want


def test_ids_of_every_safe_code_point():
    import public_tokenizers

    tok = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"a{c}b {c}1{c} x" for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and not tok.unusual(c)]
    texts += [f"a{chr(c)}b {chr(c)}1" for c in range(0x530, 0x110000, 97) if not 0xD800 <= c < 0xE000]
    want = [np.array(e.ids, "<u4").tobytes() for e in tok.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert len(texts) > 30_000 and tok.encode(texts) == want
