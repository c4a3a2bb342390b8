"""Quality scores from weak labels.

Heuristic labellers look at every text and vote good (g), bad (b) or not at all (-). Nobody says how good the
labellers are: expectation-maximisation estimates each one's rates of votes among good and among bad documents,
from how their votes agree, and with them the probability that a document with given votes is good. Those
posteriors are the soft labels that a linear scorer over hashed word shapes and words is fitted to; the scorer
then reads every text.

The estimation needs only how often each combination of votes occurs: at most
3 ** (number of labellers) rows, counted over all documents. The scorer is fitted on a bounded sample (``sample``
documents in the order of a hash of id and text). Scoring is one pass with no shuffle.

Null and empty texts, like all of fewer than five words, get no vote; they are scored like any other text. Rows
that repeat a document are scored each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import pieces, text_or_empty

BITS = 18  #: hashed features share 2 ** BITS weights
SAMPLE = 6000  #: documents that the scorer is fitted on, at most
EM_ROUNDS = 200
#: what the rates of votes are drawn to, by DRAWN times the class's own weight: against good documents; against those of the labeller's kind
FALSE_ALARM, FOUND, DRAWN = 0.005, 0.9, 0.1
ROUNDS = 150  #: gradient steps of the scorer
L2 = 1e-3
CACHED_WORDS = 500_000  #: words whose features a worker remembers
SCHEMA = "doc_id long, votes string, posterior double, score double, keep int"


#: characters whose share the labellers look at, as UTF-8 bytes
SYMBOLS, CAPITALS = b"#$%&*@^~<>{}[]\\", bytes(range(65, 91))
LABELLERS = ("symbols", "capitals", "shouting", "tables", "sentences", "word_length", "repeated_words", "repeated_lines")


def labels(text: str) -> str:
    """One letter for each of LABELLERS: g (good), b (bad) or - (none)."""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n, n_words = len(raw), len(words)
    if n_words < 5:
        return "-" * len(LABELLERS)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    share = lambda chars: (n - len(raw.translate(None, chars))) / n
    stops = (raw.count(b".") + raw.count(b"?") + raw.count(b"!")) / n_words
    mean = len(text) / n_words
    many = n_words >= 30
    return "".join(
        (
            "b" if share(SYMBOLS) > 0.06 else "-",
            "b" if share(CAPITALS) > 0.25 else "-",
            "b" if raw.count(b"!") / n_words > 0.3 else "-",
            "b" if raw.count(b"|") / n_words > 0.15 else "-",
            "-" if not many else "b" if stops < 0.015 or stops > 0.5 else "g" if 0.03 < stops < 0.3 else "-",
            "b" if mean > 7.6 or mean < 4.0 else "-",
            "b" if many and len(set(words)) < 0.25 * n_words else "-",
            "b" if len(lines) >= 4 and len(set(lines)) < 0.6 * len(lines) else "-",
        )
    )


def estimate(votes: list[str], counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over combinations of votes that occur ``counts`` times each.

    Labellers look for different defects, so bad documents are of as many kinds as there are labellers: class 0 is
    good, class j + 1 starts as what labeller j votes against. Returns the posterior of good by combination, the
    classes' shares, and rates[class, labeller, vote] (votes in the order b, -, g), which hold the labellers'
    accuracies. Votes of one labeller alone do not tell many bad documents of which it finds few from few of which it
    finds most, or from false alarms; so its rates of votes against good documents and its own kind are drawn a
    little to FALSE_ALARM and FOUND.
    """
    coded = np.array([["b-g".index(c) for c in v] for v in votes], int).reshape(len(votes), len(votes[0]) if votes else len(LABELLERS))
    m = coded.shape[1]
    against = coded == 0
    some = against.any(1, keepdims=True)
    resp = np.hstack([np.where(some, 0.1, 0.9), np.where(some, 0.9 * against / np.maximum(against.sum(1, keepdims=True), 1), 0.1 / max(m, 1))])
    shares, rates = np.full(m + 1, 1 / (m + 1)), np.full((m + 1, m, 3), 1 / 3)
    for _ in range(rounds):
        weight = counts[:, None] * resp
        shares = (weight.sum(0) + 1) / (counts.sum() + m + 1)
        logs = np.log(shares)[None, :].repeat(len(votes), 0)
        for j in range(m):
            r = np.stack([np.bincount(coded[:, j], weight[:, c], 3) for c in range(m + 1)]) + 0.1
            r /= r.sum(1, keepdims=True)
            for c, aim in ((0, FALSE_ALARM), (j + 1, FOUND)):
                drawn = (r[c, 0] + DRAWN * aim) / (1 + DRAWN)
                r[c, 1:] *= (1 - drawn) / (1 - r[c, 0])
                r[c, 0] = drawn
            rates[:, j] = r
            logs += np.log(r)[:, coded[:, j]].T
        new = np.exp(logs - logs.max(1, keepdims=True, initial=-np.inf))
        new /= new.sum(1, keepdims=True)
        done = np.abs(new - resp).max(initial=0) < 1e-9
        resp = new
        if done:
            break
    return resp[:, 0], shares, rates


def shape(word: str) -> str:
    """Runs of capitals, letters and digits as one A, a or 0 each; other characters as they are, runs as one."""
    out, last = [], ""
    for ch in word:
        c = "A" if ch.isupper() else "a" if ch.isalpha() else "0" if ch.isdigit() else ch
        if c != last:
            out.append(c)
            last = c
    return "".join(out)


def _slot(feature: str, bits: int) -> int:
    return crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


@lru_cache(maxsize=1)
def _known(bits: int) -> dict:
    return {}


def features(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values): shares of word shapes and word lengths, and how much words and lines repeat, binned."""
    known = _known(bits)
    words = text.split()
    n = len(words)
    counts: dict[int, float] = {}
    for w in words:
        s = known.get(w)
        if s is None:
            s = _slot("s:" + shape(w), bits), _slot(f"l:{min(len(w), 24) // 2}", bits)
            if len(known) < CACHED_WORDS:
                known[w] = s
        a, b = s
        counts[a] = counts.get(a, 0) + 1
        counts[b] = counts.get(b, 0) + 1
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    slots = list(counts)
    values = [np.sqrt(c / n) for c in counts.values()]
    for name, part, whole in (("w", len(set(words)), n), ("x", len(set(lines)), len(lines))):
        slots.append(_slot(f"{name}:{int(10 * part / whole) if whole else -1}:{min(whole.bit_length(), 9)}", bits))
        values.append(1.0)
        slots.append(_slot(f"{name}:{int(10 * part / whole) if whole else -1}", bits))
        values.append(1.0)
    return np.array(slots, np.int64), np.array(values)


def fit(bags: list[tuple[float, np.ndarray, np.ndarray]], bits: int = BITS, rounds: int = ROUNDS, l2: float = L2) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels; (weights, bias)."""
    w, b = np.zeros(1 << bits), 0.0
    if not bags:
        return w, b
    y = np.array([x[0] for x in bags])
    used, at = np.unique(np.concatenate([x[1] for x in bags]), return_inverse=True)
    values, doc = np.concatenate([x[2] for x in bags]), np.repeat(np.arange(len(bags)), [len(x[1]) for x in bags])
    u = np.zeros(len(used))
    m, v, mb, vb = np.zeros_like(u), np.zeros_like(u), 0.0, 0.0
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, u[at] * values, len(y)) + b, -30, 30)))
        gz = (p - y) / len(y)
        g, gb = np.bincount(at, gz[doc] * values, len(used)) + l2 * u, gz.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        u -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        b -= 0.1 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-6)
    w[used] = u
    return w, float(b)


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in pieces(batches):
        yield pd.DataFrame({"votes": [labels(t) for t in pdf["text"]]})


def _bags(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches):
            made = [features(t, bits) for t in pdf["text"]]
            yield pd.DataFrame(
                {
                    "key": pdf["key"],
                    "votes": [labels(t) for t in pdf["text"]],
                    "slots": [s.astype("<i4").tobytes() for s, _ in made],
                    "vals": [v.astype("<f4").tobytes() for _, v in made],
                }
            )

    return run


def _score(model, bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        posterior, slots, values, bias = model.value
        weights = np.zeros(1 << bits)
        weights[slots] = values
        for pdf in pieces(batches):
            votes = [labels(t) for t in pdf["text"]]
            z = []
            for t in pdf["text"]:
                s, v = features(t, bits)
                z.append(float(weights[s] @ v) + bias)
            score = 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "votes": votes, "posterior": [posterior[x] for x in votes], "score": score, "keep": (score >= 0.5).astype("int32")})

    return run


def quality(docs: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """votes, posterior of the weak labels, score of the fitted scorer, and keep (score >= 0.5), for every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    seen = docs.select("text").mapInPandas(_votes, "votes string").groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()  # 3 ** 8 rows at most
    votes = [r["votes"] for r in seen]
    post, _, _ = estimate(votes, np.array([r["n"] for r in seen], float))
    posterior = dict(zip(votes, post.tolist()))
    key = F.xxhash64("doc_id", "text").alias("key")
    drawn = docs.select(key).distinct().orderBy("key").limit(sample)  # hashes only
    bags = docs.select(key, "text").join(F.broadcast(drawn), "key").dropDuplicates(["key"]).mapInPandas(_bags(bits), "key long, votes string, slots binary, vals binary").orderBy("key").collect()
    weights, bias = fit([(posterior[r["votes"]], np.frombuffer(r["slots"], "<i4"), np.frombuffer(r["vals"], "<f4")) for r in bags], bits)
    slots = np.nonzero(weights)[0]
    sent = spark.sparkContext.broadcast((posterior, slots, weights[slots], bias))  # bounded by 3 ** 8 and 2 ** bits
    return docs.mapInPandas(_score(sent, bits), SCHEMA)
