"""Toxicity of documents by multiple-instance learning.

A document is a bag of sentences and its label says only whether some sentence is toxic. A sentence's score is
a logistic function of its hashed words; the document's is the noisy-or of its sentences', one minus the product
of (1 - score). The weights are fitted to document labels through that formula, so the sentence scores that
come with it say where the offending sentence is.

The fit uses a bounded sample of labelled documents (``sample``, in the order of a hash of the id, both classes
by their own share) outside the held-out fold, in one task that gets hashed words of those; the driver is sent the
weights alone. Scoring reads every whole text once, with no shuffle.

Null and empty texts have no sentence and score 0. Null labels are not learned from. Rows that repeat a document
are scored each; where a document has several labels, it is toxic if one of them says so. With no usable label
of either class every score is 0. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import materialize, pieces, release, text_or_empty

BITS = 20  #: hashed words share 2 ** BITS weights
SAMPLE = 8000  #: labelled documents that are learned from, at most
MIN_DOCS = 3  #: documents of the sample that must hold a hashed word for it to get a weight
ROUNDS = 150  #: gradient steps over the sample
CHUNK = 250  #: documents of the sample that a gradient step looks at at once
L1 = 1.5  #: evidence, in documents, that a weight must have to leave 0
PREFIXES = (4, 5)
FOLDS = 5  #: documents whose crc32 modulo FOLDS is 0 are held out
CACHED_WORDS = 150_000  #: words whose weight a task remembers

SENTENCES = re.compile(r"[^.!?\n]+")
SCORES = "doc_id long, held_out boolean, score double, predicted int, n_sentences long, worst_start long, worst_end long, worst_score double"


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each run between sentence ends and line feeds that holds a word."""
    return [m.span() for m in SENTENCES.finditer(text) if not m.group().isspace()]


def words(sentence: str) -> list[str]:
    """Distinct lower-case words, without the punctuation around them."""
    return [w.strip(STRIPPED) for w in set(sentence.lower().split())]


STRIPPED = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def slot(word: str, bits: int = BITS) -> int:
    return crc32(word.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


def slots_of(word: str, bits: int = BITS) -> list[int]:
    """Slots of a word and, as inflected and invented words share them, of its beginnings."""
    if not word:
        return []
    return [slot(word, bits), *[slot("^" + word[:n], bits) for n in PREFIXES if len(word) > n]]


def _features(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches):
            out = []
            for key, y, text in zip(pdf["key"], pdf["y"], pdf["text"]):
                slots, sizes = [], []
                for a, b in sentences(text):
                    own = sorted(s for w in words(text[a:b]) for s in slots_of(w, bits))
                    if own:
                        slots += own
                        sizes.append(len(own))
                out.append((key, int(y), np.array(slots, "<i4").tobytes(), np.array(sizes, "<i4").tobytes()))
            yield pd.DataFrame(out, columns=["key", "y", "slots", "sizes"])

    return run


def fit(bags: Iterable[tuple[int, np.ndarray, np.ndarray]], bits: int = BITS, rounds: int = ROUNDS, l1: float = L1, min_docs: int = MIN_DOCS) -> tuple[np.ndarray, float]:
    """Weights by slot and the bias, from (label, slots of all sentences, number of slots of each sentence)."""
    weights = np.zeros(1 << bits)
    bags = [b for b in bags if len(b[2])]
    y = np.array([b[0] for b in bags], float)
    if not len(y) or y.min() == y.max():
        return weights, -50.0
    # words that stand in at least min_docs documents get a weight
    df = np.zeros(1 << bits, np.int32)
    for b in bags:
        df[np.unique(b[1])] += 1
    used = np.nonzero(df >= min_docs)[0]
    place = np.full(1 << bits, -1, np.int32)
    place[used] = np.arange(len(used))
    # chunks of documents, so that a step needs little memory beside the sample; a document is let go once it is in its chunk
    chunks, sentences_seen = [], 0
    for a in range(0, len(bags), CHUNK):
        part = bags[a : a + CHUNK]
        bags[a : a + CHUNK] = [None] * len(part)
        at = place[np.concatenate([b[1] for b in part])]
        sizes = np.concatenate([b[2] for b in part])
        kept = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[at >= 0], minlength=len(sizes))
        of_doc = np.repeat(np.arange(len(part), dtype=np.int32), [len(b[2]) for b in part])
        chunks.append((at[at >= 0], kept.astype(np.int32), of_doc, y[a : a + CHUNK]))
        sentences_seen += len(sizes)
    w, bias = np.zeros(len(used)), np.log(max(y.mean(), 1e-6) / max(sentences_seen / len(y), 1.0))
    # between the classes' own shares and even ones
    share_1, share_0 = np.sqrt(0.5 * len(y) / y.sum()), np.sqrt(0.5 * len(y) / (1 - y).sum())
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):
        g, gb = np.zeros(len(used)), 0.0
        for at, kept, of_doc, labels in chunks:
            of_sentence = np.repeat(np.arange(len(kept), dtype=np.int32), kept)
            z = np.bincount(of_sentence, w[at], len(of_doc)) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            clean = np.exp(np.bincount(of_doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(labels)))
            pull = np.where(labels > 0, -clean / np.maximum(1 - clean, 1e-9) * share_1, share_0)
            gz = pull[of_doc] * p
            g += np.bincount(at, gz[of_sentence], len(used))
            gb += gz.sum()
        g, gb = g / len(y), gb / len(y)
        g = np.where(w != 0, g + l1 / len(y) * np.sign(w), np.sign(g) * np.maximum(np.abs(g) - l1 / len(y), 0))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.15 if step < 0.7 * rounds else 0.05
        before = w
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
        w[w * before < 0] = 0
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-5)
    weights[used] = w
    return weights, float(bias)


def _fit(bits: int):
    """The model, as a row: slots with a weight, their weights, the bias."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bags = [(y, np.frombuffer(slots, "<i4"), np.frombuffer(sizes, "<i4")) for pdf in batches for y, slots, sizes in zip(pdf["y"], pdf["slots"], pdf["sizes"])]
        if bags:
            weights, bias = fit(bags, bits)
            slots = np.nonzero(np.abs(weights) > 1e-3)[0]
            yield pd.DataFrame({"slots": [slots.astype("<i8").tobytes()], "weights": [weights[slots].astype("<f8").tobytes()], "bias": [bias]})
        bags = None
        release()

    return run


def _scorer(model: tuple, bits: int):
    """A function from a text to (score, sentence spans, sentence scores)."""
    slots, values, bias = model
    table = dict(zip(slots.tolist(), values.tolist()))
    known: dict[str, float] = {}

    def score(text: str) -> tuple[float, list[tuple[int, int]], np.ndarray]:
        spans = sentences(text)
        z = []
        for a, b in spans:
            total = bias
            for raw in set(text[a:b].lower().split()):
                w = known.get(raw)
                if w is None:
                    word = raw.strip(STRIPPED)
                    w = sum(table.get(s, 0.0) for s in slots_of(word, bits))
                    if len(known) < CACHED_WORDS:
                        known[raw] = w
                total += w
            z.append(total)
        if not z:
            return 0.0, spans, np.empty(0)
        p = 1 / (1 + np.exp(-np.clip(np.array(z), -40, 40)))
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), spans, p

    return score


def _score(model, bits: int, folds: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score_of = _scorer(model.value, bits)
        for pdf in pieces(batches):
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                held = None
                if not pd.isna(doc_id):
                    doc_id = int(doc_id)
                    held = crc32(str(doc_id).encode()) % folds == 0
                score, spans, p = score_of(text)
                if spans:
                    worst = int(p.argmax())
                    out.append((doc_id, held, score, int(score >= 0.5), len(p), *spans[worst], float(p[worst])))
                else:
                    out.append((doc_id, held, 0.0, 0, 0, None, None, None))
            pdf = pd.DataFrame(out, columns=[c.split()[0] for c in SCORES.split(", ")])
            yield pdf.astype({"doc_id": "Int64", "held_out": "boolean", "worst_start": "Int64", "worst_end": "Int64"})

    return run


def _keep_clean(model, bits: int):
    def run(batches):
        import pyarrow as pa

        score_of = _scorer(model.value, bits)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([score_of(t.as_py() or "")[0] < 0.5 for t in texts], pa.bool_()))
        score_of = None
        release()

    return run


def _sent(docs: DataFrame, labels: DataFrame, sample: int, bits: int, folds: int):
    return docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample, bits, folds))  # as many weights as 2 ** bits at most


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS, folds: int = FOLDS) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots with a weight, their weights, bias) learned outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("key"), F.col("toxic").cast("int").alias("y")).where("key is not null and y in (0, 1)")
    known = known.where(F.crc32(F.col("key").cast("string").cast("binary")) % folds != 0).groupBy("key").agg(F.max("y").alias("y"))
    # at most half of the sample is of either class; ids and labels only
    drawn = [known.where(F.col("y") == c).orderBy(F.xxhash64(F.lit(5), "key"), "key").limit(sample // 2) for c in (0, 1)]
    drawn = drawn[0].unionByName(drawn[1])
    bags = (
        docs.select(F.col("doc_id").cast("long").alias("key"), text_or_empty().alias("text"))
        .join(F.broadcast(drawn), "key")  # ``sample`` rows at most
        .dropDuplicates(["key"])
        .mapInPandas(_features(bits), "key long, y int, slots binary, sizes binary")
    )
    # ``sample`` rows in order of the id, in one task
    bags = materialize(bags, "toxicity-sample").repartition(1).sortWithinPartitions("key")
    model = bags.mapInPandas(_fit(bits), "slots binary, weights binary, bias double").collect()  # a row
    if not model:
        return np.empty(0, np.int64), np.empty(0), -50.0
    return np.frombuffer(model[0]["slots"], "<i8"), np.frombuffer(model[0]["weights"], "<f8"), model[0]["bias"]


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS, folds: int = FOLDS) -> DataFrame:
    """A score for every row of ``docs``, and the span of its worst sentence in code points."""
    sent = _sent(docs, labels, sample, bits, folds)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(_score(sent, bits, folds), SCORES)


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS, folds: int = FOLDS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is less than 0.5."""
    sent = _sent(docs, labels, sample, bits, folds)
    return docs.mapInArrow(_keep_clean(sent, bits), docs.schema)
