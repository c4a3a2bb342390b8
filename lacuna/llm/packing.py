"""Packing of tokenised documents into sequences of a fixed length.

Every document becomes its token ids and an end id. Full sequences are cut off its front; the rest, shorter
than a sequence, is packed first-fit decreasing inside randomised groups of documents, with a tournament tree
over the bins' capacities. Gaps that first-fit leaves are then closed by cutting what lies in the emptiest bins,
so a group has one sequence at most that isn't full, and that one is dealt out at powers of two, which need no
padding.

Null text is an empty document (the end id alone). Rows that repeat a document are packed each for itself. Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import pieces, release, text_or_empty

LENGTH = 2048  #: tokens in a sequence
GROUP_DOCS = 2048  #: mean number of documents in a group; a row of a group has LENGTH tokens at most
CACHED_WORDS = 200_000  #: words, and as many parts of words, whose ids a task remembers
RECENT_WORDS = 20_000  #: and, beyond these, the latest
END_ID = 1

TOKENS_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, group long"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Remembered(dict):
    """Values of ``make`` by argument: the first CACHED_WORDS for good, of later ones the latest, up to RECENT_WORDS."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make
        self.recent: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.recent.get(key)
        if value is None:
            value = self.make(key)
            if len(self) < CACHED_WORDS:
                self[key] = value
            else:
                if len(self.recent) >= RECENT_WORDS:
                    self.recent.clear()
                self.recent[key] = value
        return value


def part_ids(model, letters: list[str], part: str) -> bytes:
    """Ids of one match of the tokenizer's pattern."""
    mapped = part if part.isascii() and part.isprintable() else "".join([letters[b] for b in part.encode()])
    t = [x.id for x in model.tokenize(mapped)]
    return struct.pack(f"<{len(t)}I", *t)


def word_ids(find: Callable[[str], list[str]], parts: Remembered, word: str) -> bytes:
    if word.isascii() and word.isalpha():
        return parts[word]  # one match
    return b"".join(map(parts.__getitem__, find(word)))


class WordTokenizer:
    """Ids of a text by a byte-level BPE tokenizer that lower-cases and splits by a pattern, words remembered.

    No token of such a tokenizer reaches across a space or a line feed, so a text's ids are those of its
    space-separated words in order, and a word's ids those of the pattern's matches in it. Both are remembered,
    the frequent ones being met first; texts with anything unusual (the tokenizer's
    special strings, letters whose lower case depends on their place, characters outside the scripts for which a test
    holds both ways equal) go to the tokenizer whole.
    """

    # fixed values: the tokenizer's own pattern, white space spelled out (regex would count U+001C to U+001F as such)
    SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACE + r"\p{L}\p{N}]+"

    #: Latin, Greek and Cyrillic with their extensions, general punctuation, currencies, kana, common ideographs, Hangul
    UNUSUAL = r"<\||\u03a3|[^\x00-\u052f\u1e00-\u1fff\u2000-\u206f\u20a0-\u20bf\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3]"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.find = regex.compile(self.PATTERN).findall
        self.unusual = regex.compile(self.UNUSUAL).search
        self.letters = byte_letters()
        self.words = Remembered(partial(word_ids, self.find, Remembered(partial(part_ids, self.model, self.letters))))

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = []
        for text in texts:
            if "<|" in text if text.isascii() else self.unusual(text):
                out.append(self.plain(text))
                continue
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
            out.append(b"".join(map(self.words.__getitem__, text.lower().replace("\n", " ").split(" "))))
        return out


def crc(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF


def _tokens(path: str, length: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = WordTokenizer(path)
        for pdf in pieces(batches):
            out = []
            for doc_id, group, ids in zip(pdf["doc_id"], pdf["group"], tok.encode(pdf["text"].tolist())):
                ids += end
                n = len(ids) // 4
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                for at in range(0, n, length):
                    part = ids[4 * at : 4 * (at + length)]
                    m = len(part) // 4
                    out.append((doc_id, at, m, crc(part), n, None if m == length else part, group))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "group"]).astype({"doc_id": "Int64"})

    return run


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: each item, largest first, goes to the first bin that has room.

    A tournament tree holds the largest free capacity below each node; the leftmost winner that fits is found
    on one path from the root.
    """
    if not sizes:
        return []
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    bins: list[list[int]] = [[] for _ in sizes]
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s, node = sizes[i], 1
        while node < leaves:
            node *= 2
            if tree[node] < s:
                node += 1
        bins[node - leaves].append(i)
        free = tree[node] = tree[node] - s
        while node > 1:
            node //= 2
            left, right = tree[2 * node], tree[2 * node + 1]
            best = left if left > right else right
            if tree[node] == best:
                break
            tree[node] = best
    return [b for b in bins if b]


def close_gaps(bins: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, from, to): the emptiest bins are cut up to fill the gaps of the others, fullest first."""
    fill = lambda b: sum(t - f for _, f, t in b)
    order = sorted(bins, key=fill, reverse=True)
    sizes = [fill(b) for b in order]
    last = len(order) - 1
    for k, b in enumerate(order):
        while k < last and sizes[k] < capacity:
            item, f, t = order[last].pop()
            take = min(t - f, capacity - sizes[k])
            b.append((item, f, f + take))
            if f + take < t:
                order[last].append((item, f + take, t))
            sizes[k] += take
            sizes[last] -= take
            if not order[last]:
                last -= 1
    return [b for b in order if b]


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """One underfull bin as bins whose sizes are the powers of two that its size is the sum of."""
    total = sum(t - f for _, f, t in pieces)
    rest, out = list(pieces), []
    for bit in range(total.bit_length() - 1, -1, -1):
        room = total & (1 << bit)
        if room:
            out.append([])
        while room:
            item, f, t = rest.pop(0)
            take = min(room, t - f)
            out[-1].append((item, f, f + take))
            if f + take < t:
                rest.insert(0, (item, f + take, t))
            room -= take
    return out


def _pack(capacity: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        base = int(key[0]) << 32
        full = pdf["ids"].isna().to_numpy()
        whole = pdf.loc[full, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].copy()
        whole["sequence_id"], whole["offset"] = base + np.arange(len(whole)), 0
        rest = list(pdf.loc[~full, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]].itertuples(index=False, name=None))
        sizes = [r[2] for r in rest]
        bins = close_gaps([[(i, 0, sizes[i]) for i in b] for b in first_fit_decreasing(sizes, capacity)], capacity)
        packed = [b for b in bins if sum(t - f for _, f, t in b) == capacity]
        for b in bins:
            if sum(t - f for _, f, t in b) < capacity:
                packed += powers_of_two(b)
        out = []
        for k, b in enumerate(packed, len(whole)):
            at = 0
            for i, f, t in b:
                doc_id, start, length, total_crc, n, ids = rest[i]
                out.append((doc_id, start + f, t - f, total_crc if t - f == length else crc(ids[4 * f : 4 * t]), n, base + k, at))
                at += t - f
        return pd.concat([whole, pd.DataFrame(out, columns=whole.columns)]).astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, group_docs: int = GROUP_DOCS, end_id: int = END_ID, seed: int = 17) -> DataFrame:
    """One row per piece of a document: where it starts and which place of which sequence it takes.

    ``tokenizer_path``: a tokenizers file, present on every executor. Groups are dealt at random (by a seeded
    hash of id and text), so that no group's size follows a source's or a key's size.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    groups = max(1, -(-docs.count() // group_docs))
    # copies of a row differ in nothing; a row number in its partition would not survive a rerun, so they share a group
    docs = docs.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(groups)))
    pieces = docs.mapInPandas(_tokens(tokenizer_path, length, end_id), TOKENS_SCHEMA)
    return pieces.groupBy("group").applyInPandas(_pack(length), SCHEMA)
