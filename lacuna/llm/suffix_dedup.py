"""Removal of passages that an earlier document holds, by longest previous factors.

A position of a document is the start of a repeat if the ``length``-byte string there also starts in a document
with a smaller id: its longest previous factor, counting earlier documents only, is ``length`` or more. In suffix
order that factor is found at the previous or next suffix with a smaller position. All bytes that such strings cover
are removed; the first copy of everything stays.

Suffixes that can share a ``length``-byte prefix are brought together by anchors: the leftmost smallest hash among
the GRAM-byte strings of each window of ``length`` bytes. Equal windows have equal anchors, at the same offset.

1. Each document's anchors go, with a hash of all bytes that windows around the anchor may touch (its context), to
   the bucket of the anchor's hash. Contexts that a task sees in two documents are settled there, so a passage that
   every document holds leaves a task once. In a bucket, a context that occurs in an earlier document is settled:
   all its windows repeat. Anchors that occur with different contexts in several documents are left.
2. The bytes of those contexts, one for each different context, go to the anchor's bucket again. Their suffixes are
   sorted by prefix doubling to depth ``length``, ties by document. Common prefixes of neighbours are read from the bytes,
   previous and next suffixes with a smaller document are found, and with them the longest previous factors.
3. The spans found are joined to the documents.

Null text counts as empty. Documents shorter than ``length`` keep all. A null id counts as larger than any other,
and rows with equal ids never remove from each other, so rows that repeat an id and text get the same result. An
empty table gives an empty result. Other columns are ignored. Nothing but counts reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import PIECE, materialize, mix64, pieces, release, rolling_hash, shuffle_partitions, sliding_min, text_or_empty
from lacuna.llm.ngram_join import _Powers, pack48, unpack48

LENGTH = 50  #: bytes of a string that counts as a repeat
GRAM = 16  #: bytes that an anchor's hash covers
HOME = 4096  #: mean number of documents whose spans are put together in one task
BUCKET = 8 << 20  #: mean number of bytes of text whose anchors meet in one group
TOGETHER = 8192  #: contexts whose suffixes are sorted together
SLAB = 1 << 16  #: neighbours in suffix order that are compared at once
SEGMENT = 1 << 22  #: bytes hashed at once
LAST = (1 << 63) - 1  #: stands for a null id

_KEY = "doc long, mark long"
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def anchors(c: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, 40-bit hashes) of the anchors of all windows of ``length`` bytes, by position."""
    grams, w = len(c) - gram + 1, length - gram + 1
    low = np.uint64((1 << 24) - 1)
    pos, hashes = [], []
    for a in range(0, grams - w + 1, SEGMENT):
        b = min(grams, a + SEGMENT + w - 1)
        key = (rolling_hash(c[a : b + gram - 1], gram) & ~low) | np.arange(b - a, dtype=np.uint64)
        kept = np.unique(sliding_min(key, w))
        pos.append((kept & low).astype(np.int64) + a)
        hashes.append(kept >> np.uint64(24))
    pos, hashes = np.concatenate(pos), np.concatenate(hashes)
    pos, first = np.unique(pos, return_index=True)
    return pos, hashes[first]


def context_bounds(pos: np.ndarray, n: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the bytes that windows around an anchor may touch."""
    return np.maximum(pos - (length - gram), 0), np.minimum(pos + length, n)


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _Powers.get(len(c) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((c.astype(np.uint64) + np.uint64(1)) * up[:-1])])
        return mix64((total[end] - total[start]) * down[start] + mix64((end - start).astype(np.uint64)))


def merge_spans(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the spans of each owner (a small number), in order; touching spans are one."""
    if not len(owner):
        return owner, start, end
    wide = np.int64(1) << np.int64(40)
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    reach = np.maximum.accumulate(end + owner * wide)
    new = np.ones(len(owner), bool)
    new[1:] = start[1:] + owner[1:] * wide > reach[:-1]
    at = np.nonzero(new)[0]
    last = np.append(at[1:], len(owner)) - 1
    return owner[at], start[at], reach[last] - owner[at] * wide


def _by_owner(docs: np.ndarray, marks: np.ndarray, owner, start, end) -> pd.DataFrame:
    """A row for each owner with its merged spans as pairs of 32-bit numbers."""
    owner, start, end = merge_spans(owner.astype(np.int64), start.astype(np.int64), end.astype(np.int64))
    if not len(owner):
        return pd.DataFrame({"doc": [], "mark": [], "spans": []})
    cut = np.nonzero(np.diff(owner))[0] + 1
    who = owner[np.concatenate([[0], cut])]
    pairs = np.stack([start, end], 1).astype("<u4")
    return pd.DataFrame({"doc": docs[who], "mark": marks[who], "spans": [p.tobytes() for p in np.split(pairs, cut)]})


def to_homes(frame: pd.DataFrame, column: str, kind: int, homes: int) -> pd.DataFrame:
    """Rows (doc, mark, bytes) as one row for each home, a share of the documents that is a hash of the id."""
    if not len(frame):
        return pd.DataFrame({"home": [], "blob": []})
    docs, marks = frame["doc"].to_numpy(np.int64), frame["mark"].to_numpy(np.int64)
    data = frame[column].to_list()
    home = (mix64(docs.view(np.uint64)) % np.uint64(homes)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    names, blobs = [], []
    for s in np.split(order, np.nonzero(np.diff(home[order]))[0] + 1):
        sizes = np.array([len(data[i]) for i in s], "<u4")
        blobs.append(np.array([len(s), kind], "<u4").tobytes() + docs[s].astype("<i8").tobytes() + marks[s].astype("<i8").tobytes() + sizes.tobytes() + b"".join([data[i] for i in s]))
        names.append(int(home[s[0]]))
    return pd.DataFrame({"home": names, "blob": blobs})


def _at_home(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for each document of a home: its merged spans, and the positions that are asked for."""
    found: dict[tuple[int, int], tuple[list[bytes], list[bytes]]] = {}
    for blob in pdf["blob"]:
        n, kind = (int(x) for x in np.frombuffer(blob, "<u4", 2))
        docs, marks = np.frombuffer(blob, "<i8", n, 8), np.frombuffer(blob, "<i8", n, 8 + 8 * n)
        ends = np.cumsum(np.frombuffer(blob, "<u4", n, 8 + 16 * n).astype(np.int64)) + 8 + 20 * n
        at = 8 + 20 * n
        for doc, mark, end in zip(docs.tolist(), marks.tolist(), ends.tolist()):
            found.setdefault((doc, mark), ([], []))[kind].append(blob[at:end])
            at = end
    out = []
    for (doc, mark), (spans, asks) in found.items():
        if spans:
            pairs = np.frombuffer(b"".join(spans), "<u4").reshape(-1, 2).astype(np.int64)
            _, start, end = merge_spans(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
            spans = np.stack([start, end], 1).astype("<u4").tobytes()
        out.append((doc, mark, spans or None, b"".join(asks) or None))
    return pd.DataFrame(out, columns=["doc", "mark", "spans", "ask"])


def _emit_anchors(length: int, gram: int, buckets: int, homes: int):
    """Rows (bucket, blob) of anchors for other tasks to settle, and (home, settled) of spans settled here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches):
            docs, marks = pdf["doc"].to_numpy(np.int64), pdf["mark"].to_numpy(np.int64)
            parts = []
            for i, text in enumerate(pdf["text"]):
                c = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                if len(c) < length:
                    continue
                pos, h = anchors(c, length, gram)
                a, b = context_bounds(pos, len(c), length, gram)
                parts.append((np.full(len(pos), i), pos, h, span_hash(c, a, b) >> np.uint64(16), a, b))
            if not parts:
                continue
            row, pos, h, ctx, a, b = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((docs[row], ctx, h))
            row, pos, h, ctx, a, b = (x[order] for x in (row, pos, h, ctx, a, b))
            new = np.ones(len(row), bool)
            new[1:] = (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])
            least = docs[row[new]][np.cumsum(new) - 1]
            done = docs[row] > least
            settled = _by_owner(docs, marks, row[done], a[done], b[done])
            own = to_homes(settled, "spans", 0, homes)
            yield pd.DataFrame({"bucket": own["home"] % buckets, "blob": None, "home": own["home"], "settled": own["blob"]})
            row, pos, h, ctx = (x[~done] for x in (row, pos, h, ctx))
            place = (h % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((pos, row, place))
            row, pos, h, ctx, place = (x[order] for x in (row, pos, h, ctx, place))
            names, blobs = [], []
            for s in np.split(np.arange(len(place)), np.nonzero(np.diff(place))[0] + 1):
                if not len(s):
                    continue
                own = row[s]
                first = np.nonzero(np.diff(own, prepend=-1))[0]
                counts = np.diff(np.append(first, len(own))).astype("<u4")
                head = np.array([len(s), len(first)], "<u4").tobytes()
                blobs.append(head + docs[own[first]].astype("<i8").tobytes() + marks[own[first]].astype("<i8").tobytes() + counts.tobytes() + pos[s].astype("<u4").tobytes() + pack48(h[s]) + pack48(ctx[s]))
                names.append(int(place[s[0]]))
            yield pd.DataFrame({"bucket": names, "blob": blobs, "home": None, "settled": None}).astype({"home": "Int64"})

    return run


def read_blob(blob: bytes) -> tuple[np.ndarray, ...]:
    """doc, mark, position, hash and context of each anchor."""
    n, m = np.frombuffer(blob, "<u4", 2)
    n, m, at = int(n), int(m), 8
    docs = np.frombuffer(blob, "<i8", m, at)
    marks = np.frombuffer(blob, "<i8", m, at := at + 8 * m)
    counts = np.frombuffer(blob, "<u4", m, at := at + 8 * m)
    pos = np.frombuffer(blob, "<u4", n, at := at + 4 * m)
    at += 4 * n
    return np.repeat(docs, counts), np.repeat(marks, counts), pos, unpack48(blob[at : at + 6 * n]), unpack48(blob[at + 6 * n :])


def _settle(length: int, gram: int, homes: int):
    """For each home, spans of contexts that an earlier document holds, and positions of anchors whose contexts must be compared.

    A context that the document's ends cut short reaches less far; its end is not known here, so a span is given as
    the anchor's position and cut to the document in the last step.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        passed = pdf.loc[pdf["blob"].isna(), ["home", "settled"]]
        blobs = pdf.loc[pdf["blob"].notna(), "blob"]
        frames = [passed.set_axis(["home", "blob"], axis=1)]
        if len(blobs):
            doc, mark, pos, h, ctx = (np.concatenate(x) for x in zip(*map(read_blob, blobs)))
            order = np.lexsort((pos, mark, doc, ctx, h))
            doc, mark, pos, h, ctx = (x[order] for x in (doc, mark, pos, h, ctx))
            new_h = np.ones(len(doc), bool)
            new_h[1:] = h[1:] != h[:-1]
            new = new_h.copy()
            new[1:] |= ctx[1:] != ctx[:-1]
            group, klass = np.cumsum(new_h) - 1, np.cumsum(new) - 1
            done = doc > doc[new][klass]
            # groups with several contexts, in several documents
            several = np.bincount(group[new]) > 1
            low, high = np.minimum.reduceat(doc, np.nonzero(new_h)[0]), np.maximum.reduceat(doc, np.nonzero(new_h)[0])
            ask = ~done & (several & (low != high))[group]
            owners, who = np.unique(np.stack([doc, mark], 1), axis=0, return_inverse=True)
            who = who.ravel()
            start, end = np.maximum(pos[done].astype(np.int64) - (length - gram), 0), pos[done].astype(np.int64) + length
            frames.append(to_homes(_by_owner(owners[:, 0], owners[:, 1], who[done], start, end), "spans", 0, homes))
            if ask.any():
                at = np.lexsort((pos[ask], who[ask]))
                w, p = who[ask][at], pos[ask][at].astype("<u4")
                cut = np.nonzero(np.diff(w))[0] + 1
                first = w[np.concatenate([[0], cut])]
                asks = pd.DataFrame({"doc": owners[first, 0], "mark": owners[first, 1], "ask": [x.tobytes() for x in np.split(p, cut)]})
                frames.append(to_homes(asks, "ask", 1, homes))
        return pd.concat([f for f in frames if len(f)]) if any(len(f) for f in frames) else frames[0]

    return run


def _contexts(length: int, gram: int, buckets: int):
    """The bytes around the anchors that are asked for, to the anchor's bucket; one row for each bucket and batch."""
    width = 2 * length - gram

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches, most=PIECE // 2):
            parts = []
            for doc, mark, text, ask in zip(pdf["doc"], pdf["mark"], pdf["text"], pdf["ask"]):
                c = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                pos = np.sort(np.frombuffer(ask, "<u4")).astype(np.int64)
                padded = np.concatenate([np.zeros(length - gram, np.uint8), c, np.zeros(length, np.uint8)])
                rows = np.lib.stride_tricks.sliding_window_view(padded, width)[pos]
                h = rolling_hash(np.ascontiguousarray(rows[:, length - gram : length]).ravel(), gram)[::gram] if len(pos) else np.empty(0, np.uint64)
                a, b = context_bounds(pos, len(c), length, gram)
                parts.append((np.full(len(pos), doc), np.full(len(pos), mark), pos, pos - a, b - pos, h, rows))
            if not parts:
                continue
            doc, mark, pos, left, right, h, rows = (np.concatenate(x) for x in zip(*parts))
            place = ((h >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((pos, mark, doc, h, place))
            names, blobs = [], []
            for s in np.split(order, np.nonzero(np.diff(place[order]))[0] + 1):
                if not len(s):
                    continue
                blobs.append(
                    np.array([len(s)], "<u4").tobytes() + doc[s].astype("<i8").tobytes() + mark[s].astype("<i8").tobytes() + pos[s].astype("<u4").tobytes()
                    + left[s].astype("<u1").tobytes() + right[s].astype("<u1").tobytes() + rows[s].tobytes()
                )
                names.append(int(place[s[0]]))
            yield pd.DataFrame({"bucket": names, "blob": blobs})

    return run


def ranks(keys: np.ndarray) -> np.ndarray:
    """Each key's number among the distinct keys, in order."""
    order = np.argsort(keys)
    ordered = keys[order]
    step = np.zeros(len(keys), np.uint64)
    step[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(keys), np.uint64)
    out[order] = np.cumsum(step)
    return out


def row_ranks(rows: np.ndarray) -> np.ndarray:
    """Each row's number among the distinct rows of bytes, in order."""
    rows = np.ascontiguousarray(rows)
    order = np.argsort(rows.view(f"V{rows.shape[1]}").ravel(), kind="stable")
    step = np.zeros(len(rows), np.uint64)
    step[1:] = (rows[order[1:]] != rows[order[:-1]]).any(1)
    out = np.empty(len(rows), np.uint64)
    out[order] = np.cumsum(step)
    return out


def suffix_ranks(rows: np.ndarray, length: int) -> np.ndarray:
    """[row, start]: ranks of the suffixes of the rows in order of their first ``length`` bytes, by prefix doubling."""
    n, width = rows.shape
    depth = min(8, length)
    eight = np.lib.stride_tricks.sliding_window_view(rows, depth, 1)
    key = np.zeros(eight.shape[:2], np.uint64)
    for i in range(depth):
        key = (key << np.uint64(8)) | eight[:, :, i].astype(np.uint64)
    rank = ranks(key.ravel()).reshape(key.shape)
    while depth < length:
        step = min(depth, length - depth)
        both = (rank[:, : width - depth - step + 1] << np.uint64(32)) | rank[:, step : width - depth + 1]
        if step < depth:  # the second half overlaps the first
            both = (rank[:, : width - depth - step + 1] << np.uint64(32)) | rank[:, step : step + width - depth - step + 1]
        rank = ranks(both.ravel()).reshape(both.shape)
        depth += step
    return rank


def smaller_before(value: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the nearest place before it with a smaller value (-1: none), and the least ``common`` on the way there.

    ``common[i]`` belongs to the step from place i - 1 to i. Blocks of 2 ** j places are skipped as a whole, longest first,
    where none of their values is smaller.
    """
    n = len(value)
    least, shared = [value], [common]
    while 2 ** len(least) <= n:
        half = 2 ** (len(least) - 1)
        for levels in (least, shared):
            up = levels[-1].copy()
            up[half:] = np.minimum(up[half:], levels[-1][:-half])
            levels.append(up)
    at, way = np.arange(n) - 1, common.copy()
    for j in range(len(least) - 1, -1, -1):
        go = np.nonzero(at >= 2**j - 1)[0]
        go = go[least[j][at[go]] >= value[go]]
        way[go] = np.minimum(way[go], shared[j][at[go]])
        at[go] -= 2**j
    way[at < 0] = 0
    return at, way


def common_prefixes(strings: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the row before it, from the start."""
    n, length = strings.shape
    out = np.zeros(n, np.int32)
    for a in range(1, n, SLAB):
        b = min(n, a + SLAB)
        equal = strings[a:b] == strings[a - 1 : b - 1]
        out[a:b] = np.where(equal.all(1), length, equal.argmin(1))
    return out


def previous_factors(rank: np.ndarray, doc: np.ndarray, strings: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Longest previous factors of suffixes, cut at the depth of ``rank``; ``strings`` gives the bytes at some of them.

    A factor is the longest prefix that a suffix shares with one of a smaller document: in suffix order the previous or the
    next one with a smaller document, and what is shared is the least common prefix on the way. Only suffixes that have
    another of equal rank are put in order; for the others, whose factors are shorter than the depth, 0 is given.
    """
    order = np.lexsort((doc, rank))
    same = rank[order[1:]] == rank[order[:-1]]
    twice = np.append(same, False) | np.append(False, same) if len(order) else np.zeros(0, bool)
    order = order[twice]
    out = np.zeros(len(rank), np.int32)
    if len(order):
        common = common_prefixes(strings(order))
        value = np.unique(doc[order], return_inverse=True)[1].ravel().astype(np.int32)
        before = smaller_before(value, common)[1]
        after = smaller_before(value[::-1], np.append(common[1:], np.int32(0))[::-1])[1][::-1]
        out[order] = np.maximum(before, after)
    return out


def _compare(length: int, gram: int, homes: int):
    width = 2 * length - gram
    starts = length - gram + 1

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fields: list[list[np.ndarray]] = [[] for _ in range(6)]
        for blob in pdf["blob"]:
            n = int(np.frombuffer(blob, "<u4", 1)[0])
            at = 4
            for f, (kind, size) in zip(fields, (("<i8", 8), ("<i8", 8), ("<u4", 4), ("<u1", 1), ("<u1", 1), ("<u1", width))):
                f.append(np.frombuffer(blob, kind, n if size != width else n * width, at))
                at += n * size
        doc, mark, pos, left, right, flat = map(np.concatenate, fields)
        rows = flat.reshape(-1, width)
        frames = []
        # rows with one anchor are neighbours in order of the anchor's bytes; pieces end between anchors
        order = np.argsort(rows[:, length - gram : length].copy().view(f"V{gram}").ravel(), kind="stable")
        same = (rows[order[1:], length - gram : length] == rows[order[:-1], length - gram : length]).all(1)
        ends = np.append(np.nonzero(~same)[0] + 1, len(order))
        at = 0
        while at < len(order):
            to = ends[min(np.searchsorted(ends, at + TOGETHER), len(ends) - 1)]
            part = order[at:to]
            at = to
            # windows lie in the document: bytes from the left end to the right one
            first, last = (length - gram) - left[part].astype(np.int64), (length - gram) + right[part].astype(np.int64) - length
            found = []
            if len(part) <= 2 * TOGETHER:
                own = rows[part]
                rank = suffix_ranks(own, length)[:, :starts]
                begin = np.arange(starts)[None, :]
                r, s = np.nonzero((begin >= first[:, None]) & (begin <= last[:, None]))
                windows = np.lib.stride_tricks.sliding_window_view(own, length, 1)
                hit = previous_factors(rank[r, s], doc[part][r], lambda i, r=r, s=s, windows=windows: windows[r[i], s[i]]) >= length
                found.append((r[hit], s[hit]))
            else:
                # one anchor with very many contexts: equal windows have it at the same place, so one place after the other
                for s in range(starts):
                    r = np.nonzero((s >= first) & (s <= last))[0]
                    own = rows[part[r], s : s + length]
                    hit = previous_factors(row_ranks(own), doc[part][r], own.__getitem__) >= length
                    found.append((r[hit], np.full(int(hit.sum()), s)))
            r, s = (np.concatenate(x) for x in zip(*found))
            begin = pos[part][r].astype(np.int64) - (length - gram) + s
            owners, who = np.unique(np.stack([doc[part][r], mark[part][r]], 1), axis=0, return_inverse=True)
            frames.append(to_homes(_by_owner(owners[:, 0], owners[:, 1], who.ravel(), begin, begin + length), "spans", 0, homes))
        release()
        return pd.concat(frames)

    return run


def _apply(keep_text: bool, carry: tuple[str, ...]):
    columns = [c.split()[0] for c in SCHEMA.split(", ")] + ["spans", "kept", "kept_text"] * keep_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches):
            out = []
            for doc_id, text, spans in zip(pdf["doc_id"], pdf["text"], pdf["spans"]):
                raw = text.encode("utf-8", "surrogatepass")
                removed, merged = 0, []
                kept = raw
                if spans is not None and len(spans):
                    pairs = np.concatenate([np.frombuffer(x, "<u4").reshape(-1, 2) for x in spans]).astype(np.int64)
                    _, start, end = merge_spans(np.zeros(len(pairs), np.int64), pairs[:, 0], np.minimum(pairs[:, 1], len(raw)))
                    merged = list(zip(start.tolist(), end.tolist()))
                    left, at = [], 0
                    for a, b in merged:
                        left.append(raw[at:a])
                        removed += b - a
                        at = b
                    kept = b"".join([*left, raw[at:]])
                row = (None if pd.isna(doc_id) else int(doc_id), len(raw), removed, len(merged), hashlib.sha256(kept).hexdigest())
                out.append((*row, [list(m) for m in merged], kept, kept.decode("utf-8", "ignore")) if keep_text else row)
            frame = pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})
            for i, c in enumerate(carry):
                frame[c] = pdf[f"carry{i}"].to_numpy()
            yield frame

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``. With ``keep_text`` also spans (removed byte ranges), kept (remaining bytes) and
    kept_text (these without the bytes that are no longer part of a character).

    ``carry``: string columns of ``docs`` that the result shall have too.
    """
    spark = docs.sparkSession
    extra = [f"carry{i}" for i in range(len(carry))]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *[F.col(c).cast("string").alias(x) for c, x in zip(carry, extra)])
    # rows that repeat an id are told apart by a hash of the text; where ids are unique, none is needed
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    mark = F.xxhash64("text") if ids else F.lit(0).cast("long")
    docs = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), mark.alias("mark"), "doc_id", "text", *extra)
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    homes, buckets = max(1, -(-size["n"] // HOME)), max(shuffle_partitions(spark), -(-size["bytes"] // BUCKET))
    sent = docs.select("doc", "mark", "text").mapInPandas(_emit_anchors(length, gram, buckets, homes), "bucket long, blob binary, home long, settled binary")
    settled = sent.groupBy("bucket").applyInPandas(_settle(length, gram, homes), "home long, blob binary")
    settled = materialize(settled.groupBy("home").applyInPandas(_at_home, f"{_KEY}, spans binary, ask binary"), "repeats-settled")

    by = ("doc", "mark") if ids else ("doc",)
    first_mark = [] if ids else [F.lit(0).cast("long").alias("mark")]
    here = docs.repartition(shuffle_partitions(spark), *by)  # shuffled once, read for both joins
    asked = settled.where("ask is not null").select(*by, "ask")
    bytes_of = here.select(*by, "text").join(asked.hint("shuffle_merge"), list(by)).select("*", *first_mark).mapInPandas(_contexts(length, gram, buckets), "bucket long, blob binary")
    compared = bytes_of.groupBy("bucket").applyInPandas(_compare(length, gram, homes), "home long, blob binary")
    compared = compared.groupBy("home").applyInPandas(_at_home, f"{_KEY}, spans binary, ask binary")
    spans = settled.unionByName(compared).where("spans is not null").select(*by, "spans").groupBy(*by).agg(F.collect_list("spans").alias("spans"))
    full = here.join(spans.hint("shuffle_merge"), list(by), "left").select("doc_id", "text", "spans", *extra)
    return full.mapInPandas(_apply(keep_text, carry), SCHEMA + ", spans array<array<long>>, kept binary, kept_text string" * keep_text + "".join(f", `{c}` string" for c in carry))
