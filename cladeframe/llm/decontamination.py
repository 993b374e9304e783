"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A benchmark item of m characters matches a region of a document if at most k = RATE * m edits turn
one into the other. By the q-gram lemma such a region shares at least m - q + 1 - k * q q-grams with
the item, on diagonals that differ by k at most on either side. So the q-grams that a document
shares with each item are counted in diagonal bands 2 k + 1 wide, overlapping as every two
neighbours are taken together, and pairs of bands that meet the bound are kept. Each is verified by
an alignment restricted to its diagonals, which finds the region with the fewest edits.

Texts are compared with letters in lower case and each white space as a blank, character by
character, so positions are code points of the text itself. The items are a stated query set: they
are taken in blocks of at most BLOCK characters, each run against all rows; a text of any length is
cut into overlapping pieces in which every possible match is whole. Shared q-grams are counted in
slices along the text, and bands that the text has left behind are settled at once, so repeated
q-grams (rulers, indents) take time but no memory. Items of fewer than Q characters allow no edit;
they are found by a hash of all their characters.

Defined results: a null text matches nothing; a null item, or one without any character but white
space, has no matches. Repeated rows and repeated items each get their own matches. An empty benchmark
marks nothing. Only doc_id and text (and item_id and text) are read, so other columns can't clash.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Length of a q-gram, and share of edits.
Q, RATE = 8, 0.08
#: Characters of items in a block, of texts handled at once, and shared q-grams counted at once.
BLOCK, PIECE, SLICE = 4_000_000, 1 << 20, 1 << 20
#: Bands that share an alignment at most.
MERGED = 4
PRIME, SPREAD, BITS = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 22
SPANS = "array<struct<item_id:long,start:int,end:int,edits:int>>"


def plain_table() -> np.ndarray:
    """Lower case of each code point that has one of one character; white space becomes a blank."""
    table = np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        low = chr(c).lower()
        if chr(c).isspace():
            table[c] = 32
        elif len(low) == 1 and ord(low) < 1 << 16:
            table[c] = ord(low)
    return table


PLAIN = plain_table()


def codes(text: str) -> np.ndarray:
    """Code points of a text, made plain; as many as it has characters."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(c < 1 << 16, PLAIN[np.minimum(c, (1 << 16) - 1)], c)


def gram_hashes(c: np.ndarray) -> np.ndarray:
    """A hash of the q-gram at each position, by doubling."""
    h, p, size = c.astype(np.uint64), PRIME, 1
    while size < Q:
        h = h[:-size] * np.uint64(p) + h[size:]
        p, size = p * p % (1 << 64), size * 2
    return h


def window_hashes(c: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size characters at each position."""
    h = np.zeros(max(0, len(c) - size + 1), np.uint64)
    for j in range(size if len(h) else 0):
        h = h * np.uint64(PRIME) + c[j : j + len(h)].astype(np.uint64)
    return h


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        known = [(i, c) for i, t in items if ((c := codes(t)) != 32).any()]
        self.ids = [i for i, _ in known]
        self.codes = [c for _, c in known]
        m = np.array([len(c) for c in self.codes], np.int64)
        # an item too short for its share of edits is allowed as many as the lemma can bound
        self.edits = np.maximum(0, np.minimum((m * RATE).astype(np.int64), (m - Q) // Q))
        self.bound = m - Q + 1 - self.edits * Q
        self.width = 2 * self.edits + 1
        self.length = m
        long = np.flatnonzero(m >= Q)
        self.least = int(self.bound[long].min()) if len(long) else 0
        h = [gram_hashes(self.codes[k]) for k in long]
        grams = np.concatenate([np.empty(0, np.uint64), *h])
        item = np.repeat(long, [len(x) for x in h])
        place = np.concatenate([np.empty(0, np.int64), *[np.arange(len(x)) for x in h]])
        order = np.argsort(grams, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, self.first, self.count = np.unique(grams[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << BITS, bool)
        self.filter[self.slot(self.grams)] = True
        self.overlap = int((m + 4 * self.width).max(initial=0)) + Q
        #: hashes and numbers of the items shorter than Q, by length
        self.short: dict[int, dict[int, list[int]]] = {}
        for k in np.flatnonzero(m < Q).tolist():
            self.short.setdefault(len(self.codes[k]), {}).setdefault(int(window_hashes(self.codes[k], len(self.codes[k]))[0]), []).append(k)

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(SPREAD)) >> np.uint64(64 - BITS)

    def whole(self, c: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Matches (item, start, end, 0) of the items shorter than Q."""
        out = []
        for size, known in self.short.items():
            h = window_hashes(c, size)
            for at in np.flatnonzero(np.isin(h, np.array(list(known), np.uint64))).tolist():
                out += [(k, at, at + size, 0) for k in known[int(h[at])] if np.array_equal(self.codes[k], c[at : at + size])]
        return out

    def candidates(self, c: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first band, last band): runs of bands each of which, with the next, meets the item's bound."""
        if len(c) < Q or not len(self.grams):
            return []
        h = gram_hashes(c)
        at = np.flatnonzero(self.filter[self.slot(h)])
        k = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        same = self.grams[k] == h[at]
        at, k = at[same], k[same]
        if len(at) < self.least:
            return []
        ends = np.cumsum(self.count[k])
        found, start = [], 0
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        while start < len(at):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, "right")))
            n = self.count[k[start:stop]]
            occurrence = np.repeat(self.first[k[start:stop]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            item = self.item[occurrence]
            diagonal = np.repeat(at[start:stop], n) - self.place[occurrence]
            here = item.astype(np.int64) * (1 << 40) + np.floor_divide(diagonal, self.width[item]) + (1 << 20)
            more, n = np.unique(here, return_counts=True)
            keys, where = np.unique(np.concatenate([keys, more]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n])).astype(np.int64)
            item = keys >> 40
            over = np.ones(len(keys), bool)
            if stop < len(at):  # what comes lies on this diagonal or later ones; a band needs the next to be complete
                over = ((keys & ((1 << 40) - 1)) - (1 << 20) + 2) * self.width[item] <= at[stop] - (self.length[item] - Q)
            after = np.zeros_like(counts)
            after[:-1] = np.where(keys[1:] == keys[:-1] + 1, counts[1:], 0)
            found.append(keys[over & (counts + after >= self.bound[item])])
            keys, counts, start = keys[~over], counts[~over], stop
        runs: list[tuple[int, int, int]] = []
        for x in np.sort(np.concatenate(found)).tolist():
            item, band = x >> 40, (x & ((1 << 40) - 1)) - (1 << 20)
            if runs and runs[-1][0] == item and runs[-1][2] >= band and runs[-1][2] - runs[-1][1] < MERGED:
                runs[-1] = (item, runs[-1][1], band + 1)
            else:
                runs.append((item, band, band + 1))
        return runs


def align(p: np.ndarray, t: np.ndarray, low: int, high: int, free: bool) -> tuple[int, int]:
    """Fewest edits of p against t on diagonals low to high, and the end in t.

    With free, p may start on any of the diagonals; else it starts on diagonal 0.
    """
    d = np.arange(low, high + 1)
    far = len(p) + len(t) + 1
    cost = np.zeros(len(d), np.int64) if free else np.where(d >= 0, d, far)
    padded = np.concatenate([np.zeros(max(0, -low) + 1, t.dtype), t, np.zeros(max(0, high + len(p) - len(t)) + 1, t.dtype)])
    base = max(0, -low) + 1 + low
    for i, c in enumerate(p.tolist()):
        row = cost + (padded[base + i : base + i + len(d)] != c)
        row[:-1] = np.minimum(row[:-1], cost[1:] + 1)
        cost = np.minimum.accumulate(row - d) + d
    k = int(cost.argmin())
    return int(cost[k]), len(p) + int(d[k])


def verified(index: Index, c: np.ndarray, item: int, first: int, last: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best match of an item whose diagonals lie between first and last."""
    p, k = index.codes[item], int(index.edits[item])
    low, high = max(first - k, -k), min(last + k, len(c) - len(p) + k)
    if high < low:
        return None
    start = max(0, low)
    t = c[start : max(0, high) + len(p) + 1]
    at = t.tobytes().find(p.tobytes())
    if at >= 0 and at % 4 == 0:
        return start + at // 4, start + at // 4 + len(p), 0
    edits, end = align(p, t, low - start, high - start, True)
    if edits > k or not 0 < end <= len(t):
        return None
    # the start: the same alignment backwards from the end
    _, size = align(p[::-1], t[:end][::-1], -k, k, False)
    return start + max(0, end - size), start + end, edits


def best(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of overlapping matches (item, start, end, edits) of an item, that with the fewest edits."""
    out: list[tuple[int, int, int, int]] = []
    taken: dict[int, tuple[list[int], list[int]]] = {}
    for x in sorted(set(found), key=lambda x: (x[3], x[1], x[2])):
        starts, ends = taken.setdefault(x[0], ([], []))
        at = bisect.bisect_left(starts, x[2])  # of those that start before its end, the last reaches furthest
        if not at or ends[at - 1] <= x[1]:
            starts.insert(at, x[1])
            ends.insert(at, x[2])
            out.append(x)
    return sorted(out)


def matches(index: Index, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
    """Matches (item, start, end, edits) of each text."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    pieces: list[tuple[int, int, np.ndarray]] = []
    size, gap = 0, np.zeros(Q, np.uint32)

    def run() -> None:
        if not pieces:
            return
        starts = np.cumsum([0] + [len(c) + Q for _, _, c in pieces])
        whole = np.concatenate([x for _, _, c in pieces for x in (c, gap)])
        for item, low, high in index.candidates(whole):
            # a band may touch two texts: every text that one of its diagonals runs through is tried
            w = int(index.width[item])
            first = max(0, int(np.searchsorted(starts, max(0, low * w), "right")) - 1)
            last = int(np.searchsorted(starts, (high + 1) * w + int(index.length[item]), "right"))
            for n in range(first, min(last, len(pieces))):
                row, offset, c = pieces[n]
                at = int(starts[n])
                # the same diagonals, counted from this text's start
                found = verified(index, c, item, low * w - at, (high + 1) * w - 1 - at)
                if found:
                    out[row].append((item, found[0] + offset, found[1] + offset, found[2]))
        pieces.clear()

    for row, text in enumerate(texts):
        if not text:
            continue
        c = codes(text)
        for offset in range(0, max(1, len(c) - index.overlap), PIECE):
            piece = c[offset : offset + PIECE + index.overlap]
            out[row] += [(k, s + offset, e + offset, n) for k, s, e, n in index.whole(piece)]
            pieces.append((row, offset, piece))
            size += len(piece)
            if size > PIECE:
                run()
                size = 0
    run()
    return [best(x) for x in out]


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of the items, in blocks of at most BLOCK characters."""
    held: list[tuple[int, str]] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("i"), "text").where("text is not null").orderBy("i", "text").toLocalIterator():
        held.append((r.i, r.text))
        size += len(r.text)
        if size > BLOCK:
            yield Index(held)
            held, size = [], 0
    if held:
        yield Index(held)


def matcher(index: Index):
    """A UDF that matches texts against one block of items."""

    @F.pandas_udf(SPANS)
    def one(texts: pd.Series) -> pd.Series:
        rows = matches(index, texts.tolist())
        return pd.Series([[{"item_id": index.ids[i], "start": s, "end": e, "edits": n} for i, s, e, n in x] for x in rows])

    # the optimizer would run a deterministic one twice: once to leave out texts without matches before they are exploded
    return one.asNondeterministic()


def spans(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> Column:
    """A column with the matches of each text against the whole benchmark."""
    small_batches(docs.sparkSession)
    found = []
    for index in blocks(benchmark):
        found.append(matcher(index)(F.col(text)))
    return F.concat(*found) if len(found) > 1 else found[0] if found else F.array().cast(SPANS)


def apply(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each match: the columns named in keep, item_id, start, end and edits."""
    out = docs.select(*keep, spans(docs, benchmark).alias("__spans"))
    return out.select(*keep, F.explode("__spans").alias("__s")).select(*keep, "__s.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any match."""
    return docs.select("*", spans(docs, benchmark).alias("__spans")).where(F.size("__spans") == 0).select(*docs.columns)
