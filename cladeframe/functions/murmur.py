"""The 64-bit key of k-mers in exchanged models: the low half of the 128-bit x64 MurmurHash3 (public domain), seed 0."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import seq as S

M = (1 << 64) - 1
#: Multipliers, rotations and increments of the x64 variant.
C1, C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
LANES = ((C1, 31, C2, 27, 0x52DCE729), (C2, 33, C1, 31, 0x38495AB5))
FINAL = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def rotated(x: int, r: int) -> int:
    return (x << r | x >> (64 - r)) & M


def scrambled(k: int, lane: int) -> int:
    before, r, after, _, _ = LANES[lane]
    return rotated(k * before & M, r) * after & M


def finished(x: int) -> int:
    for c in FINAL:
        x = (x ^ x >> 33) * c & M
    return x ^ x >> 33


def hash64(text: str) -> int:
    """Unsigned 64-bit hash of a text's UTF-8 bytes."""
    data = text.encode()
    state = [0, 0]
    whole = len(data) // 16 * 16
    for at in range(0, whole, 16):
        for lane in (0, 1):
            state[lane] ^= scrambled(int.from_bytes(data[at + 8 * lane : at + 8 * lane + 8], "little"), lane)
            state[lane] = (rotated(state[lane], LANES[lane][3]) + state[1 - lane] & M) * 5 + LANES[lane][4] & M
    rest = data[whole:]
    for lane in (0, 1):
        part = rest[8 * lane : 8 * lane + 8]
        if part:
            state[lane] ^= scrambled(int.from_bytes(part, "little"), lane)
    a, b = (s ^ len(data) for s in state)
    a = a + b & M
    b = a + b & M
    a, b = finished(a), finished(b)
    return a + b & M


def vector_rotated(x: np.ndarray, r: int) -> np.ndarray:
    return x << np.uint64(r) | x >> np.uint64(64 - r)


def hashes(rows: np.ndarray) -> np.ndarray:
    """hash64 of each row of a matrix of bytes, unsigned; all rows at once."""
    n, size = rows.shape
    state = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    padded = np.zeros((n, (size + 15) // 16 * 16), np.uint8)
    padded[:, :size] = rows
    words = padded.view("<u8")

    def scramble(word: np.ndarray, lane: int) -> np.ndarray:
        before, r, after, _, _ = LANES[lane]
        return vector_rotated(word * np.uint64(before), r) * np.uint64(after)

    for at in range(size // 16):
        for lane in (0, 1):
            _, _, _, r, plus = LANES[lane]
            state[lane] = state[lane] ^ scramble(words[:, 2 * at + lane], lane)
            state[lane] = (vector_rotated(state[lane], r) + state[1 - lane]) * np.uint64(5) + np.uint64(plus)
    for lane in (0, 1):  # the rest, filled with zeros; a word of zeros changes nothing
        if size % 16:
            state[lane] = state[lane] ^ scramble(words[:, size // 16 * 2 + lane], lane)
    a, b = (s ^ np.uint64(size) for s in state)
    a = a + b
    b = a + b

    def finish(x: np.ndarray) -> np.ndarray:
        for c in FINAL:
            x = (x ^ x >> np.uint64(33)) * np.uint64(c)
        return x ^ x >> np.uint64(33)

    a, b = finish(a), finish(b)
    return a + b


def window_hashes(text: str, k: int) -> np.ndarray:
    """Hashes of all windows of k bases of a sequence."""
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) < k or not k:
        return np.empty(0, np.uint64)
    return hashes(np.lib.stride_tricks.sliding_window_view(data, k))


def hash_column(text: Column) -> Column:
    """hash64 of a column of texts, reinterpreted as signed longs; null stays null."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), dtype="Int64")
        for size, part in texts.dropna().map(str.encode).groupby(lambda i: len(texts[i].encode())):
            rows = np.frombuffer(b"".join(part), np.uint8).reshape(len(part), size)
            out[part.index] = hashes(rows).view(np.int64)
        return out

    return of(text)


def explode_hashes(df: DataFrame, k: int, seq: str = "seq", name: str = "kmer") -> DataFrame:
    """A row for the hash of each k-mer of both strands, as signed longs. Sequences are cut into overlapping chunks first."""

    @F.pandas_udf("array<long>")
    def of(chunks: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([np.concatenate([window_hashes(a, k), window_hashes(b, k)]).view(np.int64) for a, b in zip(chunks, others, strict=True)])

    cut = S.chunks(df, k, seq).withColumn("__other", S.reverse_complement(F.col("__chunk")))
    return cut.withColumn(name, F.explode(of("__chunk", "__other"))).drop("__chunk", "__other", seq)
