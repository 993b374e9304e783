"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Character trigrams are hashed into a fixed number of buckets. Two multinomials over the buckets
are estimated: the raw one from every document, the target one from trusted documents (label
quality 1), smoothed towards the raw one: it is a mixture of both with weight TRUST. A document's
score is its summed log ratio log p_target - log p_raw over its trigrams, divided by their number.
Only shares enter, so the score doesn't depend on the size of the tables, and the mean score of the
trusted trigrams can't be below 0. Documents at or above a fixed threshold are kept, so the verdict
on a document is deterministic given the two tables.

Defined results: a null text is empty; a text with fewer than three characters scores 0; without
any trusted document all ratios are 0 and only the base rules decide. The ratio of a bucket that no
document of the fitted corpus has is 0. Repeated rows each get the
same result and each count in the raw multinomial. A document with several labels is trusted if
one of them is 1. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, small_batches

#: Buckets of the trigram hash (a prime) and its multipliers.
BUCKETS, MUL_1, MUL_2 = 16381, 9973, 613
#: Weight of the trusted distribution in the target; the rest is the raw one.
TRUST = 0.5
#: A document is kept if its length-normalised score is at least this.
THRESHOLD = -0.1
#: The trusted target is fitted on at most so many labelled documents, those with the smallest MD5 of doc_id.
MAX_TRUSTED = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

SYMBOLS = b"#*$%&|<>"
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def buckets(text: str) -> np.ndarray:
    """Bucket of each character trigram of a text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    if len(c) < 3:
        return np.empty(0, np.int64)
    return (c[:-2] * MUL_1 + c[1:-1] * MUL_2 + c[2:]) % BUCKETS


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    n = len(words)
    repeated = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
        _, pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)
        _, window, count = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
        again = count[window] > 1
        if again.any():
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : k + n - 2] |= again
            repeated = int(covered.sum())
    return n, len(text) - sum(text.count(c) for c in WS), len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated


@dataclass
class Model:
    """Log ratio of each bucket; bounded by BUCKETS numbers, so it travels with the task."""

    ratio: np.ndarray
    threshold: float = THRESHOLD


def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each bucket in all and in trusted documents of a partition."""
    counts = np.zeros((2, BUCKETS), np.int64)
    waiting: tuple[list, list] = ([], [])
    size = 0

    def add() -> None:
        for k, found in enumerate(waiting):
            if found:
                counts[k] += np.bincount(np.concatenate(found), minlength=BUCKETS)
                found.clear()

    for batch in batches:
        for text, trusted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            b = buckets(text or "")
            waiting[0].append(b)
            if trusted:
                waiting[1].append(b)
            if (size := size + len(b)) > 1 << 20:
                add()
                size = 0
    add()
    k = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(counts[0][k]), pa.array(counts[1][k])], names=["bucket", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_trusted: int = MAX_TRUSTED) -> Model:
    """Both multinomials in one scan; the trusted ids are broadcast, at most max_trusted of them."""
    small_batches(docs.sparkSession)
    ids = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    ids = ids.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_trusted).withColumn("trusted", F.lit(True))
    marked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    found = marked.mapInArrow(histogram, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in found.collect():  # at most BUCKETS rows
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    ratio, seen = np.zeros(BUCKETS), raw > 0
    if target.sum():
        ratio[seen] = np.log(TRUST * (target[seen] / target.sum()) / (raw[seen] / raw.sum()) + 1 - TRUST)
    return Model(ratio, threshold)


def verdict(model: Model, text: str = "text"):
    """A column with the base counts and the score of a text."""
    ratio = model.ratio

    @F.pandas_udf(RESULT)
    def judge(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            b = buckets(t := t or "")
            rows.append((*base_counts(t), float(ratio[b].sum() / len(b)) if len(b) else 0.0))
        return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"])

    return judge(F.col(text))


def apply(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns named in keep, the base counts, base_failed and kept of every row."""
    small_batches(docs.sparkSession)
    q = F.col("__quality")
    failed = (q.n_words < MIN_WORDS) | (100 * q.n_repeat_words > MAX_REPEAT_PERCENT * q.n_words)
    counts = [q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    out = docs.select(*[docs[c] for c in keep], verdict(model).alias("__quality"))
    return out.select(*keep, *counts, failed.alias("base_failed"), (~failed & (q.score >= model.threshold)).alias("kept"))


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns."""
    model = fit(docs, labels)
    q = F.col("__quality")
    good = (q.n_words >= MIN_WORDS) & (100 * q.n_repeat_words <= MAX_REPEAT_PERCENT * q.n_words) & (q.score >= model.threshold)
    return docs.select("*", verdict(model).alias("__quality")).where(good).select(*docs.columns)
