"""Quality classifier: Bradley-Terry ranking of documents by preference pairs.

Every labelled document with quality 1 is preferred to one with quality 0. A linear score s(x) of
text features is learned from such pairs by logistic loss on the difference of the two feature
vectors. The threshold is a quantile of the scores of the labelled documents: the share of quality 0
among them. The reported score is a logistic function of s that equals CUT at that quantile, so
predicting 1 at a score of CUT or more is the threshold by score quantile.

Defined results: a null text is an empty text, which has features of its own and gets a score like
any other; without labels of both kinds every score is CUT. Repeated rows get equal scores. A row's
label is the smallest of its labels. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, small_batches

#: A document is predicted to be good from this score on.
CUT = 0.7
#: The model is fitted on at most so many labelled documents, those with the smallest MD5 of doc_id, and so many pairs.
MAX_LABELLED, MAX_PAIRS = 20_000, 200_000
#: Ridge penalty and Newton steps of the logistic loss.
RIDGE, STEPS = 1e-3, 25
SEED = 7

FEATURES = (
    "no_words", "few_words", "log_words", "word_length", "symbols", "exclamations", "bars", "digits", "upper", "upper_words",
    "punctuated", "letters", "repeated_windows", "distinct_words", "duplicate_lines", "top_word", "line_words", "other_marks",
)


def features(text: str) -> list[float]:
    """Features of a text; all but log_words and line_words are shares or bounded."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    size = max(1, len(text) - sum(text.count(c) for c in WS))
    order: dict[bytes, int] = {}
    ids = np.fromiter((order.setdefault(w, len(order)) for w in words), np.int64, n)
    top = int(np.bincount(ids).max()) if n else 0
    windows = 0.0
    if n > 3:
        _, pair = np.unique(ids[:-1] * len(order) + ids[1:], return_inverse=True)
        distinct = len(np.unique(pair[:-1] * len(order) + ids[2:]))
        windows = 1 - distinct / (n - 2)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    kinds = np.bincount(KIND[np.frombuffer(data, np.uint8)], minlength=8)
    upper_words = sum(1 for w in words if len(w) > 1 and w.isupper())
    marked = sum(1 for w in words if not (w[-1:].isalnum() or w[-1] > 127 or w[-1:] in b".,"))
    return [
        float(n == 0), float(n < 50), float(np.log1p(n)), min(size / max(1, n), 50.0) / 10, kinds[1] / size, kinds[2] / size, kinds[3] / size, kinds[4] / size, kinds[5] / size,
        upper_words / max(1, n), marked / max(1, n), kinds[6] / size, windows, len(order) / max(1, n), 1 - len(set(lines)) / max(1, len(lines)), top / max(1, n), float(np.log1p(n / max(1, len(lines)))), kinds[7] / size,
    ]


#: Kind of each byte: symbol, exclamation mark, bar, digit, upper case, lower case or part of a longer character, other mark.
KIND = np.zeros(256, np.uint8)
for _b in range(33, 256):
    _c = chr(_b)
    KIND[_b] = 1 if _c in "#*$%&<>" else 2 if _c == "!" else 3 if _c == "|" else 4 if _c.isdigit() and _b < 128 else 5 if "A" <= _c <= "Z" else 6 if "a" <= _c <= "z" or _b > 127 else 7


@dataclass
class Model:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    quantile: float
    spread: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores between 0 and 1 of rows of features."""
        s = ((x - self.mean) / self.scale) @ self.weights
        z = (s - self.quantile) / self.spread + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Bradley-Terry by Newton's method on sampled pairs of a good and a bad document."""
    if not len(x) or y.min() == y.max():
        return Model(np.zeros(len(FEATURES)), np.zeros(len(FEATURES)), np.ones(len(FEATURES)), 0.0, 1.0)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - mean) / scale
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(SEED)
    n = min(MAX_PAIRS, len(good) * len(bad))
    d = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w = np.zeros(d.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        gradient = d.T @ (1 - p) / n - RIDGE * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / n + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = np.sort(z @ w)
    k = min(len(s) - 1, round(len(s) * float((y == 0).mean())))
    spread = max(1e-6, float(s[k:].std()))
    return Model(w, mean, scale, float((s[max(0, k - 1)] + s[k]) / 2), spread)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labelled documents that aren't held out; their ids, at most MAX_LABELLED, are broadcast."""
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(MAX_LABELLED)

    @F.pandas_udf("array<double>")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t or "") for t in texts])

    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "quality", vector("text").alias("x"))
    rows = rows.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).orderBy("doc_id").collect()  # at most MAX_LABELLED
    return train(np.array([r.x for r in rows]).reshape(-1, len(FEATURES)), np.array([int(r.quality > 0) for r in rows]))


def apply(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns named in keep, held_out, score and predicted of every row."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(model.scores(np.array([features(t or "") for t in texts])))

    out = docs.select(*keep, held_out().alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0).cast("int"))
