"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each text gives a vector of transformed statistics (shares of character classes, lengths, repetition,
compressibility).  Each class has its mean and a covariance shrunk towards a scaled identity; the score is
the calibrated difference of the two Mahalanobis log-densities, with Cholesky factors that are computed
and inverted once.

How it scales.  The fit uses a bounded sample of labelled texts (``sample`` for each class, the first by a
hash of the doc_id), of which only the statistics leave their tasks; every fourth of them calibrates and takes no part in the Gaussians; every document is scored in one pass over the texts with no shuffle.  Only two
means and factors are broadcast.

Nulls and odd cases: a null text counts as empty and gets a score like any other; very long texts are read whole; equal texts get
equal scores, repeated rows are scored on their own and count once in the sample; labels that are null
or belong to no document are left out; without labels of both classes every score is the share of 1s
(0.5 without any); the column of scores is the only one added, and replaces one of its name in with_score (classify reads doc_id
and text alone); an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, text_batches

_CLASS = np.zeros(256, np.int64)  # 0 other control, 1 lower, 2 upper, 3 digit, 4 blank, 5 newline, 6 sentence mark, 7 symbol, 8 not ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 8
for _c in b" \t\x0b\x0c\r":
    _CLASS[_c] = 4
_CLASS[10] = 5
for _c in b".,;:'\"-()?":
    _CLASS[_c] = 6
for _c in b"!#$%&*+/<=>@[\\]^_`{|}~":
    _CLASS[_c] = 7
NAMES = ("lower", "upper", "digit", "blank", "newline", "mark", "symbol", "wide", "word_length", "sentences", "line_repeats", "word_repeats", "packed", "entropy", "size")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; roots and logs make the shares roughly normal."""
    raw = (text or "").encode()
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    by_class = np.bincount(_CLASS, weights=counts, minlength=9)[1:]
    words = _WORD.findall(raw)
    lines = raw.split(b"\n")
    p = counts[counts > 0] / max(1, n)
    shares = np.sqrt(by_class / max(1, n))
    return [
        *shares,
        np.log1p((n - by_class[3] - by_class[4]) / max(1, len(words))),
        np.log1p(counts[46] / (1 + len(words)) * 20),
        np.sqrt(1 - len(set(lines)) / len(lines)),
        np.sqrt(1 - len(set(words)) / max(1, len(words))),
        len(zlib.compress(raw, 1)) / (n + 20),
        float(-(p * np.log2(p)).sum()),
        np.log1p(n),
    ]


@dataclass
class Discriminant:
    """Two Gaussians on standardised statistics, and the logistic calibration of their difference."""

    centre: np.ndarray
    scale: np.ndarray
    means: list
    factors: list  # inverses of the lower Cholesky factors of the shrunk covariances
    slope: float
    offset: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        logs = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            y = np.einsum("nj,ij->ni", z - mean, factor)
            logs.append(-0.5 * (y * y).sum(1) + np.log(np.diag(factor)).sum())
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -40, 40)))


def calibrate(d: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (difference, label) by damped Newton steps."""
    scale = max(1e-9, np.median(np.abs(d)))
    a, b, z = 1.0, 0.0, np.clip(d / scale, -20, 20)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * z + b)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * z).sum() + 1e-3 * a, (p - y).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - 0.5 * step[0], b - 0.5 * step[1]
    return a / scale, b


def fit(x: np.ndarray, y: np.ndarray, shrinkage: float = 0.1, shift: float = 0.0) -> Discriminant | float:
    """The model, or the share of 1s if one class has fewer than two rows.  shift: what the sample's log odds lack to those of all labels.

    Every fourth row of a class calibrates, if each class has two of them; else all rows do both.
    """
    if min((y == 1).sum(), (y == 0).sum()) < 2:
        return float(y.mean()) if len(y) else 0.5
    turn = np.zeros(len(y), int)
    for k in (0, 1):
        turn[y == k] = np.arange((y == k).sum())
    apart = turn % 4 == 3
    if min((y[apart] == 1).sum(), (y[apart] == 0).sum()) < 2:
        apart = np.ones(len(y), bool)
        own = apart
    else:
        own = ~apart
    centre, scale = x[own].mean(0), x[own].std(0) + 1e-6
    z = np.clip((x - centre) / scale, -8, 8)
    means, factors = [], []
    for k in (0, 1):
        part = z[own & (y == k)]
        cov = np.cov(part.T, bias=True)
        cov = (1 - shrinkage) * cov + shrinkage * (np.trace(cov) / len(cov) + 1e-3) * np.eye(len(cov))
        means.append(part.mean(0))
        factors.append(np.linalg.inv(np.linalg.cholesky(cov)))
    model = Discriminant(centre, scale, means, factors, 1.0, 0.0)
    model.slope, model.offset = calibrate(model.difference(x[apart]), y[apart].astype(float))
    model.offset += shift
    return model


def with_score(docs: DataFrame, labels: DataFrame, column: str = "score", label: str = "quality", mod: int = 4, sample: int = 6000) -> DataFrame:
    """docs with one more column: the score of each text, from 0 to 1."""
    text_batches(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts], index=texts.index, dtype=object)

    rows, shift = labelled_sample(docs, labels, label, mod, sample, most_bytes=1 << 50, value=measured)
    x, y = np.array([r.x for r in rows], float).reshape(-1, len(NAMES)), np.array([r.y for r in rows], int)
    model = docs.sparkSession.sparkContext.broadcast(fit(x, y, shift=shift))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = model.value
        if isinstance(m, float) or not len(texts):
            return pd.Series(np.full(len(texts), m if isinstance(m, float) else 0.0), index=texts.index)
        return pd.Series(m.score(np.array([statistics(t) for t in texts])), index=texts.index)

    return docs.withColumn(column, score("text"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, mod: int = 4, **options) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    out = with_score(docs.select("doc_id", "text"), labels, "score", mod=mod, **options)
    return out.select("doc_id", held_out("doc_id", mod).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
