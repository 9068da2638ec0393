"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

A text is cut into windows at blanks.  Each window is compressed with the ordinary dictionary and with one
that holds the toxic segments besides; what the second saves is the window's distance.  A logistic
curve, calibrated on labelled rows that the dictionaries haven't seen, turns a text's largest and total
saving into a score.

Training: the ordinary dictionary comes from zstandard's trainer on windows of ordinary texts.  On
toxic texts that trainer keeps what is frequent, and so mostly ordinary words; the toxic dictionary
is therefore built from the segments of words whose k-byte parts are far more frequent in toxic than in
ordinary texts.  Both share the ordinary content at equal distances, so that only toxic segments make a
difference.

How it scales.  The fit uses a bounded sample of labelled texts (``sample`` for each class, the first by a hash
of the doc_id, and ``most_bytes`` of each class), of whose windows ``most_windows``, evenly spaced, train the ordinary dictionary, and
segments go into the toxic one, the most frequent first, while ``toxic_size`` has room; scoring is one pass over all texts with no shuffle, and what is broadcast is bounded by
the sizes of the dictionaries.

Nulls and odd cases: a null text counts as empty and has no saving; very long texts are scored whole, window by window; equal
texts get equal scores, repeated rows are scored on their own and count once in the sample; labels that are null or belong to no
document are left out; without labels of both classes every score is the share of 1s (0.5 without any); the column of scores is the only
one added, and replaces one of its name in with_score (classify reads doc_id and text alone); an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, kept, labelled_sample, text_batches

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_WINDOW = re.compile(rb"\S.{0,96}(?=\s|$)|\S{1,200}", re.S)  # up to 97 bytes to a blank; words beyond that in parts
_PARAMETERS = dict(window_log=17, hash_log=17, chain_log=17, search_log=4, min_match=5, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)


def windows(text: str | None) -> list[bytes]:
    return [b" " + w + b" " for w in _WINDOW.findall((text or "").encode().lower())]


class Savings:
    """What the toxic dictionary saves on each window, in bytes."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        parameters = zstandard.ZstdCompressionParameters(**_PARAMETERS)
        self.compressors = []
        for content in (ordinary, toxic + ordinary):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=parameters)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=held, compression_params=parameters))

    def features(self, text: str | None) -> tuple[float, float]:
        plain, toxic = (c.compress for c in self.compressors)
        saved = [len(plain(w)) - len(toxic(w)) for w in windows(text)]
        return max(saved, default=0), sum(x for x in saved if x > 0) / (1 + len(saved)) ** 0.5


def _parts(words: set[bytes], k: int) -> set[bytes]:
    return {w[i : i + k] for w in (b" " + x + b" " for x in words) for i in range(len(w) - k + 1)}


def toxic_segments(toxic: list[bytes], ordinary: list[bytes], k: int = 5, ratio: float = 5.0, least: float = 0.01, toxic_size: int = 8192) -> bytes:
    """Segments of words, the most frequent last, all of whose k-byte parts are in `ratio` times as many toxic texts as an upper bound from the ordinary ones gives."""
    in_toxic, in_ordinary = Counter(), Counter()
    for texts, counts in ((toxic, in_toxic), (ordinary, in_ordinary)):
        for t in texts:
            counts.update(_parts(set(_WORD.findall(t)), k))
    share = len(toxic) / max(1, len(ordinary))
    bound = lambda p: (in_ordinary[p] + 2 * (in_ordinary[p] + 1) ** 0.5 + 1) * share
    marks = {p for p, n in in_toxic.items() if n >= max(3, least * len(toxic)) and n > ratio * min(bound(p), len(toxic) / ratio)}
    found = Counter()
    for t in toxic:
        for w in _WORD.findall(t):
            w, start = b" " + w + b" ", None
            for i in range(len(w) - k + 2):
                if i <= len(w) - k and w[i : i + k] in marks:
                    start = i if start is None else start
                elif start is not None:
                    found[w[start : i + k - 1]] += 1
                    start = None
    kept, room = [], toxic_size
    for s, _ in sorted(found.items(), key=lambda x: (-x[1], x[0])):
        room -= len(s)
        if room < 0:
            break
        kept.append(s)
    return b"".join(reversed(kept))


def ordinary_dictionary(texts: list[str], size: int = 65536, most_windows: int = 30_000) -> bytes:
    samples = [w for t in texts for w in windows(t)]
    step = max(1, len(samples) // most_windows)
    try:
        return zstandard.train_dictionary(size, samples[::step]).as_bytes()
    except zstandard.ZstdError:  # too few samples for the trainer: their plain text
        return b"".join(samples)[-size:]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 100) -> np.ndarray:
    """Weights (the last is the constant) by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - 0.7 * np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + keep, x.T @ (p - y) + keep @ w)
    return w


@dataclass
class Model:
    """share alone if only one class has labels."""

    share: float
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray | None = None

    def scorer(self):
        if self.weights is None:
            return lambda text: self.share
        savings = Savings(self.ordinary, self.toxic)
        most, total, constant = self.weights
        def score(text: str | None) -> float:
            a, b = savings.features(text)
            return float(1 / (1 + np.exp(-np.clip(most * a + total * b + constant, -40, 40))))
        return score


def fit(rows: list[tuple[str, int]], shift: float = 0.0) -> Model:
    """From (text, label) in random order; every fourth row calibrates, copies of a text count once.

    shift: what the sample's log odds lack to those of all labels.
    """
    rows = list(dict.fromkeys((t or "", int(y)) for t, y in rows))
    share = float(np.mean([y for _, y in rows])) if rows else 0.5
    part = lambda y, cal: [t for i, t in enumerate(t for t, z in rows if z == y) if (i % 4 == 3) == cal]
    if not part(1, True) or not part(0, True):
        return Model(share)
    ordinary, toxic = ([t.encode().lower() for t in part(y, False)] for y in (0, 1))
    model = Model(share, ordinary_dictionary(part(0, False)), toxic_segments(toxic, ordinary))
    savings = Savings(model.ordinary, model.toxic)
    seen = [(*savings.features(t), y) for y in (0, 1) for t in part(y, True)]
    x = np.array(seen, float)
    model.weights = logistic(x[:, :2], x[:, 2]) + [0, 0, shift]
    return model


def with_score(docs: DataFrame, labels: DataFrame, column: str = "score", label: str = "toxic", mod: int = 4, sample: int = 2500, most_bytes: int = 32 << 20) -> DataFrame:
    """docs with one more column: the score of each text, from 0 to 1."""
    text_batches(docs.sparkSession)
    rows, shift = labelled_sample(docs, labels, label, mod, sample, most_bytes)
    model = docs.sparkSession.sparkContext.broadcast(fit([(r.x, r.y) for r in rows], shift))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        one = kept(model, Model.scorer)
        return pd.Series([one(t) for t in texts], index=texts.index, dtype=float)

    return docs.withColumn(column, score("text"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, mod: int = 4, **options) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    out = with_score(docs.select("doc_id", "text"), labels, "score", mod=mod, **options)
    return out.select("doc_id", held_out("doc_id", mod).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
