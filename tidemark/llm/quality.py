"""Document quality by pairwise ranking.

A Bradley-Terry model gives each document a strength; of a pair (labelled 1, labelled 0) the first should win, so the
weights minimise the logistic loss on differences of features. The cut between kept and rejected documents is a quantile of
the strengths of the fitting sample; scores are scaled so that this quantile has the score ``CUT``.

The fit uses at most ``max_labelled`` labelled rows (the documented bound: those of lowest hash). Scoring covers every
whole text. Inputs of a score are the text alone.

Defined results: a null or empty text is scored like a text without characters; labels that are null are left out, several labels
of one document count as 1 if at least half are; with one class only, or no labels, every score is 0.5.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUT = 0.3
MAX_LABELLED = 20_000
PARTNERS = 8
_BYTES = {
    "upper": np.array([65 <= b <= 90 for b in range(256)]),
    "digit": np.array([48 <= b <= 57 for b in range(256)]),
    "space": np.array([b in (9, 10, 11, 12, 13, 32) for b in range(256)]),
    "stop": np.isin(np.arange(256), list(b".,;:?'\"")),
    "exclaim": np.isin(np.arange(256), list(b"!")),
    "bar": np.isin(np.arange(256), list(b"|/\\<>=_~^")),
    "symbol": np.isin(np.arange(256), list(b"#$%&*@+{}[]`")),
    "wide": np.arange(256) >= 128,
}
_CLASSES = np.array(list(_BYTES.values()), dtype=float).T
FEATURES = [*_BYTES, "words", "word_length", "distinct_words", "lines", "distinct_lines", "short_words", "plain_ends", "length"]


def features(texts: list[str | None]) -> np.ndarray:
    """One row of features a text, each bounded or logarithmic."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        if not text:
            continue
        data = text.encode("utf-8", "replace")
        histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        out[i, :len(_BYTES)] = histogram @ _CLASSES / len(data)
        words, lines = text.split(), text.split("\n")
        n = max(1, len(words))
        ends = sum(1 for x in lines if x[-1:] in ".!?")
        out[i, len(_BYTES):] = (
            n / len(text), min(40.0, sum(map(len, words)) / n) / 40, len(set(words)) / n ** 0.9, len(lines) / n,
            len(set(lines)) / len(lines), sum(1 for w in words if len(w) < 3) / n, ends / len(lines), np.log1p(len(text)) / 15)
    return out


@dataclass(frozen=True)
class Ranker:
    """Strength ``(features - mean) / sd @ weights``; ``cut`` is the strength of score ``CUT``."""

    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -8, 8) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(x), 0.5)
        z = np.log(CUT / (1 - CUT)) + (self.strengths(x) - self.cut) / self.scale
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_pairs(x: np.ndarray, y: np.ndarray, partners: int = PARTNERS, ridge: float = 1e-3, steps: int = 50) -> Ranker:
    """Bradley-Terry weights by Newton steps on ``partners`` preference pairs of each document."""
    mean = x.mean(axis=0) if len(x) else np.zeros(len(FEATURES))
    sd = x.std(axis=0) if len(x) else np.ones(len(FEATURES))
    sd = np.where(sd > 1e-9, sd, 1.0)
    z = np.clip((x - mean) / sd, -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    none = Ranker(mean, sd, np.zeros(len(mean)), 0.0, 1.0)
    if not len(good) or not len(bad):
        return none
    draw = np.random.default_rng(17)
    first = np.concatenate([np.repeat(good, partners), draw.choice(good, len(bad) * partners)])
    second = np.concatenate([draw.choice(bad, len(good) * partners), np.repeat(bad, partners)])
    d, w = z[first] - z[second], np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = d.T @ p / len(d) - ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    if not w.any():
        return none
    s = z @ w
    # The quantile of the strengths that best tells the classes apart, in the middle of the best run.
    q = np.quantile(s, np.linspace(0.002, 0.998, 499))
    low, high = np.sort(s[bad]), np.sort(s[good])
    gain = np.searchsorted(low, q) / len(low) - np.searchsorted(high, q) / len(high)
    best = q[gain >= gain.max() - 1e-12]
    cut = float((best[0] + best[-1]) / 2)
    return Ranker(mean, sd, w, cut, float(max(1e-6, s.std())) / 4)


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Texts and labels of at most ``max_labelled`` documents whose id is not held out."""
    own = (labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"))
           .where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
           .groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
           .orderBy(F.xxhash64("id"), "id").limit(max_labelled))
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    # At most max_labelled rows of two numbers are sent to every executor.
    return texts.join(F.broadcast(own), "id").groupBy("id", "label").agg(F.max("body").alias("body"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Ranker:
    """Fit on the bounded sample; only its feature rows reach the driver."""
    def measured(batches):
        for part in batches:
            x = pd.DataFrame(features(part["body"].tolist()), columns=FEATURES)
            yield pd.concat([part[["id", "label"]].reset_index(drop=True), x], axis=1)

    chosen = training_rows(docs, labels, max_labelled)
    schema = f"id {chosen.schema['id'].dataType.simpleString()}, label int, " + ", ".join(f"{c} double" for c in FEATURES)
    rows = chosen.select("id", "label", "body").mapInPandas(measured, schema).toPandas().sort_values("id")
    return fit_pairs(rows[FEATURES].to_numpy(float), rows["label"].to_numpy(int))


def score(model: Ranker, text: Column) -> Column:
    """Score of a text column, 0 to 1."""
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(features(texts.tolist())))

    return scored(text)


def accepted(docs: DataFrame, model: Ranker, cut: float = CUT) -> DataFrame:
    """The documents with a score of at least ``cut``, columns unchanged."""
    return docs.where(score(model, docs["text"]) >= cut)
