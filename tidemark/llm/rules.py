"""Quality rules: fixed limits on document statistics, then gradient-boosted trees over them.

The trees are fitted to ``labels.quality`` by the logistic loss on histograms of at most ``BINS`` values a statistic. Statistics in
``FALLING`` may only lower a score: a split on one is taken only if it orders its children so, and the middle of the two values
bounds everything below them, which makes the whole tree monotonic. The fitted trees are flattened into arrays of nodes
(statistic, threshold, children, value; leaves point to themselves), so a batch of rows steps through all trees together.

The fit uses at most ``max_labelled`` labelled rows (the documented bound: those of lowest hash) whose id is not held out. Statistics and
verdicts cover every whole text; the text alone is the input of a score.

Defined results: a null or empty text, or one without words, has zero statistics and fails the base rule; labels that are null are left
out, several labels of one document count as 1 if at least half are; with one class only, or no labels, every score is 0.5;
repeated rows are judged each.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD
from tidemark.llm.quality import training_rows

LEAST_WORDS, MOST_REPEATED, CUT = 50, 50, 0.3
MAX_LABELLED = 20_000
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbol_share", "dup_line_share", "repeat_share", "exclaim_share", "bar_share", "upper_share", "digit_share", "word_length",
            "distinct_share", "short_share", "ended_share", "log_words", "words_a_line", "stop_share"]
#: Statistics that may only lower the score.
FALLING = ["symbol_share", "dup_line_share", "repeat_share", "exclaim_share", "bar_share"]
TREES, DEPTH, RATE, BINS, LEAST_WEIGHT, RIDGE = 80, 3, 0.15, 48, 1.0, 1.0
_WORD = re.compile(WORD)
_UPPER, _DIGIT = re.compile("[A-ZÀ-ÖØ-Þ]"), re.compile("[0-9]")
_SYMBOL = re.compile(r"[#*$%&|<>]")


def repeated_words(words: list[str]) -> int:
    """Words in windows of three that occur twice or more in ``words``, each counted once."""
    if len(words) < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # Numbers of pairs stay below the count of words, so the code of a window cannot overflow.
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, window, n = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    at = np.flatnonzero(n[window] > 1)
    covered = np.zeros(len(words), bool)
    covered[at] = covered[at + 1] = covered[at + 2] = True
    return int(covered.sum())


def statistics(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Base counts and features, one row a text."""
    base, out = np.zeros((len(texts), len(BASE)), np.int64), np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        words = _WORD.findall(text) if text else []
        if not words:
            if text:
                base[i, 2] = len(_SYMBOL.findall(text))
            continue
        lines = [x for x in text.split("\n") if x and _WORD.search(x)]
        n, chars, symbols = len(words), sum(map(len, words)), len(_SYMBOL.findall(text))
        repeats, duplicates, distinct = repeated_words(words), len(lines) - len(set(lines)), set(words)
        base[i] = n, chars, symbols, duplicates, repeats
        lengths = [len(w) for w in words]
        out[i] = (symbols / chars, duplicates / len(lines), repeats / n, text.count("!") / n, text.count("|") / n, len(_UPPER.findall(text)) / chars,
                  len(_DIGIT.findall(text)) / chars, min(40.0, chars / n), len(distinct) / n ** 0.9, sum(1 for x in lengths if x < 3) / n,
                  sum(1 for x in lines if x.rstrip()[-1:] in ".!?") / len(lines), np.log1p(n), min(400.0, n / len(lines)),
                  sum(map(text.count, ".,;:?")) / n)
    return base, out


@dataclass(frozen=True)
class Trees:
    """All nodes of all trees in flat arrays; ``roots`` are the first nodes. A leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float
    depth: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.start + self.value[node].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS,
        falling: list[str] = FALLING, names: list[str] = FEATURES) -> Trees:
    """Boosted trees by second-order steps on the logistic loss."""
    nodes: dict[str, list] = {c: [] for c in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    n, width = x.shape

    def leaf(value: float) -> int:
        at = len(nodes["value"])
        for c, v in (("feature", 0), ("threshold", np.inf), ("left", at), ("right", at), ("value", value)):
            nodes[c].append(v)
        return at

    positive = float(y.mean()) if n else 0.5
    if not 0 < positive < 1:
        roots.append(leaf(0.0))
        return Trees(*[np.array(nodes[c]) for c in nodes], np.array(roots), 0.0, 1)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    codes = binned + np.arange(width) * bins
    sign = np.array([-1 if c in falling else 0 for c in names])
    start = float(np.log(positive / (1 - positive)))
    margin = np.full(n, start)

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray):
        """Gain, statistic and bin of the best split that keeps the order of the children."""
        flat = codes[rows].ravel()
        each = np.repeat(np.arange(len(rows)), width)
        sums = [np.cumsum(np.bincount(flat, v[rows][each], width * bins).reshape(width, bins), axis=1) for v in (g, h)]
        (gl, hl), (gt, ht) = sums, (g[rows].sum(), h[rows].sum())
        gr, hr = gt - gl, ht - hl
        gain = gl ** 2 / (hl + RIDGE) + gr ** 2 / (hr + RIDGE) - gt ** 2 / (ht + RIDGE)
        order = sign[:, None] * (gr / (hr + RIDGE) - gl / (hl + RIDGE)) >= 0
        gain = np.where((hl >= LEAST_WEIGHT) & (hr >= LEAST_WEIGHT) & order, gain, -np.inf)
        best = int(np.argmax(gain))
        return float(gain.flat[best]), best // bins, best % bins

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        own = float(np.clip(g[rows].sum() / (h[rows].sum() + RIDGE), low, high))
        gain, j, b = split(rows, g, h) if level < depth and len(rows) > 1 else (-np.inf, 0, 0)
        if gain <= 1e-9 or b >= len(edges[j]):
            at = leaf(rate * own)
            margin[rows] += rate * own
            return at
        at = leaf(0.0)
        goes = binned[rows, j] <= b
        sides = rows[goes], rows[~goes]
        values = [float(np.clip(g[r].sum() / (h[r].sum() + RIDGE), low, high)) for r in sides]
        bounds = [(low, high), (low, high)]
        if sign[j]:
            middle = sum(values) / 2
            bounds = [(middle, high), (low, middle)]
        children = [grow(r, g, h, level + 1, *s) for r, s in zip(sides, bounds)]
        nodes["feature"][at], nodes["threshold"][at] = j, edges[j][b]
        nodes["left"][at], nodes["right"][at] = children
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), y - p, p * (1 - p), 0, -np.inf, np.inf))
    return Trees(*[np.array(nodes[c]) for c in nodes], np.array(roots), start, depth)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Trees:
    """Fit on the bounded sample; only its rows of statistics reach the driver."""
    def measured(batches):
        for part in batches:
            x = pd.DataFrame(statistics(part["body"].tolist())[1], columns=FEATURES)
            yield pd.concat([part[["id", "label"]].reset_index(drop=True), x], axis=1)

    chosen = training_rows(docs, labels, max_labelled)
    schema = f"id {chosen.schema['id'].dataType.simpleString()}, label int, " + ", ".join(f"{c} double" for c in FEATURES)
    rows = chosen.select("id", "label", "body").mapInPandas(measured, schema).toPandas().sort_values("id")
    return fit(rows[FEATURES].to_numpy(float), rows["label"].to_numpy(float))


def judged(model: Trees, text: Column) -> Column:
    """Struct of the base counts, ``base_failed``, ``score`` and ``kept`` of a text column."""
    schema = ", ".join(f"{c} bigint" for c in BASE) + ", base_failed boolean, score double, kept boolean"

    @F.pandas_udf(schema)
    def verdict(texts: pd.Series) -> pd.DataFrame:
        base, x = statistics(texts.tolist())
        out = pd.DataFrame(base, columns=BASE)
        out["base_failed"] = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])
        out["score"] = model.scores(x)
        out["kept"] = ~out["base_failed"] & (out["score"] >= CUT)
        return out

    return verdict(text)


def accepted(docs: DataFrame, model: Trees) -> DataFrame:
    """The documents that pass both rules, columns unchanged."""
    return docs.where(judged(model, docs["text"])["kept"])
