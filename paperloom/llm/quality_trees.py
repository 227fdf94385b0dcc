"""Quality classifier: gradient-boosted trees over statistics of a document's text.

The trees are grown in numpy on histograms of binned statistics and then flattened into arrays,
through which all rows of a batch go down together.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, free_names

#: Labelled rows that the trees are fitted on, at most.
SAMPLE_ROWS = 20_000
#: A score from here on means label 1.
THRESHOLD = 0.3
HELD_OUT_MOD, HELD_OUT = 5, 0
TREES, DEPTH, BINS, RATE, LEAST_ROWS, L2 = 80, 4, 64, 0.15, 10, 1.0

_SIGNS = b".,;:!?*%$&#|@+-_/\\\"'()[]{}<>=~^`"


def statistics(text: str | None) -> list[float]:
    """Statistics of the whole text; a null or empty one has all statistics 0."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * (WIDTH - 1) + [float(len(data) > 0)]
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size, n = len(data), len(words)
    upper, lower, digit = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    kinds = Counter(words)
    lines = [x for x in data.split(b"\n") if x]
    ends = Counter(w[-1] for w in words)
    starts = sum(65 <= w[0] <= 90 for w in words)
    per_line = [x.count(b" ") + 1 for x in lines]
    share = count / size
    shares = kinds.values()
    found = [
        np.log1p(size), np.log1p(n), sum(map(len, words)) / n, max(map(len, words)),
        upper / size, lower / size, digit / size, share[128:].sum(), upper / max(1, upper + lower),
        len(kinds) / n, max(shares) / n, sum(x for x in shares if x == 1) / n, np.log(n) - sum(x * np.log(x) for x in shares) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        starts / n, len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)), max(per_line, default=0) / n, n / max(1, len(lines)),
        sum(x < 4 for x in per_line) / max(1, len(lines)), n / (1 + count[46]), sum(len(w) == 1 for w in words) / n,
        sum(v for k, v in ends.items() if k in _SIGNS and k not in b".,") / n, (ends[46] + ends[44]) / n, share[list(_SIGNS)].sum(),
    ]
    return [float(x) for x in found] + [float(share[s]) for s in _SIGNS] + [1.0]


WIDTH = 25 + len(_SIGNS) + 1


class Trees:
    """A fitted forest as arrays [tree, node]: column, threshold, child (left; right is the next
    node), value. A leaf is its own child with a threshold that every value stays below."""

    def __init__(self, base: float, column: np.ndarray, threshold: np.ndarray, child: np.ndarray, value: np.ndarray):
        self.base, self.column, self.threshold, self.child, self.value = base, column, threshold, child, value

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for column, threshold, child, value in zip(self.column, self.threshold, self.child, self.value):
            node = np.zeros(len(x), np.intp)
            for _ in range(DEPTH):
                node = child[node] + (x[rows, column[node]] > threshold[node])
            total += value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Trees for logistic loss. Without rows the score is a half; with rows of one label only it is
    the smoothed share of label 1."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    nodes = (1 << (DEPTH + 1)) - 1
    column, threshold = np.zeros((trees, nodes), np.intp), np.full((trees, nodes), np.inf)
    child, value = np.tile(np.arange(nodes), (trees, 1)), np.zeros((trees, nodes))
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, column, threshold, child, value)
    width = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    cells = bins + np.arange(width) * BINS
    total = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        open_nodes, free = {0: np.arange(len(y))}, 1
        for _ in range(DEPTH):
            following = {}
            for node, rows in open_nodes.items():
                g, h = grad[rows].sum(), hess[rows].sum()
                value[t, node] = RATE * g / (h + L2)
                if len(rows) < 2 * LEAST_ROWS:
                    continue
                flat = cells[rows].ravel()
                hist = lambda w: np.bincount(flat, w if w is None else np.repeat(w[rows], width), width * BINS).reshape(width, BINS).cumsum(1)  # noqa: E731, B023
                gl, hl, nl = hist(grad), hist(hess), hist(None)
                gain = gl**2 / (hl + L2) + (g - gl) ** 2 / (h - hl + L2) - g**2 / (h + L2)
                gain[(nl < LEAST_ROWS) | (len(rows) - nl < LEAST_ROWS)] = 0
                f, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[f, b] <= 1e-9 or b >= len(cuts[f]):
                    continue
                column[t, node], threshold[t, node], child[t, node] = f, cuts[f][b], free
                right = bins[rows, f] > b
                following[free], following[free + 1] = rows[~right], rows[right]
                free += 2
            open_nodes = following
        for node, rows in open_nodes.items():
            value[t, node] = RATE * grad[rows].sum() / (hess[rows].sum() + L2)
        node = np.zeros(len(y), np.intp)
        for _ in range(DEPTH):
            node = child[t, node] + (x[np.arange(len(y)), column[t, node]] > threshold[t, node])
        total += value[t, node]
    return Trees(base, column, threshold, child, value)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted on at most ``sample`` labelled documents, those with the least hash of their id.

    Labels other than 0 and 1 are left out; of several labels of a document the least counts. Ids
    whose crc32 modulo 5 is 0 are held out. The sample is bounded, so it is broadcast.
    """
    labels = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labels = labels.filter(crc_mod("doc_id", HELD_OUT_MOD) != HELD_OUT).select(F.col("doc_id").alias("_id"), "quality")
    # A hash range first, so that each task offers about its part of the sample and not all of it.
    have = docs.select(F.col(doc_id).alias("_id")).join(labels, "_id").select("_id", "quality").distinct()
    share = min(1.0, 2 * sample / max(1, labels.count()))
    mark = F.xxhash64(F.col("_id"), F.lit(10))
    ids = have.filter(F.pmod(mark, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(mark, "_id").limit(sample)
    chosen = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(ids), "_id")

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return texts.map(statistics, na_action=None)

    rows = chosen.select("quality", measured("_text").alias("x"), mark.alias("mark")).toPandas().sort_values(["mark", "quality"])
    if not len(rows):
        return fit(np.zeros((0, WIDTH)), np.zeros(0))
    return fit(np.array(rows["x"].tolist()), rows["quality"].to_numpy(float))


def score(docs: DataFrame, trees: Trees, text: str = "text") -> Column:
    """Column with the score of each document, 0 to 1; null and empty texts are scored too."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.array([statistics(t) for t in texts]).reshape(-1, WIDTH)), texts.index)

    return scored(F.col(text))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. An empty table gives no rows; rows that
    repeat are scored alike; other columns are not looked at."""
    trees = learn(docs, labels)
    rows = docs.select("doc_id", "text").withColumn("score", score(docs, trees))
    held = (crc_mod("doc_id", HELD_OUT_MOD) == HELD_OUT).alias("held_out")
    return rows.select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted as label 1, with all their columns, whatever these are called.

    Null and empty texts are scored as texts without words; repeated rows stay or go alike; a null id
    has no label and is scored like any other; an empty table gives no rows.
    """
    names = docs.columns
    (mark,) = free_names(docs, "mark")
    return docs.select("*", score(docs, learn(docs, labels)).alias(mark)).filter(F.col(mark) >= THRESHOLD).select(*names)
