"""Quality by gradient-boosted trees on histograms of document statistics.

Statistics of whole texts are binned by quantiles; each tree grows level by level from histograms of gradients. The
fitted trees are flattened into arrays of equal length, which numpy walks for a whole batch at once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most (those of the smallest seeded hashes), and the trees' shape.
TRAINING_ROWS, TREES, DEPTH, BINS, RATE, RIDGE, LEAST_WEIGHT = 20_000, 80, 4, 64, 0.15, 1.0, 1.0
THRESHOLD = 0.3
MARKS = b".,!?;:|#$%&*@/\\-_\"'()[]{}<>=+~^`"


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; null counts as empty, of which all are 0."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * (24 + len(MARKS))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    share = counts / n
    words = text.split()
    m = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x]
    length = sum(map(len, words)) / m
    doubled = sum(c for c in seen.values() if c > 1)
    ends = Counter(w[-1] for w in words)
    starts = Counter(w[0] for w in words)
    clean = sum(1 for w in seen if w.isalpha()) / max(1, len(seen))
    return [
        np.log1p(n), np.log1p(len(words)), share[65:91].sum(), share[97:123].sum(), share[48:58].sum(), share[32], share[10], share[128:].sum(), share[:32].sum(), 1 - share[33:48].sum() - share[58:65].sum() - share[91:97].sum() - share[123:127].sum(),
        length, len(seen) / m, max(seen.values(), default=0) / m, doubled / m, sum(a == b for a, b in zip(words, words[1:], strict=False)) / m,
        len(lines), len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), len(zlib.compress(raw, 1)) / n,
        sum(c for k, c in ends.items() if not k.isalnum()) / m, max(ends.values(), default=0) / m, sum(c for k, c in starts.items() if k.isupper()) / m, clean, max(map(len, words), default=0),
        *share[list(MARKS)],
    ]


@dataclass
class Trees:
    """`size` nodes for each tree: the node's statistic and threshold, its left child (the right one follows) and its value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    size: int
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))[:, None]
        at = np.arange(0, len(self.feature), self.size)[None, :].repeat(len(x), 0)
        for _ in range(self.depth):
            to = self.left[at]
            at = np.where(to < 0, at, to + (x[rows, self.feature[at]] > self.threshold[at]))
        return 1 / (1 + np.exp(-(total + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Trees for the log-odds of y (0 or 1). Without both labels the score is the share of label 1, smoothed."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    size = 2 ** (depth + 1) - 1
    if len(np.unique(y)) < 2:
        trees = 0
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])] if trees else []
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1) if trees else None
    out = {"feature": np.zeros(trees * size, np.int64), "threshold": np.zeros(trees * size), "left": np.full(trees * size, -1, np.int64), "value": np.zeros(trees * size)}
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, weight = y - p, p * (1 - p)
        node, levels = np.zeros(len(y), np.int64), [0]
        for level in range(depth + 1):
            grown = []
            width = len(levels)
            where = np.full(size, -1)
            where[levels] = np.arange(width)
            slot = where[node]
            on = slot >= 0
            g_all, h_all = np.bincount(slot[on], grad[on], width), np.bincount(slot[on], weight[on], width)
            gain, best = np.full(width, 1e-6), [None] * width
            for j, c in enumerate(cuts if level < depth else []):
                if not len(c):
                    continue
                key = slot[on] * bins + binned[on, j]
                g = np.bincount(key, grad[on], width * bins).reshape(width, bins).cumsum(1)[:, :-1]
                h = np.bincount(key, weight[on], width * bins).reshape(width, bins).cumsum(1)[:, :-1]
                rg, rh = g_all[:, None] - g, h_all[:, None] - h
                now = g**2 / (h + RIDGE) + rg**2 / (rh + RIDGE) - (g_all**2 / (h_all + RIDGE))[:, None]
                now[(h < LEAST_WEIGHT) | (rh < LEAST_WEIGHT)] = 0
                now = now[:, : len(c)]
                k = now.argmax(1)
                for i in np.flatnonzero(now[np.arange(width), k] > gain):
                    gain[i], best[i] = now[i, k[i]], (j, int(k[i]))
            for i, at in enumerate(levels):
                if best[i] is None:
                    out["value"][t * size + at] = RATE * g_all[i] / (h_all[i] + RIDGE)
                    continue
                j, k = best[i]
                to = 2 * at + 1
                out["feature"][t * size + at], out["threshold"][t * size + at], out["left"][t * size + at] = j, cuts[j][k], t * size + to
                mine = node == at
                node[mine] = to + (binned[mine, j] > k)
                grown += [to, to + 1]
            levels = grown
            if not levels:
                break
        margin += out["value"][t * size + node]
    return Trees(**out, size=size, base=base, depth=depth)


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int) -> DataFrame:
    """(doc_id, text, y) of the documents that the labels outside the held-out fold name.

    `rows` labels at most are chosen, those of the smallest seeded hashes, and broadcast. Ids or labels that are null
    are left out; where an id has several labels, its largest counts. A doc_id that repeats gives all its rows, so they
    are reduced to one before the driver gets them.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold != held)).groupBy("doc_id").agg(F.max(label).alias("y"))
    own = own.orderBy(F.xxhash64(F.lit(42), "doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("doc_id", "text", F.col("y").cast("double").alias("y"))


def one_of_each_id(measured: DataFrame) -> DataFrame:
    """One row (doc_id, y, x) of each doc_id, the least x of those that repeat it: no more rows than chosen labels."""
    return measured.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("x").alias("x"))


def is_held_out(folds: int, held: int):
    """Whether crc32 of the id as text leaves the remainder; a null id is held out by no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Trees:
    """A model of `quality`, from statistics that executors compute; the driver gets one row of each chosen label's id."""

    @F.pandas_udf("array<double>")
    def measured(text: pd.Series) -> pd.Series:
        return text.map(statistics)

    own = labelled(docs, labels, "quality", 5, 0, rows).select("doc_id", "y", measured("text").alias("x"))
    got = one_of_each_id(own).toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), float) if len(got) else np.zeros((0, len(statistics(None))))
    return fit(x, got["y"].to_numpy(float))


def scored(docs: DataFrame, model: Trees) -> DataFrame:
    """All columns of `docs` plus `_score`, which replaces a column of that name."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([statistics(t) for t in texts], float).reshape(len(texts), -1)
            yield pd.Series(np.concatenate([model.score(x[i : i + 1024]) for i in range(0, len(x), 1024)]) if len(x) else [], dtype=float)

    return docs.withColumn("_score", score("text"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: (doc_id, held_out, score, predicted). Null and empty texts get a score like any other.

    Only labels of doc_ids outside the held-out fold are learned; without any the score is 0.5. Empty in, empty out.
    """
    found = scored(docs.select("doc_id", "text"), train(docs, labels))
    return found.select("doc_id", is_held_out(5, 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
