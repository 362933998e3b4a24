"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the whole text alone. Trees of logistic loss are grown level by level from histograms of at most BINS
quantile bins; all trees are flattened into arrays (feature, threshold, left, right, value) that numpy walks for all rows and
trees at once.

The model is fitted on at most SAMPLE labelled rows, those with the smallest hash of their doc_id (a documented bound of the
learning sample; scoring covers every row). Rows without a label or text teach nothing. With no learning row the score is 0.5, with
one class it is near that class. Null counts as an empty text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import thrifty, whole

SAMPLE = 20_000
TREES, DEPTH, RATE, BINS = 120, 5, 0.1, 64
LEAST_HESSIAN, PENALTY = 5.0, 1.0
THRESHOLD = 0.7

_ASCII = np.arange(256)
_CLASSES = np.stack([
    (_ASCII >= 65) & (_ASCII <= 90),
    (_ASCII >= 97) & (_ASCII <= 122),
    (_ASCII >= 48) & (_ASCII <= 57),
    np.isin(_ASCII, list(b" \t\n\x0b\x0c\r")),
    np.isin(_ASCII, list(b".,;:?'\"()-")),
    np.isin(_ASCII, list(b"#$%&*+/<=>@[\\]^_`{|}~")),
    _ASCII == 33,
    _ASCII == 124,
    (_ASCII >= 128) & (_ASCII < 192),
    _ASCII >= 192,
    _ASCII < 32,
]).astype(float).T
_SYMBOL = _CLASSES[:, 5] + _CLASSES[:, 6] > 0

STATISTICS = (
    "log_chars", "log_words", "upper", "lower", "digits", "blanks", "points", "symbols", "exclamations", "bars", "non_ascii", "controls",
    "double_symbols", "entropy", "mean_word", "spread_word", "log_longest_word", "short_words", "distinct_words", "top_word",
    "capital_words", "upper_words", "ends_symbol", "ends_sentence", "words_per_sentence", "repeated_runs", "log_lines", "mean_line",
    "repeated_lines", "short_lines", "closed_lines",
)


def statistics(text: str | None) -> list[float]:
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(data, minlength=256)
    n = len(text)
    upper, lower, digit, blank, point, symbol, bang, bar, _, lead, control = counts @ _CLASSES
    share = 1 / max(n, 1)
    doubled = int(np.count_nonzero((data[1:] == data[:-1]) & _SYMBOL[data[1:]])) if len(data) > 1 else 0
    p = counts[counts > 0] / max(len(data), 1)
    words = text.split()
    w = len(words)
    lens = np.fromiter(map(len, words), np.int64, w)
    each = 1 / max(w, 1)
    seen = Counter(words)
    runs = max(w - 3, 0)
    distinct_runs = len(set(zip(words, words[1:], words[2:], words[3:]))) if runs else 0
    ends = [x[-1] for x in words]
    sentences = sum(e in ".!?" for e in ends)
    lines = text.split("\n")
    filled = [x for x in map(str.strip, lines) if x]
    line_share = 1 / max(len(filled), 1)
    return [
        np.log1p(n), np.log1p(w), upper * share, lower * share, digit * share, blank * share, point * share, symbol * share,
        bang * share, bar * share, lead * share, control * share, doubled * share, float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
        lens.mean() if w else 0.0, lens.std() if w else 0.0, np.log1p(lens.max()) if w else 0.0,
        np.count_nonzero(lens <= 3) * each, len(seen) * each, max(seen.values(), default=0) * each,
        sum(x[0].isupper() for x in words) * each, sum(len(x) > 1 and x.isupper() for x in words) * each,
        sum(not e.isalnum() and e not in ".,;:!?" for e in ends) * each, sentences * each, w / max(sentences, 1),
        1 - distinct_runs / runs if runs else 0.0, np.log1p(len(lines)), np.log1p(n / len(lines)),
        1 - len(set(filled)) * line_share if filled else 0.0, sum(len(x) < 30 for x in filled) * line_share,
        sum(x[-1] in ".!?" for x in filled) * line_share,
    ]


@dataclass
class Trees:
    """All trees in one set of arrays; a leaf points to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees; the first of equally good splits is taken, so a fit is a function of the rows and their order."""
    n, features = x.shape if x.size else (0, len(STATISTICS))
    rate = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(rate / (1 - rate)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(features)]
        bins = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1)
        raw = np.full(n, base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            roots.append(_grow(bins, cuts, y - p, p * (1 - p), nodes, raw))
    table = np.array(nodes or [[0, 0, 0, 0, 0]])
    return Trees(base, np.array(roots, int), table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4])


def _grow(bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, nodes: list, raw: np.ndarray) -> int:
    """Add one tree to ``nodes``, level by level, and its values to ``raw``; the index of its root."""

    def leaf(g_sum: float, h_sum: float) -> int:
        i = len(nodes)
        nodes.append([0, 0.0, i, i, RATE * g_sum / (h_sum + PENALTY)])
        return i

    root = leaf(g.sum(), h.sum())
    at, open_ = np.full(len(g), root), [root]
    for _ in range(DEPTH):
        place = np.full(len(nodes), -1)
        place[open_] = np.arange(len(open_))
        rows = np.flatnonzero(place[at] >= 0)
        k = place[at[rows]]
        gain, choice = np.full(len(open_), 1e-9), [None] * len(open_)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            cell = k * BINS + bins[rows, f]
            gs, hs = (np.bincount(cell, v[rows], len(open_) * BINS).reshape(-1, BINS).cumsum(1) for v in (g, h))
            gt, ht = gs[:, -1:], hs[:, -1:]
            gr, hr = gt - gs, ht - hs
            better = gs**2 / (hs + PENALTY) + gr**2 / (hr + PENALTY) - gt**2 / (ht + PENALTY)
            better[(hs < LEAST_HESSIAN) | (hr < LEAST_HESSIAN)] = 0
            better[:, len(c):] = 0
            best = better.argmax(1)
            for i in np.flatnonzero(better[np.arange(len(open_)), best] > gain):
                gain[i], choice[i] = better[i, best[i]], (f, int(best[i]), gs[i, best[i]], hs[i, best[i]], gr[i, best[i]], hr[i, best[i]])
        grown = []
        for i, split in enumerate(choice):
            if split is None:
                continue
            f, b, g_left, h_left, g_right, h_right = split
            low, high = leaf(g_left, h_left), leaf(g_right, h_right)
            nodes[open_[i]][:4] = [f, cuts[f][b], low, high]
            mine = rows[k == i]
            at[mine] = np.where(bins[mine, f] <= b, low, high)
            grown += [low, high]
        open_ = grown
        if not open_:
            break
    raw += np.array([v[4] for v in nodes[root:]])[at - root]
    return root


def teach(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees fitted to ``labels`` (doc_id, label 0 or 1) of ``docs`` (doc_id, text): at most ``sample`` rows, by hash."""
    known = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    chosen = known.select(F.col("doc_id").alias("_id"), "label", F.xxhash64("doc_id").alias("_hash")).orderBy(
        "_hash", "_id", "label").limit(sample)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")  # other columns may have any name
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select(
        "doc_id", "text", F.col("label").cast("double").alias("label"), "_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), pa.array(x, pa.list_(pa.float64()))],
                                  ["id", "label", "_hash", "x"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    # A doc_id may hold several rows: the bound holds for what comes to the driver too.
    found = rows.mapInArrow(thrifty(run), f"id {kind}, label double, _hash long, x array<double>").orderBy("_hash", "id", "label", "x").limit(sample).toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
    return fit(x, found.column("label").to_numpy())


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """``docs`` (text and more; no column named score) without text and with score: how likely its label is 1."""
    model = docs.sparkSession.sparkContext.broadcast(trees)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(at).to_pylist()], float).reshape(-1, len(STATISTICS))
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.record_batch([*columns, pa.array(model.value.score(x), pa.float64())], [*names, "score"])

    return docs.mapInArrow(thrifty(run), docs.drop("text").withColumn("score", F.lit(0.0)).schema)


def select_good(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (text and more) that score at least ``threshold``, with all their columns, in one pass."""
    model = docs.sparkSession.sparkContext.broadcast(trees)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(at).to_pylist()], float).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(model.value.score(x) >= threshold))

    return docs.mapInArrow(thrifty(run), docs.schema)
