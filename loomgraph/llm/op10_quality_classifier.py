"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each document becomes a row of statistics (FEATURES): shares of character classes, entropy, word
lengths, distinct and repeated words, line lengths. Trees are grown on the logistic loss by
histograms of binned statistics, on at most MAX_TRAIN labelled rows: those of the least MD5 of their
doc_id, so the sample is the same on every run. All trees lie flattened in arrays of node feature,
threshold, children and value, and a batch of documents walks all trees at once in NumPy.

Cases: a null text counts as empty, and empty texts have a score like others. Texts are taken whole.
Labels with a null doc_id or quality, and labels of no document, are not used; a document labelled
twice is used twice. Where several rows share a labelled doc_id, the one of the least statistics
stands for them in training, so the training rows are never more than MAX_TRAIN. If the labels are none the score is 0.5, and if all are one class it is near
that class. A value on a threshold goes left; a score on CUT keeps. Each row, repeated or not, has
its score; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digest_int, named, text_chunks
from .kernels import Texts, by_doc, hashes, words

MAX_TRAIN = 20_000
TREES, DEPTH, BINS = 60, 5, 64
RATE, RIDGE, MIN_HESSIAN = 0.2, 1.0, 2.0
CUT = 0.5

FEATURES = (
    "log_chars", "log_words", "mean_word", "wide_words", "letters", "upper", "digits", "spaces", "marks", "symbols", "not_ascii", "lines",
    "entropy", "distinct_words", "top_word", "same_as_before", "bare_words", "ends_marked", "mean_line",
)

_CLASS = np.zeros((256, 8))
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = [
        _b >= 128 or _c.isalpha(), _b < 128 and _c.isupper(), _b < 128 and _c.isdigit(), _c in " \t\r\x0b\x0c", _c in ".,;:!?'\"()-",
        _b > 32 and _b < 127 and not _c.isalnum() and _c not in ".,;:!?'\"()-", _b >= 128, _c == "\n",
    ]
_LETTER, _MARK = _CLASS[:, 0] > 0, (_CLASS[:, 4] + _CLASS[:, 5]) > 0


def statistics(texts: Texts) -> np.ndarray:
    """A row of FEATURES for each document."""
    n = len(texts)
    size = np.diff(texts.offsets)
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * 256 + texts.data, minlength=n * 256).reshape(n, 256)
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    classes = counts @ _CLASS
    p = counts / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    w = words(texts)
    many = by_doc(np.ones(len(w.doc)), w.doc, n)
    out = [np.log1p(size), np.log1p(many)]
    if len(w.start):
        length = (w.end - w.start).astype(float)
        h = hashes(texts.data, w)
        letters = np.concatenate(([0], np.cumsum(_LETTER[texts.data])))
        bare = letters[w.end] == letters[w.start]
        marked = _MARK[texts.data[w.end - 1]]
        again = np.append(False, (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1]))
        low = np.uint64((1 << 44) - 1)
        key = np.sort((w.doc.astype(np.uint64) << np.uint64(44)) | (h & low))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        of = (key[first] >> np.uint64(44)).astype(np.int64)
        times = np.diff(np.append(first, len(key)))
        top = np.zeros(n)
        np.maximum.at(top, of, times)
        columns = [by_doc(length, w.doc, n), by_doc(length > 20, w.doc, n), by_doc(np.ones(len(of)), of, n), top, by_doc(again, w.doc, n), by_doc(bare, w.doc, n), by_doc(marked, w.doc, n)]
    else:
        columns = [np.zeros(n)] * 7
    mean, wide, distinct, top, again, bare, marked = (share(c, many) for c in columns)
    by_class = [share(classes[:, k], size) for k in range(8)]
    return np.stack([*out, mean, wide, *by_class, entropy, distinct, top, again, bare, marked, np.log1p(share(size, classes[:, 7] + 1))], axis=1)


@dataclass
class Trees:
    """All trees in flat arrays; a leaf is its own child. A score is the logistic of base plus the leaves' values."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))
        for i in range(0, len(rows), 1024):
            x = rows[i : i + 1024]
            at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
            line = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                at = np.where(x[line, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out[i : i + 1024] = 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))
        return out


def train(rows: np.ndarray, label: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Grow trees level by level on histograms."""
    n, width = len(rows), len(FEATURES) if not len(rows) else rows.shape[1]
    positive = float(label.sum())
    base = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    if not 0 < positive < n:
        trees = 0
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)] if trees else []
    binned = np.stack([np.searchsorted(edges[f], rows[:, f], side="left") for f in range(width)], axis=1) if trees else None
    margin = np.full(n, base)

    def leaf(v: float) -> int:
        i = len(feature)
        for column, x in ((feature, 0), (threshold, 0.0), (left, i), (right, i), (value, v)):
            column.append(x)
        return i

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - label, np.maximum(p * (1 - p), 1e-9)
        roots.append(leaf(0.0))
        at = np.full(n, roots[-1])
        level = [roots[-1]]
        for deep in range(depth + 1):
            slot = np.full(len(feature), -1)
            slot[level] = np.arange(len(level))
            of = slot[at]
            live = of >= 0
            gs, hs = (np.bincount(of[live], weights=v[live], minlength=len(level)) for v in (g, h))
            for k, node in enumerate(level):
                value[node] = float(-RATE * gs[k] / (hs[k] + RIDGE))
            if deep == depth:
                break
            best = np.full(len(level), 1e-6)
            split: list = [None] * len(level)
            for f in range(width):
                m = len(edges[f]) + 1
                key = of[live] * m + binned[live, f]
                gl, hl = (np.bincount(key, weights=v[live], minlength=len(level) * m).reshape(-1, m).cumsum(axis=1)[:, :-1] for v in (g, h))
                gr, hr = gs[:, None] - gl, hs[:, None] - hl
                gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - (gs**2 / (hs + RIDGE))[:, None]
                gain[(hl < MIN_HESSIAN) | (hr < MIN_HESSIAN)] = -1
                if not gain.shape[1]:
                    continue
                top = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(len(level)), top] > best):
                    best[k] = gain[k, top[k]]
                    split[k] = (f, int(top[k]))
            following = []
            for k, node in enumerate(level):
                if split[k]:
                    f, b = split[k]
                    feature[node], threshold[node] = f, float(edges[f][b])
                    left[node], right[node], value[node] = leaf(0.0), leaf(0.0), 0.0
                    following += [left[node], right[node]]
                    own = at == node
                    at[own] = np.where(binned[own, f] <= b, left[node], right[node])
            level = following
            if not level:
                break
        margin += np.array(value)[at]
    array = lambda x, kind: np.array(x, dtype=kind)
    return Trees(base, array(roots, np.int64), array(feature, np.int64), array(threshold, float), array(left, np.int64), array(right, np.int64), array(value, float), depth)


def _statistics(df: DataFrame, extra: list[str]) -> DataFrame:
    """extra columns and the statistics x of the column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches):
            x = statistics(Texts.of(b.column(0)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], lists], [*extra, "x"])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in extra)
    return df.select("text", *extra).mapInArrow(run, f"{kinds}, x array<double>")


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> Trees:
    """Trees for the labels, of which at most max_train are used."""
    known = labels.where(named(id_col).isNotNull() & named(label_col).isNotNull()).select(named(id_col).alias("id"), named(label_col).cast("int").alias("y"))
    some = known.orderBy(digest_int(F.col("id").cast("string")), "id", "y").limit(max_train).groupBy("id", "y").agg(F.count("*").alias("n"))
    texts = df.select(named(id_col).alias("id"), named(text_col).alias("text"))
    joined = texts.join(F.broadcast(some), "id")  # max_train rows of three numbers at most
    one = _statistics(joined, ["id", "y", "n"]).groupBy("id", "y", "n").agg(F.min("x").alias("x"))  # as many rows as some has, combined before the shuffle
    found = one.toPandas()
    rows = np.array(found["x"].tolist(), dtype=float).reshape(len(found), len(FEATURES))
    label, often = found["y"].to_numpy(dtype=float), found["n"].to_numpy(dtype=np.int64)
    order = np.lexsort((*rows.T[::-1], label, found["id"].to_numpy())) if len(found) else np.zeros(0, np.int64)
    order = np.repeat(order, often[order])
    return train(rows[order], (label[order] > 0).astype(float))


def score(df: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """(id_col, score, keep) for each row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches):
            s = trees.score(statistics(Texts.of(b.column(1))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(s >= cut)], ["id", "score", "keep"])

    source = df.select(named(id_col).alias("id"), named(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, score double, keep boolean").withColumnRenamed("id", id_col)


def classify(df: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, score, keep) by trees fitted on the labels."""
    return score(df, fit(df, labels, max_train=max_train))
