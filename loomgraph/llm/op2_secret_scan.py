"""Secret scans by a battery of randomness tests.

Candidates are the maximal runs of MIN_LENGTH or more letters, digits and + / - _. For each the
smallest alphabet that holds all its characters is its inferred encoding. The null hypothesis is
that the run is ordinary text written in that alphabet; what ordinary text looks like is measured
on the pairs of neighbouring characters in all shorter runs of the whole corpus, so that secrets
don't blur it. Three tests ask how much nearer to
uniform random symbols a run is than such text would be:

* chi-squared uniformity over the alphabet, against the noncentral distribution that the letter
  frequencies of the corpus imply (normal, with its mean and variance);
* runs: changes of character class (case, digit, sign; halves of the alphabet where it has one
  class), against the binomial with the corpus's rate of changes;
* serial correlation of neighbouring symbols, against its mean and spread in the corpus.

Fisher's method joins the three. Short runs have little power and there are many of them, long ones
the reverse, so false discoveries are controlled at ALPHA by the Benjamini-Hochberg rule within
each stratum of length. P-values are rounded up to a grid, which keeps them valid, so the rule needs
only counts by stratum and grid level: a table of bounded size, whatever the corpus.

An alphabet that the corpus hardly uses in one case is judged by its letters in either. Of a corpus
without any run that is too short for a candidate nothing is known, and nothing is found.

Cases: null and empty texts have no candidates. Texts are taken whole; a run of any length is one
candidate. Equal p-values are found or not found together. Each row, repeated or not, is scanned,
and counts. A null doc_id is passed on. An empty table gives an empty result. Only the named columns
are read. Runs of fewer than MIN_LENGTH characters (short passwords) are not tested: at that length
ordinary words can't be told from random symbols.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, store, text_chunks
from .kernels import Texts, runs

MIN_LENGTH = 16
ALPHA = 0.005
STRATA = (16, 20, 24, 32, 48, 80, 160)
#: Grid levels for each factor of ten of a p-value, and the least p-value told apart.
GRID, LEAST = 64, 1e-300
#: Runs up to this long have their binomial tails in a table; all tables together hold a few MB.
TABLE = 256

_D, _L, _U = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: By size, so that the first that holds a run is the smallest.
ALPHABETS = {
    "decimal": _D, "hex": _D + _L[:6], "hex-upper": _D + _U[:6], "lower": _L, "upper": _U, "base32": _U + _D[2:8], "lower36": _D + _L, "upper36": _D + _U,
    "letters": _U + _L, "base62": _U + _L + _D, "base64": _U + _L + _D + "+/", "base64url": _U + _L + _D + "-_", "base66": _U + _L + _D + "+/-_",
}
NAMES = tuple(ALPHABETS)

_HOLDS = np.zeros(256, dtype=np.uint16)
_INDEX = np.zeros((len(NAMES), 256), dtype=np.int64)
_KIND = np.zeros((len(NAMES), 256), dtype=np.int8)
for _k, _name in enumerate(NAMES):
    _signs = ALPHABETS[_name]
    _kinds = [0 if c in _U else 1 if c in _L else 2 if c in _D else 3 for c in _signs]
    if len(set(_kinds)) == 1:
        _kinds = [int(i >= len(_signs) / 2) for i in range(len(_signs))]
    for _i, _c in enumerate(_signs):
        _HOLDS[ord(_c)] |= 1 << _k
        _INDEX[_k, ord(_c)], _KIND[_k, ord(_c)] = _i, _kinds[_i]
_RUN = _HOLDS > 0


def pairs(texts: Texts, min_length: int = MIN_LENGTH) -> np.ndarray:
    """How often each pair of bytes occurs within a run too short for a candidate, as 65,536 counts."""
    d = texts.data
    w = runs(texts, _RUN[d])
    short = (w.end - w.start) < min_length
    step = np.zeros(len(d) + 1, dtype=np.int8)
    step[w.start[short]] = 1
    at_end = w.end[short]
    step[at_end] -= 1  # 0 where the next run starts at once, in the next document
    inside = np.cumsum(step[:-1], dtype=np.int8) > 0
    inside[w.start[short]] = False  # the second of a pair is never the first of its run
    second = np.flatnonzero(inside)
    return np.bincount(d[second - 1].astype(np.int64) * 256 + d[second], minlength=1 << 16)


class Background:
    """What the three statistics are for ordinary text, by alphabet; from counts of pairs."""

    def __init__(self, counts: np.ndarray):
        table = counts.reshape(256, 256).astype(float)
        fold = np.array([b + 32 if ord("A") <= b <= ord("Z") else b for b in range(256)])
        folded = np.zeros((256, 256))
        np.add.at(folded, (fold[:, None], fold[None, :]), table)
        self.excess, self.changes, self.serial, self.spread = [], [], [], []
        for k, name in enumerate(NAMES):
            own = [ord(c) for c in ALPHABETS[name]]
            size = len(own)
            other = folded[np.ix_(fold[own], fold[own])]  # for what the corpus hardly has: as in either case, and a trace of everything
            t = table[np.ix_(own, own)] + other / max(other.sum(), 1.0) + 0.01 / size**2
            t /= t.sum()
            share = (t.sum(axis=0) + t.sum(axis=1)) / 2
            self.excess.append(size * (share**2).sum() - 1)
            kind = _KIND[k][own]
            self.changes.append(float(np.clip(t[kind[:, None] != kind[None, :]].sum(), 0.01, 0.99)))
            x = (np.arange(size) - (size - 1) / 2) / math.sqrt((size**2 - 1) / 12)
            product = x[:, None] * x[None, :]
            mean = float((t * product).sum())
            self.serial.append(mean)
            self.spread.append(float((t * product**2).sum()) - mean**2)


@lru_cache(maxsize=len(NAMES) * TABLE)
def _tails(n: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """P(X <= k) and P(X >= k) for the binomial, k from 0 to n."""
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1)))))
    k = np.arange(n + 1)
    p = np.exp(logs[n] - logs - logs[::-1] + k * math.log(rate) + (n - k) * math.log1p(-rate))
    return np.minimum(np.cumsum(p), 1), np.minimum(np.cumsum(p[::-1])[::-1], 1)


def _beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / d
    total, m = d, 0
    while True:
        m += 1
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d)
            c = 1 + term / c
            total *= c * d
        if abs(c * d - 1) < 1e-13:
            return min(1.0, front * total)


def tail(n: int, rate: float, k: int, up: bool) -> float:
    """P(X >= k) or P(X <= k) for the binomial: from a table for short runs, of which there are many, else on its own."""
    if n <= TABLE:
        return float(_tails(n, rate)[int(up)][k])
    if up:
        return 1.0 if k == 0 else _beta(k, n - k + 1, rate)
    return 1.0 if k == n else _beta(n - k, k + 1, 1 - rate)


_erfc = np.frompyfunc(math.erfc, 1, 1)


def _below(z: np.ndarray) -> np.ndarray:
    """P(Z <= z) for the normal."""
    return np.asarray(_erfc(-z / math.sqrt(2)), dtype=float) / 2


def candidates(texts: Texts, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of each candidate."""
    w = runs(texts, _RUN[texts.data])
    long = (w.end - w.start) >= min_length
    return w.doc[long], w.start[long], w.end[long]


def test(data: np.ndarray, start: np.ndarray, end: np.ndarray, known: Background) -> tuple[np.ndarray, np.ndarray]:
    """Encoding and p-value of each candidate."""
    count = len(start)
    encoding, p = np.zeros(count, np.int64), np.ones(count)
    if not count:
        return encoding, p
    size = end - start
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    chars = data[np.repeat(start - first, size) + np.arange(size.sum())]
    holds = np.bitwise_and.reduceat(_HOLDS[chars], first)
    encoding = np.log2(holds & -holds.astype(np.int32)).astype(np.int64)
    owner = np.repeat(np.arange(count), size)
    for k in np.unique(encoding):
        signs = len(ALPHABETS[NAMES[k]])
        mine = np.flatnonzero(encoding == k)
        place = np.full(count, -1)
        place[mine] = np.arange(len(mine))
        own = place[owner]
        c, own = chars[own >= 0], own[own >= 0]
        index, kind, n = _INDEX[k][c], _KIND[k][c], size[mine].astype(float)
        cells, times = np.unique(own * signs + index, return_counts=True)
        squares = np.bincount(cells // signs, weights=times.astype(float) ** 2, minlength=len(mine))
        chi = signs / n * squares - n
        excess = known.excess[k]
        p_chi = _below((chi - (signs - 1 + (n - 1) * excess)) / np.sqrt(2 * (signs - 1) + 4 * n * excess))
        inside = own[1:] == own[:-1]
        turns = np.bincount(own[1:][inside & (kind[1:] != kind[:-1])], minlength=len(mine))
        rate, shares = known.changes[k], np.bincount(_KIND[k][[ord(x) for x in ALPHABETS[NAMES[k]]]]) / signs
        up = 1 - (shares**2).sum() >= rate
        p_runs = np.array([tail(int(m) - 1, rate, int(t), up) for m, t in zip(n, turns)])
        x = (index - (signs - 1) / 2) / math.sqrt((signs**2 - 1) / 12)
        product = np.bincount(own[1:][inside], weights=(x[1:] * x[:-1])[inside], minlength=len(mine))
        z = (product - (n - 1) * known.serial[k]) / np.sqrt((n - 1) * max(known.spread[k], 1e-6))
        p_serial = _below(z if known.serial[k] > 0 else -z)
        half = -(np.log(np.maximum(p_chi, LEAST)) + np.log(np.maximum(p_runs, LEAST)) + np.log(np.maximum(p_serial, LEAST)))
        p[mine] = np.exp(-half) * (1 + half + half**2 / 2)
    return encoding, np.clip(p, LEAST, 1)


def thresholds(counts: list[tuple[int, int, int]], alpha: float = ALPHA) -> dict[int, int]:
    """The least grid level that is a discovery in each stratum; counts: (stratum, level, candidates)."""
    out = {}
    for stratum in {s for s, _, _ in counts}:
        levels = sorted(((lv, n) for s, lv, n in counts if s == stratum), reverse=True)
        total, so_far = sum(n for _, n in levels), 0
        for lv, n in levels:
            so_far += n
            if 10 ** (-lv / GRID) <= alpha * so_far / total:
                out[stratum] = lv
    return out


def _parts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(named(id_col).alias("id"), named(text_col).alias("text"))


def background(df: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH) -> Background:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for b in text_chunks(batches):
            total += pairs(Texts.of(b.column(0)), min_length)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], ["pair", "n"])

    found = df.select(named(text_col).alias("text")).mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 << 16, dtype=np.int64)
    for pair, n in found:
        counts[pair] = n
    return Background(counts)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, min_length: int = MIN_LENGTH) -> DataFrame:
    """(id_col, position, length, encoding, secret, p_value) for each discovery; positions count characters from 0."""
    known = background(df, text_col, min_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches):
            texts = Texts.of(b.column(1))
            doc, start, end = candidates(texts, min_length)
            encoding, p = test(texts.data, start, end, known)
            chars = np.concatenate(([0], np.cumsum((texts.data & 0xC0) != 0x80)))
            level = np.floor(-np.log10(p) * GRID).astype(np.int64)
            stratum = np.searchsorted(STRATA, end - start, side="right")
            level = np.maximum(level, 0)
            secret = [bytes(texts.data[i:j]).decode() if v >= lowest else None for i, j, v in zip(start, end, level)]
            columns = [b.column(0).take(pa.array(doc)), pa.array(chars[start] - chars[texts.offsets[doc]]), pa.array(end - start), pa.array([NAMES[k] for k in encoding], pa.string()), pa.array(secret, pa.string()), pa.array(p), pa.array(stratum), pa.array(level)]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "position", "length", "encoding", "secret", "p_value", "stratum", "level"]
    lowest = math.floor(-math.log10(alpha) * GRID)  # nothing below is ever a discovery
    source = _parts(df, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    tested = store(source.mapInArrow(run, f"id {kind}, position bigint, length bigint, encoding string, secret string, p_value double, stratum bigint, level bigint"))
    counts = [tuple(r) for r in tested.groupBy("stratum", "level").count().collect()]
    least = thresholds(counts, alpha)
    found = F.lit(False)
    for s, lv in least.items():
        found = found | ((F.col("stratum") == s) & (F.col("level") >= lv))
    return tested.where(found).select(F.col("id").alias(id_col), "position", "length", "encoding", "secret", "p_value")
