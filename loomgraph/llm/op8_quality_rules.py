"""Quality rules on repetition, by suffix arrays over words.

The words of each document are sorted by their suffixes (prefix doubling, many documents in one
array, none of which compares with another), and the longest common prefix of neighbours gives the
intervals of the suffix array. The deepest interval that holds a suffix has the longest repeated
string that starts there; all maximal repeated strings together cover just what these strings cover.
A document goes if the repeated strings of MIN_WORDS words or more cover too much of it, or if the
longest is too long. It also goes if these and shorter repeats together cover over MAX_SHORT of it.
Of the shorter ones count tandem repeats, whose occurrences overlap or touch and share SHORT_WORDS
words or more (a word said four times), and strings of as many words and SCATTERED_CHARS characters
that occur three times; a short line that is there twice is no fault.

Words are runs without white space. A run of over LONG_WORD bytes is compared by character, so that
text without spaces has repeats too; there BYTES_A_WORD bytes count as a word wherever words are
counted, so a link or a name just beyond LONG_WORD is judged as one just below. Lengths are in characters, white space
between the words of a repeat included; the covered fraction is that of characters other than white
space. The two occurrences of a repeat may overlap, as in a word said a hundred times.

Cases: null, empty and blank texts have no repeat, a fraction of 0, and stay. Texts are taken whole.
A value at a limit stays. Each row, repeated or not, is judged alone, and a null doc_id is passed on.
An empty table gives an empty result. Only the named columns are read; `keep_documents` passes all
columns on, whatever their names. Words compare by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import named, text_chunks
from .kernels import Texts, by_doc, hashes, split_long, words

MIN_WORDS = 16
SHORT_WORDS = 3
SCATTERED_CHARS = 32
LONG_WORD = 64
BYTES_A_WORD = 6
MAX_COVERED = 0.3
MAX_SHORT = 0.5
MAX_LONGEST = 1000
#: Primes and bases of the hashes of stretches of words.
_HASH = ((2147483647, 1190494759), (2147483629, 1534836661))


def _common(tokens: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of positions with equal tokens, how many are equal from there on; the later one stays before end.

    Stretches compare by polynomial hashes modulo two primes, whose prefix sums and powers are all
    that is held: 24 bytes a word, however long the repeats are.
    """
    n = len(tokens)
    sums, powers = [], []
    for prime, base in _HASH:
        power = np.ones(n + 1, dtype=np.uint64)
        size = 1
        while size <= n:  # the powers double
            step = np.uint64(pow(base, size, prime))
            power[size : 2 * size] = power[: min(size, n + 1 - size)] * step % np.uint64(prime)
            size *= 2
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(tokens % np.uint64(prime) * power[:n] % np.uint64(prime), out=total[1:])
        total %= np.uint64(prime)
        sums.append(total.astype(np.uint32))
        powers.append(power.astype(np.uint32))
    low, high = np.minimum(a, b), np.maximum(a, b)
    common, room = np.ones(len(a), dtype=np.int64), end - high

    def same(i: np.ndarray, length: int) -> np.ndarray:
        """Whether the pairs i are equal in the length tokens after those known."""
        out = np.ones(len(i), dtype=bool)
        x, y = low[i] + common[i], high[i] + common[i]
        for (prime, _), total, power in zip(_HASH, sums, powers):
            p = np.uint64(prime)
            of = lambda at: (total[at + length].astype(np.uint64) + p - total[at]) % p
            out &= of(x) * power[y - x] % p == of(y)
        return out

    open_, length = np.arange(len(a)), 1
    while len(open_):  # longer and longer stretches, while they are equal
        open_ = open_[common[open_] + length <= room[open_]]
        open_ = open_[same(open_, length)]
        common[open_] += length
        length *= 2
    while length > 1:  # then what is left, in halves
        length //= 2
        fits = np.flatnonzero(common + length <= room)
        common[fits[same(fits, length)]] += length
    return common


def repeats(tokens: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the lengths of the longest strings that start there and occur twice and three times in its document."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((tokens, doc))
    t, d = tokens[order], doc[order]
    new = np.ones(n, dtype=bool)
    new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.full(n + 1, -1, dtype=np.int64)
    rank[order] = head
    width = 1
    ends = np.append(new[1:], True)
    slots = np.flatnonzero(~(new & ends))  # slots of groups that aren't sorted out
    while len(slots):
        at = order[slots]
        key = rank[at] * (n + 1) + rank[np.minimum(at + width, n)] + 1  # beyond the document another's rank: none equal
        sort = np.argsort(key, kind="stable")
        at, key = at[sort], key[sort]
        order[slots] = at
        first = np.ones(len(at), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        rank[at] = slots[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        width *= 2
        slots = slots[~(first & np.append(first[1:], True))]
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((tokens[a] == tokens[b]) & (doc[a] == doc[b]))
    common = _common(tokens, np.searchsorted(doc, doc, side="right")[np.maximum(a[near], b[near])], a[near], b[near])
    prefix = np.zeros(n + 3, dtype=np.int64)  # of the suffix at each slot and the one before, from slot -1 on
    prefix[near + 2] = common
    twice, thrice = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    twice[order] = np.maximum(prefix[1:-2], prefix[2:-1])
    three = np.minimum(prefix[:-1], prefix[1:])  # of the suffixes at each slot and the two before
    thrice[order] = np.maximum(np.maximum(three[:-2], three[1:-1]), three[2:])
    return twice, thrice


def longest_repeats(tokens: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position the length of the longest string that starts there and also elsewhere in its document."""
    return repeats(tokens, doc)[0]


def _tandem(tokens: np.ndarray, doc: np.ndarray, weight: np.ndarray, periods: range, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of all stretches that repeat themselves after one of the periods, for that long and a weight of least or more."""
    start, end = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in periods:
        if p >= len(tokens):
            break
        same = np.zeros(len(tokens) - p + 2, dtype=bool)
        same[1:-1] = (tokens[p:] == tokens[:-p]) & (doc[p:] == doc[:-p])
        border = np.flatnonzero(same[1:] != same[:-1])
        a, b = border[::2], border[1::2]
        long = (b - a >= p) & (weight[b] - weight[a] >= least)
        start.append(a[long])
        end.append(b[long] + p)
    return np.concatenate(start), np.concatenate(end)


def _inside(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n positions lie in one of the stretches."""
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, end, -1)
    return np.cumsum(cover[:-1]) > 0


def measure_all(texts: Texts, min_words: int = MIN_WORDS, long_word: int = LONG_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document the covered fraction, that with short repeats, and the length of the longest repeat."""
    count = len(texts)
    w, joined = split_long(texts, words(texts), long_word)
    n = len(w.start)
    if not n:
        return np.zeros(count), np.zeros(count), np.zeros(count, np.int64)
    tokens = hashes(texts.data, w)
    length, thrice = repeats(tokens, w.doc)
    chars = np.zeros(len(texts.data) + 1, dtype=np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=chars[1:])
    part = joined | np.append(False, joined[:-1])  # characters of a long run
    weight = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.where(part, w.end - w.start, BYTES_A_WORD), out=weight[1:])
    first = np.arange(n)
    at = np.flatnonzero((length > 0) & (weight[first + length] - weight[:-1] >= min_words * BYTES_A_WORD))
    long = _inside(n, at, at + length[at])
    often = np.flatnonzero((thrice > 0) & (weight[first + thrice] - weight[:-1] >= SHORT_WORDS * BYTES_A_WORD))
    often = often[chars[w.end[often + thrice[often] - 1]] - chars[w.start[often]] >= SCATTERED_CHARS]
    short = long | _inside(n, often, often + thrice[often]) | _inside(n, *_tandem(tokens, w.doc, weight, range(1, min_words), SHORT_WORDS * BYTES_A_WORD))
    size = chars[w.end] - chars[w.start]
    total = by_doc(size, w.doc, count)
    share = lambda inside: np.divide(by_doc(size * inside, w.doc, count), total, out=np.zeros(count), where=total > 0)
    longest = np.zeros(count, dtype=np.int64)
    np.maximum.at(longest, w.doc[at], chars[w.end[at + length[at] - 1]] - chars[w.start[at]])
    return share(long), share(short), longest


def measure(texts: Texts, min_words: int = MIN_WORDS, long_word: int = LONG_WORD) -> tuple[np.ndarray, np.ndarray]:
    """For each document the covered fraction and the length of the longest repeat."""
    covered, _, longest = measure_all(texts, min_words, long_word)
    return covered, longest


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, long_word: int = LONG_WORD, max_short: float = MAX_SHORT) -> DataFrame:
    """(id_col, covered_fraction, longest_repeat, short_fraction, keep) for each row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches):
            covered, short, longest = measure_all(Texts.of(b.column(1)), min_words, long_word)
            keep = (covered <= max_covered) & (longest <= max_longest) & (short <= max_short)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(covered), pa.array(longest), pa.array(short), pa.array(keep)], ["id", "covered_fraction", "longest_repeat", "short_fraction", "keep"])

    source = df.select(named(id_col).alias("id"), named(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, covered_fraction double, longest_repeat bigint, short_fraction double, keep boolean").withColumnRenamed("id", id_col)


def keep_documents(df: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, long_word: int = LONG_WORD, max_short: float = MAX_SHORT) -> DataFrame:
    """The rows of df that the rules keep, with all columns."""
    at = df.columns.index(text_col)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # whatever the names, dots in them included

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, f"c{at}"):
            covered, short, longest = measure_all(Texts.of(b.column(at)), min_words, long_word)
            yield b.filter(pa.array((covered <= max_covered) & (longest <= max_longest) & (short <= max_short)))

    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)
