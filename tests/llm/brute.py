"""Slow and plain versions of the operators, which the tests hold the real ones against."""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa

from loomgraph.llm import op2_secret_scan as op2
from loomgraph.llm import op5_simhash as op5
from loomgraph.llm import op10_quality_classifier as op10
from loomgraph.llm.kernels import Texts
from loomgraph.llm.vocabulary import DEFAULT_MODEL, SPACE, Vocabulary


@lru_cache(maxsize=1)
def unigram():
    """The vocabulary in another library's unigram decoder."""
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    v = Vocabulary.load(DEFAULT_MODEL)
    scores = {i: s for i, s in v.pieces.values()}
    return Tokenizer(Unigram([(p, scores.get(i, 0.0)) for i, p in enumerate(v.texts)], unk_id=v.unknown, byte_fallback=True))


def encode(text: str) -> list[int]:
    return unigram().encode(SPACE + text.replace(" ", SPACE), add_special_tokens=False).ids if text else []


def model_file(pieces: list[tuple[str, float, int]], prefix: bool = True, squeeze: bool = False, rules: bytes = b"", behind: bool = False, byte_pieces: bool = False) -> bytes:
    """A unigram model for the SentencePiece library, field by field: (piece, score, kind); kind 1 normal, 2 unknown, 6 byte."""

    def number(n: int) -> bytes:
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    part = lambda field, data: number(field << 3 | 2) + number(len(data)) + data
    whole = lambda field, n: number(field << 3) + number(n)
    out = b""
    for piece, score, kind in pieces:
        out += part(1, part(1, piece.encode()) + number(2 << 3 | 5) + struct.pack("<f", score) + whole(3, kind))
    out += part(2, whole(3, 1) + whole(24, int(behind)) + whole(35, int(byte_pieces)))
    return out + part(3, part(1, b"identity") + part(2, rules) + whole(3, int(prefix)) + whole(4, int(squeeze)) + whole(5, 1))


def repeats(text: str | None, min_words: int, long_word: int = 64) -> tuple[float, int]:
    """Covered fraction and longest repeat, from the common prefixes of all pairs of positions."""
    text = text or ""
    words, weight = [], []  # six bytes of a long run weigh as much as a word
    for m in re.finditer(r"[^\x00-\x20]+", text):
        if len(m[0].encode()) > long_word:
            words += [(c, m.start() + i) for i, c in enumerate(m[0])]
            weight += [len(c.encode()) for c in m[0]]
        else:
            words.append((m[0], m.start()))
            weight.append(6)
    n = len(words)
    longest = [0] * n
    below = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        row = [0] * (n + 1)
        for j in range(n - 1, -1, -1):
            if i != j and words[i][0] == words[j][0]:
                row[j] = below[j + 1] + 1
        longest[i] = max(row)
        below = row
    covered, most = set(), 0
    for i, k in enumerate(longest):
        if k and sum(weight[i : i + k]) >= 6 * min_words:
            covered |= set(range(i, i + k))
            word, at = words[i + k - 1]
            most = max(most, at + len(word) - words[i][1])
    size = sum(len(w) for w, _ in words)
    return (sum(len(words[i][0]) for i in covered) / size if size else 0.0), most


def near_copies(docs: list[tuple]) -> dict:
    """{doc_id: the least of its group}, of all pairs of (doc_id, text)."""
    rows = []
    for i, t in docs:
        if i is not None and t is not None:
            doc, f = op5.fingerprints(Texts.of(pa.array([t])))
            if len(doc):
                rows.append((i, [int(x) for x in f[0]]))
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    apart = lambda a, b: (a ^ b).bit_count()
    for k, (i, f) in enumerate(rows):
        for j, g in rows[:k]:
            if min(apart(f[0], g[0]), apart(f[1], g[1])) <= op5.RADIUS and apart(f[2], g[2]) + apart(f[3], g[3]) <= op5.SET_RADIUS:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent if find(i) != i}


def tokens_of(text: str | None) -> int:
    return len([x for x in re.split(r"[ \t\n\r\x0b\x0c]+", text or "") if x])


def mixing(docs: list[tuple], flatten: float) -> list[tuple]:
    """(doc_id, rate, copies) for (doc_id, text, source), each multiplier by bisection."""
    sizes = defaultdict(list)
    for _, t, s in docs:
        if tokens_of(t):
            sizes[s].append(tokens_of(t))
    have = {s: sum(x) for s, x in sizes.items()}
    weight = {s: (h / sum(have.values())) ** flatten for s, h in have.items()}
    total = max((have[s] / w for s, w in weight.items()), default=0)
    scale = sum(have.values()) / max(1, sum(map(len, sizes.values())))
    lam = {}
    for s, own in sizes.items():
        low, high = -50.0, 50.0
        for _ in range(200):
            mid = (low + high) / 2
            over = sum(math.exp(min(600, mid * t / scale)) * t for t in own) > total * weight[s]
            low, high = (low, mid) if over else (mid, high)
        lam[s] = low
    out = []
    for i, t, s in docs:
        n = tokens_of(t)
        rate = math.exp(lam[s] * n / scale) if n else 1.0
        digest = int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:15], 16)
        out.append((i, rate, digest % (1 << 30) / (1 << 30)))
    return [(i, r, math.floor(r) + (part < r - math.floor(r))) for i, r, part in out]


def secrets(docs: list[tuple], alpha: float = op2.ALPHA) -> set[tuple]:
    """(doc_id, position, encoding, secret) of the discoveries among (doc_id, text), test by test."""
    pairs = Counter()
    found = []
    for i, t in docs:
        for m in re.finditer(r"[A-Za-z0-9+/_-]+", t or ""):
            if len(m[0]) < op2.MIN_LENGTH:
                pairs.update(zip(m[0], m[0][1:]))
            if len(m[0]) >= op2.MIN_LENGTH:
                found.append((i, m.start(), next(n for n, a in op2.ALPHABETS.items() if set(m[0]) <= set(a)), m[0]))

    folded = Counter()
    for (a, b), n in pairs.items():
        folded[a.lower(), b.lower()] += n

    def kinds(signs):
        kind = {c: "U" if c.isupper() else "L" if c.islower() else "D" if c.isdigit() else "S" for c in signs}
        return kind if len(set(kind.values())) > 1 else {c: int(k >= len(signs) / 2) for k, c in enumerate(signs)}

    @lru_cache(maxsize=None)
    def known(name):
        signs = op2.ALPHABETS[name]
        m, kind = len(signs), kinds(signs)
        other = {(a, b): folded[a.lower(), b.lower()] for a in signs for b in signs}
        t = {(a, b): pairs[a, b] + other[a, b] / max(1, sum(other.values())) + 0.01 / m**2 for a in signs for b in signs}
        whole = sum(t.values())
        share = {c: sum(t[c, d] + t[d, c] for d in signs) / 2 / whole for c in signs}
        x = {c: (k - (m - 1) / 2) / math.sqrt((m * m - 1) / 12) for k, c in enumerate(signs)}
        changes = sum(v for (a, b), v in t.items() if kind[a] != kind[b]) / whole
        mean = sum(v * x[a] * x[b] for (a, b), v in t.items()) / whole
        spread = sum(v * (x[a] * x[b]) ** 2 for (a, b), v in t.items()) / whole - mean**2
        return m, kind, x, m * sum(s * s for s in share.values()) - 1, min(0.99, max(0.01, changes)), mean, spread

    below = lambda z: math.erfc(-z / math.sqrt(2)) / 2
    scored = []
    for i, at, name, s in found:
        m, kind, x, excess, rate, mean, spread = known(name)
        n = len(s)
        chi = m / n * sum(k * k for k in Counter(s).values()) - n
        p = [below((chi - (m - 1 + (n - 1) * excess)) / math.sqrt(2 * (m - 1) + 4 * n * excess))]
        turns = sum(kind[a] != kind[b] for a, b in zip(s, s[1:]))
        even = 1 - sum((k / m) ** 2 for k in Counter(kind.values()).values())
        terms = [math.comb(n - 1, k) * rate**k * (1 - rate) ** (n - 1 - k) for k in range(n)]
        p.append(min(1, sum(terms[turns:]) if even >= rate else sum(terms[: turns + 1])))
        z = (sum(x[a] * x[b] for a, b in zip(s, s[1:])) - (n - 1) * mean) / math.sqrt((n - 1) * max(spread, 1e-6))
        p.append(below(z if mean > 0 else -z))
        half = -sum(math.log(max(q, op2.LEAST)) for q in p)
        joint = min(1, max(op2.LEAST, math.exp(-half) * (1 + half + half**2 / 2)))
        level = max(0, math.floor(-math.log10(joint) * op2.GRID))
        scored.append((sum(n >= b for b in op2.STRATA), level, (i, at, name, s)))
    out = set()
    for stratum in {a for a, _, _ in scored}:
        own = sorted(((lv, what) for a, lv, what in scored if a == stratum), reverse=True, key=lambda q: q[0])
        least = [lv for lv, _ in own if 10 ** (-lv / op2.GRID) <= alpha * sum(o >= lv for o, _ in own) / len(own)]
        out |= {what for lv, what in own if least and lv >= min(least)}
    return out


def trees(rows: np.ndarray, label: np.ndarray, trees: int, depth: int, bins: int) -> tuple[float, list]:
    """(base, nested trees) grown by trying each bin border as a split of each node, row by row."""
    n, width = rows.shape
    base = math.log((label.sum() + 0.5) / (n - label.sum() + 0.5))
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    margin = [base] * n

    def grow(own: list[int], g: list, h: list, deep: int):
        gs, hs = sum(g[i] for i in own), sum(h[i] for i in own)
        leaf = -op10.RATE * gs / (hs + op10.RIDGE)
        best, split = 1e-6, None
        if deep < depth:
            for f in range(width):
                for cut in edges[f]:
                    left = [i for i in own if rows[i, f] <= cut]
                    gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                    if min(hl, hs - hl) < op10.MIN_HESSIAN:
                        continue
                    gain = gl**2 / (hl + op10.RIDGE) + (gs - gl) ** 2 / (hs - hl + op10.RIDGE) - gs**2 / (hs + op10.RIDGE)
                    if gain > best + 1e-12:
                        best, split = gain, (f, float(cut))
        if split is None:
            return leaf
        f, cut = split
        return f, cut, grow([i for i in own if rows[i, f] <= cut], g, h, deep + 1), grow([i for i in own if rows[i, f] > cut], g, h, deep + 1)

    out = []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        out.append(grow(list(range(n)), [a - b for a, b in zip(p, label)], [a * (1 - a) for a in p], 0))
        margin = [m + leaf_of(out[-1], x) for m, x in zip(margin, rows)]
    return base, out


def leaf_of(node, row) -> float:
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def statistics(text: str | None) -> dict[str, float]:
    """The statistics of a document, one by one, by the definitions of op10.FEATURES; over bytes."""
    data = (text or "").encode()
    words = re.findall(rb"[^\x00-\x20]+", data)
    marks, size, many = b".,;:!?'\"()-", max(1, len(data)), max(1, len(words))
    letter = lambda b: b >= 128 or chr(b).isalpha()
    symbol = lambda b: 32 < b < 127 and not chr(b).isalnum() and b not in marks
    share = lambda test: sum(map(test, data)) / size
    times = Counter(words)
    return {
        "log_chars": math.log1p(len(data)), "log_words": math.log1p(len(words)), "mean_word": sum(map(len, words)) / many, "wide_words": sum(len(w) > 20 for w in words) / many,
        "letters": share(letter), "upper": share(lambda b: 65 <= b <= 90), "digits": share(lambda b: 48 <= b <= 57), "spaces": share(lambda b: b in b" \t\r\x0b\x0c"),
        "marks": share(lambda b: b in marks), "symbols": share(symbol), "not_ascii": share(lambda b: b >= 128), "lines": share(lambda b: b == 10),
        "entropy": -sum(k / size * math.log2(k / size) for k in Counter(data).values()), "distinct_words": len(times) / many, "top_word": max(times.values(), default=0) / many,
        "same_as_before": sum(a == b for a, b in zip(words, words[1:])) / many, "bare_words": sum(not any(map(letter, w)) for w in words) / many,
        "ends_marked": sum(w[-1] in marks or symbol(w[-1]) for w in words) / many, "mean_line": math.log1p(len(data) / (data.count(b"\n") + 1)),
    }


def prose(rng: np.random.Generator, words: int, vocabulary: int = 4000) -> str:
    """Words of Zipfian frequency, in sentences."""
    stems = ["ka", "lo", "ri", "men", "to", "su", "pa", "ne", "ver", "il", "dos", "cha"]
    out = []
    for k in np.minimum(rng.zipf(1.2, words), vocabulary):
        word, k = "", int(k)
        while k:
            k, r = divmod(k, len(stems))
            word += stems[r]
        out.append(word)
    return " ".join(out) + "."
