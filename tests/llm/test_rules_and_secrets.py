"""Suffix-array repetition and the secret scan, against plain versions."""

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import op2_secret_scan as op2
from loomgraph.llm import op8_quality_rules as op8
from loomgraph.llm.kernels import Texts

from .brute import prose, repeats, secrets


def texts() -> list:
    rng = np.random.default_rng(3)
    out = [None, "", " \n ", "one", "a " * 100, "ab" * 200, "日本" * 60, "x y z " * 9 + "end", "é" * 40 + " " + "é" * 40]
    for _ in range(25):
        own = prose(rng, int(rng.integers(20, 160)), 30).split(" ")
        at = int(rng.integers(0, len(own)))
        out.append(" ".join(own + own[at : at + 30] + ["\n"] + own[: int(rng.integers(0, 40))]))
    return out


@pytest.mark.parametrize("least", [1, 3, 16])
def test_repeats_equal_brute_force(least):
    own = texts()
    covered, longest = op8.measure(Texts.of(pa.array(own, pa.string())), least)
    for t, c, k in zip(own, covered, longest):
        assert (pytest.approx(c), k) == repeats(t, least), (t or "")[:60]


def test_a_long_word_is_judged_as_one_just_short_of_it():
    plain = prose(np.random.default_rng(15), 60)
    for size in (63, 64, 65, 66, 80):  # crosses LONG_WORD
        link = "https://example.org/" + "".join(np.random.default_rng(size).choice(list("abcdefghij"), size - 20))
        covered, short, longest = op8.measure_all(Texts.of(pa.array([f"{link} {plain} {link}"])))
        assert covered[0] == 0 == longest[0] and short[0] < 0.2, size


def test_common_prefixes_equal_a_plain_comparison():
    rng = np.random.default_rng(16)
    tokens = rng.integers(0, 2, 400).astype(np.uint64)
    tokens[200:] = tokens[:200]
    parity = np.array([bin(k).count("1") & 1 for k in range(1 << 13)], dtype=np.uint64)  # equal hashes modulo a power of two
    for own, pairs in ((tokens, rng.integers(0, 400, (500, 2))), (parity, np.array([[0, 1 << 12], [1 << 11, 3 << 11], [5, 77]]))):
        a, b = pairs[pairs[:, 0] != pairs[:, 1]].T
        equal = own[a] == own[b]
        a, b = a[equal], b[equal]
        n = len(own)
        want = [next((k for k in range(n - max(i, j)) if own[i + k] != own[j + k]), n - max(i, j)) for i, j in zip(a.tolist(), b.tolist())]
        assert op8._common(own, np.full(len(a), n), a, b).tolist() == want


def test_memory_of_a_long_text_does_not_grow_with_its_repeats():
    import tracemalloc

    words = [f"w{k}" for k in np.random.default_rng(17).integers(0, 5000, 100_000)]
    texts = Texts.of(pa.array([" ".join(words + words)]))
    tracemalloc.start()
    op8.measure_all(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 * 200_000, peak  # bytes a word; with the ranks of each doubling kept it were more for each doubling


def test_judgement_and_kept_rows_agree(spark):
    own = [*enumerate(texts()), (None, "a " * 100), (5, "ab" * 200)]
    df = spark.createDataFrame([(i, t, "k") for i, t in own], "doc_id bigint, text string, keep string")
    found = sorted(((r.doc_id, r.keep) for r in op8.judge(df).collect()), key=str)
    want = []
    for i, t in own:
        c, k = repeats(t, op8.MIN_WORDS)
        want.append((i, c <= op8.MAX_COVERED and k <= op8.MAX_LONGEST))
    assert found == sorted(want, key=str)
    kept = op8.keep_documents(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, ok in want if ok), key=str)


def test_short_repeats_that_fill_a_text_are_seen():
    plain = prose(np.random.default_rng(5), 90)
    line = "this short line is there again and again"
    fresh = [f"n{k}" for k in range(40)]
    cases = [
        (" ".join(x for x in ("der", "schchsch", "enge", "und") for _ in range(11)), True),
        (" ".join(x for x in ("this", "thhant", "of", "men", "ka", "lo") for _ in range(4)), True),
        ("a b c a b c a b c . d e f d e f d e f", True),
        (" ".join(f"{line} {x}" for x in fresh[:6]), True),
        (f"{line} {fresh[0]} {line} {fresh[1]} {fresh[2]}", False),
        (plain + " ha ha ha ha ha", False),
        ("der der " + plain, False),
        (" ".join(fresh), False),
        ("", False),
    ]
    covered, short, _ = op8.measure_all(Texts.of(pa.array([t for t, _ in cases])))
    assert [bool(s > op8.MAX_SHORT) for s in short] == [gone for _, gone in cases]
    assert (covered <= op8.MAX_COVERED).all() and (short >= covered).all()
    assert short[0] == short[1] == 1.0 and short[4] == short[7] == 0.0


def test_rows_full_of_short_repeats_go(spark):
    df = spark.createDataFrame([(1, "der " * 11 + "enge " * 11 + "und " * 11), (2, "one two three")], "doc_id bigint, text string")
    assert [(r.doc_id, r.keep) for r in op8.judge(df).orderBy("doc_id").collect()] == [(1, False), (2, True)]
    assert [r.doc_id for r in op8.keep_documents(df).collect()] == [2]


def planted(n: int = 150) -> tuple[list, set]:
    rng = np.random.default_rng(4)
    docs, hidden = [], set()
    for i in range(n):
        text = prose(rng, 120) + " " + prose(rng, 9).replace(" ", "") + " "
        if i % 5 == 0:
            name = ["hex", "base62", "base64", "upper36"][i // 5 % 4]
            key = "".join(rng.choice(list(op2.ALPHABETS[name]), size=40))
            text += f" key = {key} "
            hidden.add((i, key))
        docs.append((i, text + prose(rng, 30)))
    return docs, hidden


def test_secrets_equal_brute_force_and_are_those_hidden(spark):
    docs, hidden = planted()
    docs += [(None, docs[0][1]), (9, None), (10, ""), docs[5]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = op2.scan(df).collect()
    assert {(r.doc_id, r.position, r.encoding, r.secret) for r in rows} == secrets(docs)
    found = {(r.doc_id, r.secret) for r in rows if r.doc_id is not None}
    assert hidden <= found
    assert len({i for i, _ in found} - {i for i, _ in hidden}) <= 2  # of 120 documents with a long word that is none
    assert sum(r.doc_id == docs[5][0] for r in rows) == 2  # a repeated row is scanned twice


def test_binomial_tails_agree_and_hold_little():
    for n in (30, op2.TABLE - 1):
        for rate in (0.02, 0.3, 0.9):
            low, high = op2._tails(n, rate)
            for k in range(0, n + 1, 7):
                assert high[k] == pytest.approx(1.0 if k == 0 else op2._beta(k, n - k + 1, rate), rel=1e-8, abs=1e-290)
                assert low[k] == pytest.approx(1.0 if k == n else op2._beta(n - k, k + 1, 1 - rate), rel=1e-8, abs=1e-290)
    before = op2._tails.cache_info().currsize
    assert all(0 <= op2.tail(n, 0.4, int(n * 0.4), up) <= 1 for n in range(20_000, 23_000, 100) for up in (False, True))
    assert op2._tails.cache_info().currsize == before  # long runs have no table
    assert op2.tail(50_000, 0.4, 20_000, True) == pytest.approx(0.5, abs=0.01)


def test_a_pair_is_not_counted_across_documents():
    n = op2.pairs(Texts.of(pa.array(["ab", "c d", None, "", "ex", "x", "y" * 20, "zz"])))
    assert {divmod(int(k), 256) for k in n.nonzero()[0]} == {(97, 98), (101, 120), (122, 122)} and n.sum() == 3
