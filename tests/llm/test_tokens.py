"""Token counts, encoding and decoding, against another library's unigram decoder."""

import time

import numpy as np
import pytest

from loomgraph.llm import op1_token_counts as op1
from loomgraph.llm import op7_sentencepiece as op7
from loomgraph.llm.vocabulary import Vocabulary, check_settings, marked, segments

from .brute import encode, model_file, prose

TEXTS = [
    "", " ", "  two  spaces ", "Hello world", "l'été à Paris, où es-tu?", "日本語のテキスト です", "a\nb\n\n  c\td", "emoji 🦊🦊 and \x00 zero", "x" * 500,
    "internationalization of the supercalifragilistic", "0123456789" * 30, "Ünïcödé ߷ꙮ", "the the the the", "\n", "ends with space ", "aaaaaaaaaaaaab" * 7,
]


def test_ids_and_counts_equal_the_library():
    codec, counter = op7.codec(op7.DEFAULT_MODEL), op1.counter(op1.DEFAULT_MODEL)
    rng = np.random.default_rng(1)
    letters = list("abcdefghij  \n.,é日🦊")
    more = ["".join(rng.choice(letters, size=int(k))) for k in rng.integers(1, 300, 60)]
    for text in TEXTS + more + [prose(rng, 3000)]:
        want = encode(text)
        assert codec.encode(text) == want, text[:50]
        assert counter.count(text) == len(want), text[:50]


def test_a_stream_in_parts_gives_the_same_and_forgets():
    codec = op7.codec(op7.DEFAULT_MODEL)
    text = marked(prose(np.random.default_rng(2), 4000))
    for size in (1, 7, 1000):
        stream, out = op7.Stream(codec), b""
        for i in range(0, len(text), size):
            out += stream.feed(text[i : i + size])
        assert np.frombuffer(out + stream.close(), np.int32).tolist() == encode(text[1:].replace("▁", " "))
        assert stream.widest < 8 * codec.vocabulary.longest + min(size, op7.BLOCK)


def letters(n: int) -> str:
    return "".join(np.random.default_rng(n).choice(list("abcdefghijklmnopqrstuvwxyz"), n))


@pytest.mark.parametrize("text", [letters(200_000), "日本語のテキスト" * 20_000, "x" * 100_000 + "🦊" * 3000 + "ab" * 5000], ids=["letters", "japanese", "odd"])
def test_text_without_spaces_is_searched_in_a_window(text):
    codec = op7.codec(op7.DEFAULT_MODEL)
    want = encode(text)
    assert codec.encode(text) == want and op1.counter(op1.DEFAULT_MODEL).count(text) == len(want)
    stream = op7.Stream(codec)
    whole = stream.feed(marked(text)) + stream.close()  # as one part
    assert np.frombuffer(whole, np.int32).tolist() == want
    assert stream.widest < 8 * codec.vocabulary.longest + op7.BLOCK and len(stream.best) == 1


def test_time_is_in_proportion_to_text_without_spaces():
    codec, counter = op7.codec(op7.DEFAULT_MODEL), op1.counter(op1.DEFAULT_MODEL)
    for run in (codec.encode_bytes, counter.count):
        took = {}
        for n in (200_000, 400_000):
            text = letters(n)
            took[n] = min(timed(run, text) for _ in range(3))
        assert took[400_000] < 2.3 * took[200_000] + 0.05, took


def timed(run, text: str) -> float:
    began = time.process_time()
    run(text)
    return time.process_time() - began


def test_paths_that_never_meet_take_linear_time_too():
    v = Vocabulary([("<unk>", 0, "other"), ("▁", -1.0, "normal"), ("a", -9.0, "normal"), ("b", -9.0, "normal"), ("ab", -1.0, "normal"), ("ba", -1.0, "normal")])
    codec = op7.Codec(v)
    took = {n: min(timed(codec.encode_bytes, "ab" * n) for _ in range(3)) for n in (50_000, 100_000)}
    assert took[100_000] < 2.3 * took[50_000] + 0.05
    assert codec.encode("ab" * 5000) == [1] + [4] * 5000


PIECES = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("ab", -4.0, 1), ("▁a", -4.5, 1), ("bba", -6.0, 1), ("é", -5.0, 1), ("aa", -6.0, 1)]


@pytest.mark.parametrize("byte_pieces", [False, True])
def test_a_unigram_file_gives_the_ids_of_its_own_library(tmp_path, byte_pieces):
    import sentencepiece

    pieces = PIECES + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256) if byte_pieces]
    (tmp_path / "m.model").write_bytes(model_file(pieces, byte_pieces=byte_pieces))
    library = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model"))
    v = Vocabulary.load(str(tmp_path / "m.model"))
    codec, counter = op7.Codec(v), op1.Counter(v)
    rng = np.random.default_rng(14)
    texts = ["bxxab", "xx xx", "x\nx", "🦊🦊 a🦊", "x" * 3000, "ab" * 900 + "xyz" * 500] + ["".join(rng.choice(list("aabbé x\n🦊"), int(k))) for k in rng.integers(1, 200, 80)]
    for text in texts:
        want = library.encode(text)
        assert codec.encode(text) == want and counter.count(text) == len(want), text[:60]


def test_models_that_change_the_text_are_refused(tmp_path):
    for asks in ({"prefix": False}, {"squeeze": True}, {"rules": b"x"}, {"behind": True}):
        (tmp_path / "m.model").write_bytes(model_file(PIECES, **asks))
        with pytest.raises(ValueError, match="the model asks for"):
            check_settings((tmp_path / "m.model").read_bytes())
    check_settings(model_file(PIECES))


@pytest.mark.parametrize("cuts", [True, False])
def test_ties_take_the_earliest_start(cuts):
    v = Vocabulary([("<unk>", 0, "other"), ("▁", -1.0, "normal"), ("a", -1.0, "normal"), ("aa", -2.0, "normal"), ("aaa", -3.0, "normal"), ("▁a", -2.0, "normal")])
    v.cuts = v.cuts and cuts
    codec, counter = op7.Codec(v), op1.Counter(v)
    for n in range(1, 9):
        s = marked("a" * n)
        best = {0: (0.0, [])}
        for i in range(len(s)):  # starts ascending; only a greater score replaces
            for p, (k, score) in v.pieces.items():
                if s.startswith(p, i) and i in best and (i + len(p) not in best or best[i][0] + score > best[i + len(p)][0]):
                    best[i + len(p)] = (best[i][0] + score, best[i][1] + [k])
        assert codec.encode("a" * n) == best[len(s)][1]
        assert counter.count("a" * n) == len(best[len(s)][1])
    assert codec.encode("b") == [1, 0] and counter.count("b") == 2


def test_segments_join_to_the_whole():
    for text in TEXTS:
        assert "".join(segments(text)) == marked(text)


def test_round_trip_over_rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (99, None), (3, "Hello world"), (100, "mark ▁ inside")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    coded = op7.encode(df)
    back = {(r.doc_id, r.text) for r in op7.decode(coded).collect()}
    assert back == {(i, t.replace("▁", " ") if t else t) for i, t in rows}
    flags = {(r.doc_id, r.lossless) for r in coded.collect()}
    assert (99, None) in flags and (100, False) in flags
    assert all(ok for i, ok in flags if i not in (99, 100))
    odd = spark.createDataFrame([(1, [None, -5, 10**6, 13]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in op7.decode(odd).collect()} == {1: op7.codec(op7.DEFAULT_MODEL).vocabulary.decoded[13].decode(), 2: None, 3: ""}
    n = {(r.doc_id, r.n_tokens) for r in op1.token_counts(df).collect()}
    assert n == {(i, None if t is None else len(encode(t))) for i, t in rows}
