"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search reads a text in blocks. It holds the positions that the longest piece may still reach;
whenever the back pointers of all positions that survive lead to one border, the ids up to there are
final and are committed, and what lies before is forgotten. Memory thus follows the longest stretch
on which paths disagree, and not the text; a border is looked for again once the positions held have
doubled, so that time stays in proportion to the text even where paths never meet. Words are such
stretches wherever no piece holds a space inside (see vocabulary.py), so their ids are remembered.

Cases: a null text has null ids and a null decoded text, an empty one an empty list. Characters
outside the vocabulary become byte pieces and return unchanged; with a model that has no byte pieces
a run of them is one unknown id, and `lossless` is false. A text that holds the space mark
U+2581 itself decodes to a space there, as in the model's own library; `lossless` is then false.
Ids outside the vocabulary decode to nothing. Ties are decided as in vocabulary.py. Each row,
repeated or not, has its result; an empty table gives an empty result. Of df only the named columns
are read, and further columns have no effect.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import named, text_chunks
from .vocabulary import DEFAULT_MODEL, Memo, Vocabulary, segments

_LOWEST = float("-inf")
#: Characters that are searched at a time; what is not committed is held besides.
BLOCK = 1024


class Stream:
    """An encoder for one text that comes in parts. Ids are 32-bit integers in bytes."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.read = 0  # characters searched
        self.base = 0  # characters committed; position 0 of the lists
        self.best: list[float] = [0.0]
        self.back: list[tuple | None] = [None]  # the piece that ends at each position, on the best path to it
        self.pause = self.step = 4 * codec.vocabulary.longest
        self.widest = 1
        self.tail = ""  # the characters before the next block that a piece that ends in it may hold
        self.after_unknown = False

    def feed(self, part: str) -> bytes:
        """Ids that are final now."""
        return b"".join([self._block(part[i : i + BLOCK]) for i in range(0, len(part), BLOCK)])

    def close(self) -> bytes:
        return self._commit(len(self.best) - 1)

    def _block(self, s: str) -> bytes:
        best, back = self.best, self.back
        best += [_LOWEST] * len(s)
        back += [None] * len(s)
        self.widest = max(self.widest, len(best))
        joined, known = self.tail + s, len(self.tail)
        self.tail = joined[-self.codec.vocabulary.longest :]
        shift = 1 - self.base + self.read - known
        found = self.codec.automaton.iter(joined) if len(self.codec.automaton) else ()
        if self.codec.vocabulary.singles.issuperset(s):
            for last, piece in found:  # by end; of one end, the longest first
                if last < known:
                    continue
                at = last + shift
                if (total := best[at - piece[0]] + piece[1]) > best[at]:
                    best[at] = total
                    back[at] = piece
        else:
            self._with_unknown(joined, known, found, shift)
        self.read += len(s)
        if len(best) <= self.pause:
            return b""
        out = self._commit(self._border())
        self.pause = max(self.step, 2 * len(best))  # a search for borders is paid for by as many new positions
        return out

    def _with_unknown(self, s: str, known: int, found: Iterable[tuple], shift: int) -> None:
        """The same where characters have no piece: such a one counts after all pieces that end in it, as the shortest."""
        best, back, v = self.best, self.back, self.codec.vocabulary
        odd = [(k, c) for k, c in enumerate(s) if k >= known and c not in v.singles]
        k = 0

        def pass_by() -> None:
            at = odd[k][0] + shift
            if (total := best[at - 1] + v.unknown_score) > best[at]:
                best[at] = total
                back[at] = self.codec.unknown(odd[k][1])

        for last, piece in found:
            if last < known:
                continue
            while k < len(odd) and odd[k][0] < last:
                pass_by()
                k += 1
            at = last + shift
            if (total := best[at - piece[0]] + piece[1]) > best[at]:
                best[at] = total
                back[at] = piece
        while k < len(odd):
            pass_by()
            k += 1

    def _border(self) -> int:
        """The last position that the paths to all starts of later pieces go through."""
        at = len(self.best) - 1
        live = set(range(max(0, at + 1 - self.codec.vocabulary.longest), at + 1))
        while len(live) > 1:
            if at in live:
                live.remove(at)
                live.add(at - self.back[at][0])
            at -= 1
        return live.pop()

    def _commit(self, end: int) -> bytes:
        found, at = [], end
        while at > 0:
            piece = self.back[at]
            found.append(piece)
            at -= piece[0]
        found.reverse()
        del self.best[:end], self.back[:end]
        self.base += end
        if self.codec.vocabulary.bytes is None:  # a run of unknown characters is one id
            kept = []
            for piece in found:
                odd = piece is self.codec.unknown_piece
                if not (odd and self.after_unknown):
                    kept.append(piece)
                self.after_unknown = odd
            found = kept
        return b"".join([piece[2] for piece in found])


def _coded(ids: Iterable[int]) -> bytes:
    return b"".join(i.to_bytes(4, sys.byteorder) for i in ids)


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, (i, score) in vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), score, _coded([i])))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.unknown_piece = (1, vocabulary.unknown_score, _coded([vocabulary.unknown]))
        self.memo = Memo(self._segment)
        self.memo[""] = b""
        self.table = pa.array(vocabulary.decoded, pa.binary())

    def unknown(self, char: str) -> tuple:
        """What a character without a piece is written as."""
        if self.vocabulary.bytes is None:
            return self.unknown_piece
        return 1, self.vocabulary.unknown_score, _coded(self.vocabulary.unknown_ids(char))

    def encode_marked(self, parts: Iterable[str]) -> bytes:
        """Ids of a text with space marks that comes in parts."""
        stream = Stream(self)
        out = [stream.feed(part) for part in parts]
        return b"".join(out) + stream.close()

    def _segment(self, s: str) -> bytes:
        """A segment of a few windows is searched in one go: all paths meet at its end."""
        n = len(s)
        if n > 4 * self.vocabulary.longest or not self.vocabulary.singles.issuperset(s):
            return self.encode_marked([s])
        best, back = [_LOWEST] * n, [None] * n
        best.append(0.0)  # also found at -1, in front of the text
        for last, (length, score, coded) in self.automaton.iter(s):  # by end; of one end, the longest first
            if (total := best[last - length] + score) > best[last]:
                best[last] = total
                back[last] = (length, coded)
        parts = []
        n -= 1
        while n >= 0:
            length, coded = back[n]
            n -= length
            parts.append(coded)
        parts.reverse()
        return b"".join(parts)

    def encode_bytes(self, text: str) -> bytes:
        """Ids as 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, segments(text, self.vocabulary.cuts)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def decode_all(self, values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 of each list of ids; the mark in front goes."""
        pieces = self.table.take(pa.array(np.where((values >= 0) & (values < len(self.table)), values, self.vocabulary.unknown)))
        joined = memoryview(pieces.buffers()[2] or b"")
        borders = np.frombuffer(pieces.buffers()[1], np.int32)[: len(pieces) + 1][offsets].tolist() if len(pieces) else [0] * len(offsets)
        texts = [joined[a:b] for a, b in zip(borders, borders[1:])]
        return [bytes(t[1:] if t[:1] == b" " else t) for t in texts]


@lru_cache(maxsize=2)
def codec(model: str) -> Codec:
    return Codec(Vocabulary.load(model))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """(id_col, ids, lossless) for each row: the ids, and whether they decode to the very text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in text_chunks(batches):
            texts = b.column(1).to_pylist()
            coded = [b"" if t is None else c.encode_bytes(t) for t in texts]
            offsets = np.zeros(len(texts) + 1, np.int64)
            np.cumsum([len(x) // 4 for x in coded], out=offsets[1:])
            values = np.frombuffer(b"".join(coded), np.int32)
            back = c.decode_all(values, offsets)
            absent = pa.array([t is None for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values), mask=absent)
            same = [None if t is None else t.encode("utf-8", "surrogatepass") == d for t, d in zip(texts, back)]
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(same, pa.bool_())], ["id", "ids", "lossless"])

    source = df.select(named(id_col).alias("id"), named(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids array<int>, lossless boolean").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """(id_col, text) for each row of ids; a null within a list counts as an id outside the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            rows = b.column(1).to_pylist()
            offsets = np.zeros(len(rows) + 1, np.int64)
            np.cumsum([len(x or ()) for x in rows], out=offsets[1:])
            values = np.array([-1 if i is None else i for x in rows for i in x or ()], np.int32)
            texts = [None if x is None else t.decode("utf-8", "replace") for x, t in zip(rows, c.decode_all(values, offsets))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    source = df.select(named(id_col).alias("id"), named(ids_col).cast("array<int>").alias("ids"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
