"""Token counts: a Viterbi pass that carries counts only.

An Aho-Corasick automaton enumerates the pieces of a unigram vocabulary in a text; over their ends
runs a dynamic program that keeps, for each position, the best score and the number of pieces on
the path to it, and no path. Segments of a text that no piece can join (see vocabulary.py) are
counted apart and remembered, as most words return.

Cases: a null text has a null count and an empty one 0; other null columns don't matter. Texts of
any length are taken whole. Ties are decided as the tokenizer does. Each row, repeated or not, has
its count. An empty table gives an empty result. Only the two named columns are read, so further
columns, whatever their names, have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import named
from .vocabulary import DEFAULT_MODEL, Memo, Vocabulary, segments


#: Characters of a long segment that are searched at a time.
BLOCK = 1024


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, (_, score) in vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.memo = Memo(self.count_segment)

    def count_segment(self, s: str) -> int:
        """The pieces in the best segmentation of s."""
        v, n = self.vocabulary, len(s)
        if not n:
            return 0
        if n <= BLOCK and v.singles.issuperset(s):
            best = [float("-inf")] * n
            count = [0] * n
            best.append(0.0)  # these last two are also found at -1, in front of the text
            count.append(0)
            for last, (length, score) in self.automaton.iter(s):  # by end; of one end, the longest first
                if (total := best[last - length] + score) > best[last]:
                    best[last] = total
                    count[last] = count[last - length] + 1
            return count[n - 1]
        return self._in_blocks(s)

    def _in_blocks(self, s: str) -> int:
        """The same for long segments and unknown characters, with only as many positions at hand as a piece can reach back."""
        v, base = self.vocabulary, 0
        best, count, odd = [0.0], [0], [False]  # odd: whether the last piece on the path is the unknown id
        for first in range(0, len(s), BLOCK):
            block = s[first : first + BLOCK]
            if (gone := len(best) - v.longest) > 0:
                del best[:gone], count[:gone], odd[:gone]
                base += gone
            best += [float("-inf")] * len(block)
            count += [0] * len(block)
            odd += [False] * len(block)
            strange = [first + k for k, c in enumerate(block) if c not in v.singles]
            before = max(0, first - v.longest)  # where a piece that ends in the block may begin
            found = self.automaton.iter(s[before : first + len(block)]) if len(self.automaton) else ()
            k = 0
            for last, (length, score) in chain(found, [(first + len(block) - before, (0, 0.0))]):
                last += before
                if last < first:
                    continue
                while k < len(strange) and strange[k] < last:  # after all pieces that end in it, as the shortest
                    at = strange[k] + 1 - base
                    if (total := best[at - 1] + v.unknown_score) > best[at]:
                        best[at] = total
                        odd[at] = v.bytes is None
                        count[at] = count[at - 1] + (0 if odd[at] and odd[at - 1] else len(v.unknown_ids(s[strange[k]])))
                    k += 1
                at = last + 1 - base
                if length and (total := best[at - length] + score) > best[at]:
                    best[at] = total
                    odd[at] = False
                    count[at] = count[at - length] + 1
        return count[-1]

    def count(self, text: str) -> int:
        return sum(map(self.memo.__getitem__, segments(text, self.vocabulary.cuts)))


@lru_cache(maxsize=2)
def counter(model: str) -> Counter:
    return Counter(Vocabulary.load(model))


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """(id_col, n_tokens) for each row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model).count
        for b in batches:
            found = [None if x is None else count(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], ["id", "n_tokens"])

    source = df.select(named(id_col).alias("id"), named(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_tokens bigint").withColumnRenamed("id", id_col)
