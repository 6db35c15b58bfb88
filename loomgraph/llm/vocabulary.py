"""A SentencePiece vocabulary read as a unigram model, and the places where a text may be cut.

The installed public .model file holds pieces with scores. Both tokenizer operators read it as a
unigram model: the best segmentation is the one with the greatest sum of scores, in double
precision; of equal sums into one position the piece that starts earliest wins, as in the reference
decoders, which visit starts in ascending order and replace only on a strictly greater score. A
character that no single piece covers costs the least score less 10 and is written as its UTF-8
bytes; if the model has no byte pieces, a run of such characters is one unknown id.

Texts are read as they are, with one space mark in front. A model that asks for anything else (rules
of normalisation, extra white space taken away, no mark in front or one behind) is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

SPACE = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0


class Vocabulary:
    def __init__(self, pieces: list[tuple[str, float, str]]):
        """pieces: by id, the text, the score and the kind: normal, byte or other (never matched)."""
        self.texts = [p for p, _, _ in pieces]
        self.pieces = {p: (i, s) for i, (p, s, kind) in enumerate(pieces) if kind == "normal" and p}
        byte = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.bytes = [byte[f"<0x{b:02X}>"] for b in range(256)] if len(byte) == 256 else None
        self.unknown = next((i for i, (p, _, _) in enumerate(pieces) if p == "<unk>"), 0)
        self.longest = max(map(len, self.pieces), default=1)
        self.singles = {p for p in self.pieces if len(p) == 1}
        self.unknown_score = min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN_PENALTY
        # Where no piece holds a space mark after another character, nor a line end, each path passes there.
        # Unknown characters on both sides of a cut would be one id, unless they are written as bytes.
        self.cuts = self.bytes is not None and not any(a != SPACE == b for p in self.pieces for a, b in zip(p, p[1:])) and not any("\n" in p for p in self.pieces)
        #: For each id, the bytes that it decodes to.
        self.decoded = [
            bytes([int(p[3:5], 16)]) if kind == "byte" else p.replace(SPACE, " ").encode() if kind == "normal" else b""
            for p, _, kind in pieces
        ]
        if self.bytes is None:
            self.decoded[self.unknown] = " ⁇ ".encode()

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> Vocabulary:
        return _load(path)

    def unknown_ids(self, char: str) -> list[int]:
        return [self.unknown] if self.bytes is None else [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


def check_settings(model: bytes) -> None:
    """Raise ValueError if a model file asks for texts that are read otherwise than here."""
    trainer: dict = {}
    normaliser: dict = {}
    for field, value in _fields(model):
        if field in (2, 3):
            (trainer if field == 2 else normaliser).update(_fields(value))
    asks = {
        "rules of normalisation": bool(normaliser.get(2)),
        "no space mark in front": not normaliser.get(3, 1),
        "extra white space taken away": bool(normaliser.get(4, 1)),
        "spaces left unmarked": not normaliser.get(5, 1),
        "space marks behind words": bool(trainer.get(24, 0)),
    }
    if odd := [what for what, so in asks.items() if so]:
        raise ValueError(f"the model asks for {', '.join(odd)}, which isn't supported")


@lru_cache(maxsize=2)
def _load(path: str) -> Vocabulary:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    check_settings(p.serialized_model_proto())
    kind = lambda i: "byte" if p.is_byte(i) else "other" if p.is_control(i) or p.is_unused(i) or p.is_unknown(i) else "normal"
    return Vocabulary([(p.id_to_piece(i), p.get_score(i), kind(i)) for i in range(p.get_piece_size())])


_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}\\n]+|{SPACE}+|\\n")


def marked(text: str) -> str:
    """The text as the model sees it: a space mark in front, and one for each space."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def segments(text: str, cuts: bool = True) -> list[str]:
    """marked(text), cut where every segmentation has a border; some parts may be empty."""
    if not text:
        return []
    if not cuts:
        return [marked(text)]
    if "  " in text or SPACE in text or text[0] == " ":
        return _SEGMENT.findall(marked(text))
    return (SPACE + text.replace(" ", " " + SPACE).replace("\n", " \n ")).split(" ")


class Memo(dict):
    """Results by segment in two generations of bounded size: a full young one replaces the old."""

    def __init__(self, compute, limit: int = 300_000, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, segment: str):
        value = self.old.get(segment)
        if value is None:
            value = self.compute(segment)
        if len(segment) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[segment] = value
        return value
