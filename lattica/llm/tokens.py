"""Token ids of whole texts, as the tokenizers library gives them, with the ids of pieces between spaces kept.

Both public vocabularies cut texts before merging, and never across a single space between two other characters: a
cut comes just before it (byte_bpe) or the space is dropped (word_bpe). So the ids of a text are those of its pieces,
each with its leading space. Pieces repeat; their ids are kept as bytes in two generations of bounded size, and a
text is the join of its pieces' bytes. Pieces of plain letters go straight to the library's merge model; all others
are encoded by the whole library.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

from .common import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces of which the ids are kept in each of two generations: some 190 bytes each.
KEEP = 400_000
_PLAIN = re.compile(r"([A-Za-zß-öø-ÿÀ-ÖØ-Þ]+)([.,]?)")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level models: printable Latin-1 stands for itself, the rest follows from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Odd(Exception):
    pass


class _Kept(dict):
    """Pieces -> ids, in two generations of at most `keep` pieces; lookups that hit the newer one stay in C."""

    def __init__(self, encoder: Encoder, keep: int):
        super().__init__()
        self.keep, self.old, self.ids_of = keep, {}, encoder._piece
        self.tokenize, self.space, self.code, self.lower = encoder.model.tokenize, encoder._space, encoder.code, encoder.drops_space

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            if piece.isalpha() and piece.isascii():
                ids = array(self.code, [t.id for t in self.tokenize(self.space + (piece.lower() if self.lower else piece))]).tobytes()
            else:
                ids = self.ids_of(piece)
        if len(piece) <= 64:
            if len(self) >= self.keep:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """encode(text) -> ids as little-endian unsigned bytes of `width`, equal to the library's own encoding."""

    def __init__(self, path: str, keep: int = KEEP):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.dtype = f"<u{self.width}"
        letters = _byte_letters()
        self._table = str.maketrans({c: "".join(letters[b] for b in c.encode()) for c in map(chr, range(128, 256))})
        # the vocabulary's kind, told by what it does
        self.drops_space = self._full(" a") == self._full("a")
        self._space = "" if self.drops_space else "Ġ"
        self._tails = {"": b""} | {c: self._full(c) for c in ".,"}
        self._newline = self._full("a\nb")[len(self._full("a")) : -len(self._full("b"))]
        self.kept = _Kept(self, keep)

    def _full(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str, space: str) -> bytes:
        if self.drops_space:
            word = word.lower()
        if not word.isascii():
            word = word.translate(self._table)
        return array(self.code, [t.id for t in self.model.tokenize(space + word)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece (what stands between two single spaces) that follows a space. No piece has a space of its own:
        with one before it, it is a plain word that follows a line feed."""
        m = _PLAIN.fullmatch(piece)
        if m is None:
            if not piece:
                raise _Odd
            if piece[0] == " ":
                if self.drops_space:
                    return self.kept[piece[1:]]
                tail = piece[-1] if piece[-1] in ".," else ""
                return self._word(piece[1 : len(piece) - len(tail)], "") + self._tails[tail]
            if piece[0].isspace() or piece[-1].isspace():
                raise _Odd
            lines = piece.split("\n")
            if len(lines) > 1 and all(map(_PLAIN.fullmatch, lines)):
                return self.kept[lines[0]] + b"".join([self._newline + self.kept[" " + x] for x in lines[1:]])
            return self._full(" " + piece)
        word, tail = m.groups()
        return self.kept[word] + self._tails[tail] if tail else self._word(word, self._space)

    def encode(self, text: str) -> bytes:
        first, *pieces = text.split(" ")
        try:
            if first and first[-1].isspace():
                raise _Odd
            return (self._full(first) if first else b"") + b"".join(map(self.kept.__getitem__, pieces))
        except _Odd:  # other white space beside a space: cut only at single spaces between other characters
            first, *pieces = _CUT.split(text)
            return self._full(first) + b"".join([self._full(" " + p) if p[0].isspace() or p[-1].isspace() else self.kept[p] for p in pieces])

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(text), self.dtype)


_CUT = re.compile(r"(?<=\S) (?=\S)")


def encoder(path: str) -> Encoder:
    """One per worker process, until another operator needs the memory (see common.held)."""
    return held(f"encoder {path}", lambda: Encoder(path))


def public(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
