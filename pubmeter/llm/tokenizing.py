"""Whole texts to token ids in Python workers, with the encodings of repeated pieces kept.

A text is cut where the tokenizer's own pre-tokenizer always cuts, at ASCII white space, and each piece is encoded by the
tokenizer once per worker. A piece of plain letters with punctuation behind it is cut once more, and its parts go straight
to the tokenizer's merge model; every other piece goes through the whole tokenizer. The results equal those of the library.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from tokenizers import Tokenizer

# Pieces and words that a worker keeps at most; later ones are encoded each time they come.
KEPT = 250_000
LATIN = "a-zß-öø-ÿ"
PUNCTUATION = r"[.,;:!?|*#$%&<>\"()\[\]/=+_-]*"
LOWER_PIECE = re.compile(rf"([{LATIN}]+)({PUNCTUATION})")
PIECE = re.compile(rf"( ?[A-ZÀ-ÖØ-Þ{LATIN}]+)({PUNCTUATION})")
SPACES = r" \t\n\r\x0b\x0c"
UNITS = re.compile(rf" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
# White space beyond ASCII, which may join a run of ASCII white space.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    own = set(printable)
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Words(dict):
    """What is kept of a pre-token's token ids, which come straight from the merge model."""

    def __init__(self, tokenizer: Tokenizer, keep: Callable[[list[int]], bytes | int]) -> None:
        super().__init__()
        self.model, self.letters, self.keep = tokenizer.model, byte_letters(), keep

    def __missing__(self, word: str) -> bytes | int:
        letters = self.letters
        out = self.keep([t.id for t in self.model.tokenize("".join([letters[b] for b in word.encode()]))])
        if len(self) < KEPT:
            self[word] = out
        return out


class WordPieces(dict):
    """White-space separated piece -> bytes of its ids, for a lower-casing tokenizer that drops white space."""

    def __init__(self, path: str, dtype: str) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.keep = lambda ids: np.array(ids, dtype).tobytes()
        self.words = Words(self.tokenizer, self.keep)

    def __missing__(self, piece: str) -> bytes:
        plain = LOWER_PIECE.fullmatch(piece.lower()) if piece.isascii() or max(piece) <= "ÿ" else None
        if plain:
            out = self.words[plain[1]]
            if plain[2]:
                out += self.words[plain[2]]
        else:
            out = self.keep(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(self) < KEPT:
            self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian ids of the whole text."""
        return b"".join(map(self.__getitem__, ASCII_WORDS.findall(text)))


ASCII_WORDS = re.compile(rf"[^{SPACES}]+")


class UnitLengths(dict):
    """Unit (a word with the space before it, or a run of white space) -> number of tokens, for a byte-level tokenizer."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        super().__init__()
        self.tokenizer, self.words = tokenizer, Words(tokenizer, len)

    def __missing__(self, unit: str) -> int:
        plain = PIECE.fullmatch(unit)
        if plain:
            n = self.words[plain[1]] + (self.words[plain[2]] if plain[2] else 0)
        else:
            n = len(self.tokenizer.encode(unit, add_special_tokens=False).ids)
        if len(self) < KEPT:
            self[unit] = n
        return n
