"""Encoding whole texts with a vocabulary file of a public tokenizer, each distinct piece once.

Texts are cut where the tokenizer's own splitting always has a boundary, so that the ids of a text
are those of its pieces in order.  A worker keeps the ids of pieces it has met, up to a bound, and
asks the library for the others: plain words many to a text, cut apart again by the tokens that
begin or end a word, and everything else piece by piece.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Unicode white space (fixed values of the White_Space property).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Latin letters that no normalization changes and that are one letter in lower case (so not U+0130).
LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f"
STOPS = ".,;:!?|"
#: A Latin word with a space before it, stops that end it, or white space with all that follows it up
#: to the next: no token crosses from letters to stops, or from other characters to white space.
SPACED = re.compile(f" ?[{LATIN}]++(?=[{WHITE}{STOPS}]|\\Z)|(?<=[{LATIN}])[{STOPS}]++(?=[{WHITE}]|\\Z)|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: The same for tokenizers that drop white space.
BARE = re.compile(f"[{LATIN}]++(?=[{WHITE}{STOPS}]|\\Z)|(?<=[{LATIN}])[{STOPS}]++(?=[{WHITE}]|\\Z)|[^{WHITE}]+")
#: Pieces kept by a worker; at the bound it starts afresh.
KEPT_PIECES = 1_000_000
#: Plain words of one text for the library.
JOINED = 1000

_CACHES: dict[tuple[str, bool], "PieceTable"] = {}


class _Numbers(dict):
    """Piece -> number; a piece that is asked for first gets the next one and is noted as new."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class PieceTable:
    """Ids of pieces: each piece's number, where its ids begin in a flat array, and how many they are."""

    def __init__(self, path: str, bare: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bare = bare
        self.pieces = BARE if bare else SPACED
        self.plain = re.compile(f"[{LATIN}]+" if bare else f" [{LATIN}]+").fullmatch
        vocab = self.tokenizer.get_vocab()
        self.marked = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a word, or begin one
        for token, i in vocab.items():
            self.marked[i] = token.endswith("</w>") if bare else token.startswith("Ġ")
        self._clear()

    def _clear(self) -> None:
        self.index = _Numbers()
        self.ids = np.zeros(0, np.uint32)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def forget(self) -> None:
        """Gives the memory of the pieces back."""
        import pyarrow as pa

        self._clear()
        pa.default_memory_pool().release_unused()

    def _ids(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The pieces in the order in which their ids follow, the ids end to end, and their numbers."""
        plain = list(filter(self.plain, pieces))
        other = list({*pieces}.difference(plain)) if len(plain) < len(pieces) else []
        joined = [(" " if self.bare else "").join(plain[i : i + JOINED]) for i in range(0, len(plain), JOINED)]
        found = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, np.uint32), *found])
        at = np.flatnonzero(self.marked[flat])
        sizes = np.diff(np.concatenate([[-1], at]) if self.bare else np.concatenate([at, [len(flat)]]))
        if len(sizes) != len(plain):
            raise ValueError("the vocabulary doesn't mark its words")
        rest = [x.ids for x in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
        more = np.fromiter(map(len, rest), np.int64, len(rest))
        return plain + other, np.concatenate([flat, np.fromiter((i for x in rest for i in x), np.uint32, int(more.sum()))]), np.concatenate([sizes, more])

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, each with the end id if one is given; the texts' offsets."""
        if len(self.index) > KEPT_PIECES:
            self._clear()
        index, find = self.index, self.pieces.findall
        codes, counts = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if self.bare and unicodedata.is_normalized("NFC", text) and "Σ" not in text and "İ" not in text:
                text = text.lower()  # as the tokenizer does, letter by letter
            own = find(text)
            counts[k] = len(own)
            codes += own
        code = np.fromiter(map(index.__getitem__, codes), np.int64, len(codes))
        if index.new:
            new, flat, sizes = self._ids(index.new)
            number = np.fromiter(map(index.__getitem__, new), np.int64, len(new))
            index.new = []
            more = np.zeros((2, len(new)), np.int64)
            more[:, number - len(self.start)] = len(self.ids) + np.cumsum(sizes) - sizes, sizes
            self.start, self.size = np.concatenate([self.start, more[0]]), np.concatenate([self.size, more[1]])
            self.ids = np.concatenate([self.ids, flat])
        size = self.size[code]
        ends = np.cumsum(size)
        flat = self.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[code] - (ends - size), size)]
        last = np.cumsum(counts)
        ends = np.concatenate([[0], ends])
        off = ends[np.concatenate([[0], last])]
        if end is not None:
            flat = np.insert(flat, off[1:], end)
            off = off + np.arange(len(off))
        return flat, off


def piece_table(path: str, bare: bool = False) -> PieceTable:
    if (path, bare) not in _CACHES:
        _CACHES[path, bare] = PieceTable(path, bare)
    return _CACHES[path, bare]
