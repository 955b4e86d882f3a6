"""Encoding whole texts with a word-based BPE tokenizer, each distinct unit once.

The tokenizer splits at white space, so a text's ids are the ids of its pieces
between white space, one after the other. A piece of ASCII and Latin letters is cut further,
as the tokenizer does, into runs of letters, single digits and runs of other characters. All
units are found and looked up by their 64-bit hashes as whole arrays; only units not
met before reach Python. Words are encoded by the library's model directly, pieces with
wide characters by the whole library, and so are texts whose ids could depend on more
than one piece. Two units of one hash would be mixed up: with a table of ``MAX_CACHED``
hashes that is a chance of 2e-14 for each distinct unit.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

from flowloom.llm.wordtable import LOWER, SPACE, byte_class, span_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MAX_CACHED = 400_000
#: the tokenizer's own split, for lower-cased Latin text (fixed value)
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_WIDE = regex.compile(r"[^\x00-\u024F]")
#: what Python takes for white space and the tokenizer does not, and its special strings
_ODD = regex.compile(r"[\x1C-\x1F]|<\|startoftext\|>|<\|endoftext\|>")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Pieces:
    """Single pieces and words to ids."""

    def __init__(self, tokenizer, width: str):
        self.tokenizer, self.model, self.width, self.letters = tokenizer, tokenizer.model, width, _byte_letters()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def word(self, word: str) -> list[int]:
        """A lower-cased word of one kind of characters."""
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]

    def piece(self, piece: str) -> list[int]:
        if piece.isascii() and "'" not in piece:
            # printable ASCII stands for itself in the byte-level alphabet
            return [t.id for t in self.model.tokenize(piece)] if piece.isprintable() else self.word(piece)
        if _WIDE.search(piece):
            return self.whole(piece)
        low = unicodedata.normalize("NFC", piece).lower()
        return self.word(low) if low.isalpha() else [i for w in _SPLIT.findall(low) for i in self.word(w)]


class _Table:
    """Hashes of pieces in order, and where the ids of each lie in one flat array."""

    def __init__(self, width: str):
        self.hashes = np.zeros(0, np.uint64)
        self.first = self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, width)

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == hashes[known]
        return np.flatnonzero(~known)

    def add(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        """New hashes in ascending order with their ids."""
        at = np.searchsorted(self.hashes, hashes)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.first = np.insert(self.first, at, len(self.ids) + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), self.ids.dtype, int(size.sum()))])

    def spread(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these rows one after the other, and how many each row has."""
        size = self.size[row]
        shift = self.first[row] - (np.cumsum(size) - size)
        return self.ids[np.repeat(shift, size) + np.arange(int(size.sum()))], size


_SPACE, _LETTER, _DIGIT, _OTHER, _WHOLE = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[SPACE] = _SPACE
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = _LETTER
_KIND[128:] = _LETTER
#: An apostrophe, and first bytes outside U+00C0 to U+023F.
_KIND[[ord("'"), 0xC2, *range(0xC9, 256)]] = _WHOLE
#: The three characters between that are no letters, or not when lower-cased, by their two bytes (fixed values).
_NO_LETTER = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))
_CONTROL = byte_class((0x1C, 0x1F))


def units(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bytes, starts, ends)`` of all units of texts that lie back to back.

    Pieces with an apostrophe or with other characters than ASCII and Latin letters stay
    whole and as they are; in all others A-Z are lower-cased.
    """
    kind = _KIND[buf]
    for a, b in _NO_LETTER:
        kind[:-1][(buf[:-1] == a) & (buf[1:] == b)] = _WHOLE
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    inside = kind != _SPACE
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | cut[1:-1]
    piece = np.cumsum(opens, dtype=np.int32)
    whole = np.zeros(int(piece[-1]) + 1 if len(piece) else 1, bool)
    whole[piece[kind == _WHOLE]] = True
    kept = whole[piece] & inside
    kind[kept] = _WHOLE
    first = inside.copy()
    first[1:] &= cut[1:-1] | (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    return np.where(kept, buf, LOWER[buf]), np.flatnonzero(first), np.flatnonzero(last) + 1


class WordEncoder:
    """``encode(buf, offsets)`` gives the ids of all texts of a run, and how many each has."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.width = "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.pieces = _Pieces(tokenizer, self.width)
        self.table = _Table(self.width)

    def _rows(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Table rows of units, after the new ones have been added."""
        hashes, first, inverse = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        new = self.table.missing(hashes)
        if len(new) + len(self.table.hashes) > MAX_CACHED:
            self.table, new = _Table(self.width), np.arange(len(hashes))
        if len(new):
            text, piece = buf.tobytes(), self.pieces.piece
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist())
            self.table.add(hashes[new], [piece(text[a:b].decode("utf-8", "replace")) for a, b in spans])
        return np.searchsorted(self.table.hashes, hashes)[inverse]

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, starts, ends = units(buf, offsets)
        if len(starts):
            rows = self._rows(low, starts, ends)
            ids, size = self.table.spread(rows)
        else:
            ids, size = np.zeros(0, self.width), np.zeros(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        bounds = upto[np.searchsorted(starts, offsets)]
        odd = {k: got for k in _suspects(buf, offsets) if (got := self._whole(buf[offsets[k] : offsets[k + 1]])) is not None}
        if not odd:
            return ids, np.diff(bounds)
        parts = [odd[k] if k in odd else ids[bounds[k] : bounds[k + 1]] for k in range(len(offsets) - 1)]
        return np.concatenate(parts), np.array([len(x) for x in parts])

    def _whole(self, part: np.ndarray) -> np.ndarray | None:
        """The ids of a text if it has to be encoded as one."""
        text = part.tobytes().decode("utf-8", "replace")
        return np.array(self.pieces.whole(text), self.width) if _ODD.search(text) else None


def _suspects(buf: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Texts that may hold what ``_ODD`` looks for."""
    at = _CONTROL[buf]
    at[:-1] |= (buf[:-1] == ord("<")) & (buf[1:] == ord("|"))
    return np.unique(np.searchsorted(offsets, np.flatnonzero(at), side="right") - 1).tolist()


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One per worker process, so that its table serves all its tasks."""
    return WordEncoder(path)
