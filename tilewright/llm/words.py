"""Words of texts as 64-bit hashes, a whole batch at a time.

A word is a run of letters and digits; case, accents, punctuation and invisible characters don't count.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np

_OTHER, _WORD, _GONE, _UNKNOWN = 0, 1, 2, 255
_classes = np.full(0x110000, _UNKNOWN, np.uint8)
_classes[:128] = [_WORD if chr(c).isalnum() else _OTHER for c in range(128)]
_BASE = np.uint64(0x9E3779B97F4A7C15)  # an odd number; powers of it tell positions in a word apart
_powers = np.ones(1, np.uint64)

#: Texts are handled in pieces of about this many characters, cut at white space; only memory depends on it.
PIECE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64 over all (xor-shift and multiply, twice)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def plain(text: str) -> str:
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())


def _classify(codes: np.ndarray) -> np.ndarray:
    kinds = _classes[codes]
    new = kinds == _UNKNOWN
    if new.any():
        for c in np.unique(codes[new]):
            kind = unicodedata.category(chr(c))
            _classes[c] = _WORD if kind[0] in "LN" else _GONE if kind[0] == "M" or kind == "Cf" else _OTHER
        kinds = _classes[codes]
    return kinds


def _hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts one after another, and each text's number of words."""
    global _powers
    joined = "\x00".join(plain(t) for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _classify(codes)
    text_no = np.cumsum(codes == 0)  # texts hold no NUL: see split()
    stays = kinds != _GONE
    if not stays.all():
        codes, kinds, text_no = codes[stays], kinds[stays], text_no[stays]
    inside = kinds == _WORD
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    chars, first = codes[inside].astype(np.uint64), np.flatnonzero(starts[inside])
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    sizes = np.diff(np.append(first, len(chars)))
    while len(_powers) < sizes.max():
        _powers = np.concatenate([_powers, _powers * _BASE ** np.uint64(len(_powers))])
    at = np.arange(len(chars)) - np.repeat(first, sizes)
    words = mix(np.add.reduceat(mix(chars + np.uint64(1)) * _powers[at], first))
    return words, np.bincount(text_no[starts], minlength=len(texts))


def split(text: str) -> list[str]:
    """Pieces of about PIECE characters, cut where words end."""
    text = text.replace("\x00", " ")
    if len(text) <= PIECE:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not text[end].isspace():
            end += 1
        out.append(text[at:end])
        at = end
    return out


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and each text's number of words. None and empty texts have none."""
    parts: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    pieces: list[str] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if pieces:
            h, n = _hashes(pieces)
            parts.append(h)
            np.add.at(counts, owners, n)
            pieces.clear()
            owners.clear()
            size = 0

    for i, t in enumerate(texts):
        for piece in split(t or ""):
            pieces.append(piece)
            owners.append(i)
            size += len(piece)
            if size >= PIECE:
                flush()
    flush()
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash for each ``size`` words in a row; the last size-1 words begin none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = h * _BASE + words[j : n + j]
    return mix(h)
