"""64-bit hashes of words, word n-grams and shingle sets, vectorised over the bytes of a text.

A word is a run of bytes outside 0x20 and 0x09-0x0D. Its hash is a polynomial in a fixed odd
base modulo 2**64 over a random value per byte, mixed at the end. Texts are read in pieces of
``PIECE`` bytes, so memory beyond the text is bounded by its number of words.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 19
MASK = (1 << 64) - 1
BASE = 0xD1342543DE82EF95
_SPACES = b" \t\n\x0b\x0c\r"


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every bit over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stream(seed: int, n: int) -> np.ndarray:
    step = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(step + np.uint64(seed))


def byte_values(fold: bool = False, spaces: bytes = _SPACES) -> np.ndarray:
    """Value of each byte in a word; 0 marks a separator. ``fold``: A-Z count as a-z."""
    values = _stream(1, 256)
    if fold:
        values[65:91] = values[97:123]
    values[list(spaces)] = 0
    return values


EXACT, FOLDED = byte_values(), byte_values(fold=True)
_POWERS = np.cumprod(np.full(PIECE + 1, BASE, np.uint64))
_INVERSE = np.cumprod(np.full(PIECE + 1, pow(BASE, -1, 1 << 64), np.uint64))
_GRAM = _stream(2, 64) | np.uint64(1)


def word_hashes(text: bytes, values: np.ndarray = EXACT) -> np.ndarray:
    """One hash per word of the whole text, in order."""
    if len(text) <= PIECE:
        raw, _, _, _ = _piece(text, values)
        return mix(raw)
    found: list[np.ndarray] = []
    carry, length = 0, 0  # unfinished word at the end of the pieces so far
    for at in range(0, len(text), PIECE):
        raw, first, last, size = _piece(text[at : at + PIECE], values)
        if length and not first:
            found.append(np.array([carry], np.uint64))
            carry, length = 0, 0
        if length and len(raw):
            carry = (carry + int(raw[0]) * pow(BASE, length, 1 << 64)) & MASK
            if len(raw) > 1 or not last:
                found.append(np.array([carry], np.uint64))
                carry, length = 0, 0
            else:
                length += size
                continue
            raw = raw[1:]
        if last and len(raw):
            carry, length = int(raw[-1]), size
            raw = raw[:-1]
        found.append(raw)
    if length:
        found.append(np.array([carry], np.uint64))
    return mix(np.concatenate(found)) if found else np.empty(0, np.uint64)


def _piece(text: bytes, values: np.ndarray) -> tuple[np.ndarray, bool, bool, int]:
    """Raw hashes; whether a word touches the start, the end; bytes of the word at the end."""
    if not text:
        return np.empty(0, np.uint64), False, False, 0
    terms = values[np.frombuffer(text, np.uint8)]
    inside = terms != 0
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if inside[0]:
        starts = np.concatenate([[0], starts])
    if not len(starts):
        return np.empty(0, np.uint64), False, False, 0
    terms *= _POWERS[: len(terms)]
    raw = np.add.reduceat(terms, starts) * _INVERSE[starts]
    return raw, bool(inside[0]), bool(inside[-1]), len(text) - int(starts[-1])


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words (empty if there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = words[:n] * _GRAM[0]
    for j in range(1, k):
        total += words[j : j + n] * _GRAM[j]
    return mix(total)


def shingle_set(text: bytes, k: int = 5, values: np.ndarray = FOLDED) -> np.ndarray:
    """Sorted distinct k-word shingles; a shorter text is one shingle, no word gives none."""
    words = word_hashes(text, values)
    if 0 < len(words) < k:
        return mix((words * _GRAM[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    return np.unique(grams(words, k))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
