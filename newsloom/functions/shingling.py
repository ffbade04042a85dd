"""Vectorised word hashing and word shingles for Arrow batches (numpy, no per-row Spark UDFs)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_S31, _S29 = np.uint64(31), np.uint64(29)


def _table(extra: bytes) -> bytes:
    keep = b"abcdefghijklmnopqrstuvwxyz0123456789" + extra
    out = bytearray(b" " * 256)
    for c in keep:
        out[c] = c
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        out[c] = c + 32
    return bytes(out)


WORDS_APOSTROPHE = _table(b"'")
WORDS_PLAIN = _table(b"")


def words(text: str, table: bytes = WORDS_APOSTROPHE) -> list[bytes]:
    """Lower-case runs of ASCII letters and digits (and apostrophes, by the table); all else separates."""
    return text.encode("utf-8", "replace").translate(table).split()


class WordHash(dict):
    """word -> 64-bit hash, kept between documents and emptied when it grows beyond ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def hashed(ws: list[bytes], memo: WordHash) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, ws), dtype=np.uint64, count=len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the word."""
    x = (x ^ (x >> _S31)) * _MIX
    return x ^ (x >> _S29)


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of every run of ``k`` words, in text order; empty where the text has fewer words."""
    n = len(h) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= _MUL
        out += h[i : i + n]
    return mix(out)


def text_columns(batches: Iterator, *names: str) -> Iterator[tuple[list, ...]]:
    """Python lists of the named columns of each record batch."""
    for b in batches:
        yield tuple(b.column(b.schema.get_field_index(n)).to_pylist() for n in names)
