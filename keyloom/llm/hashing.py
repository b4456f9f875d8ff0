"""Vectorised hashing of words, for operators that work on Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S30, S27, S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on every bit."""
    x = (x ^ (x >> S30)) * M2
    x = (x ^ (x >> S27)) * M3
    return x ^ (x >> S31)


def split_words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased: bytes.split() parts at 0x20 and 0x09 to 0x0D only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def joined(*parts: np.ndarray) -> np.ndarray:
    """Hash of aligned sequences of hashes; order matters."""
    out = np.full(len(parts[0]), M1, dtype=np.uint64)
    for p in parts:
        out = mixed(out * M1 + p)
    return out


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of ``width`` words; of fewer words, the whole run's."""
    h = word_hashes(split_words(text))
    if not len(h):
        return h
    if len(h) < width:
        return joined(np.array([len(h)], dtype=np.uint64), *[h[i : i + 1] for i in range(len(h))])
    return np.unique(joined(*[h[i : len(h) - width + 1 + i] for i in range(width)]))
