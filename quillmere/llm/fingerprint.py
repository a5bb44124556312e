"""SimHash fingerprints of word shingles, computed on whole texts.

The pure functions here run inside Arrow batches on the executors; they hold
no Spark state, so tests call them directly.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Rows that can be summed in one byte, and such blocks at once, which bounds memory on very long texts.
_BYTE, _BLOCKS = 255, 64


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.

    ``bytes.lower`` touches ASCII letters only and ``bytes.split`` cuts on
    exactly the six ASCII white-space characters, so both work on UTF-8 bytes.
    """
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``width`` words (all words, if there are fewer)."""
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(starts))


def majority_bits(hashes: np.ndarray) -> int:
    """64-bit number whose bits are set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BYTE * _BLOCKS):
        part = np.ascontiguousarray(hashes[at : at + _BYTE * _BLOCKS], "<u8").view(np.uint8)
        bits = np.unpackbits(part, bitorder="little").reshape(-1, 64)
        whole = len(bits) // _BYTE * _BYTE
        ones += bits[:whole].reshape(-1, _BYTE, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of a whole text; null and blank texts have fingerprint zero."""
    return majority_bits(shingle_hashes(words_of(text), width, seed))
