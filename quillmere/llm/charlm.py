"""Character language models with interpolated Kneser-Ney smoothing, in sorted hash arrays.

A text becomes symbols: lower-case letters as their code points and every run
of anything else as one space (0). N-grams of up to four symbols of 16 bits
pack into 64 bits; a multiplication by an odd number hashes that one to one, so
the sorted arrays have no collisions. Letters above U+FFFF are one symbol. One
array per order serves a group of ``GROUP`` languages: beside each hash stands a
row of log probabilities, one per language, already interpolated; n-grams that
none of them has seen back off by the array of context weights. A group's tables
hold only the n-grams of its own languages, so their size grows with the number
of languages and not with its square.
"""

from __future__ import annotations

import sys
from functools import cache

import numpy as np

ORDER = 4
_BITS = 16
_HASH = np.uint64(0x9E3779B97F4A7C15)
#: Languages whose n-grams share tables.
GROUP = 8
#: Symbols scored at once, which bounds memory on very long texts.
_STEP = 1 << 18


@cache
def _symbols_of_code_points() -> np.ndarray:
    """Symbol of each code point: 0 unless it is a letter."""
    table = np.zeros(sys.maxunicode + 1, np.uint16)
    for point in range(sys.maxunicode + 1):
        char = chr(point)
        if char.isalpha():
            lower = char.lower()
            table[point] = min(ord(lower) if len(lower) == 1 else point, 0xFFFF)
    return table


def symbols(text: str | None) -> np.ndarray:
    """Symbols of a text between spaces; empty if it holds no letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    found = _symbols_of_code_points()[points]
    kept = found != 0
    if not kept.any():
        return np.empty(0, np.uint16)
    kept[1:] |= found[:-1] != 0  # the first of the others after a letter
    found = found[kept]
    return np.concatenate([found, np.zeros(1 if found[-1] else 0, np.uint16)])


def grams(found: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Packed n-grams that end at each symbol; spaces stand before the first."""
    padded = np.concatenate([np.zeros(order - 1, np.uint16), found]).astype(np.uint64)
    packed = np.zeros(len(found), np.uint64)
    for k in range(order):
        packed = (packed << np.uint64(_BITS)) | padded[k : k + len(found)]
    return packed


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (_BITS * order)) - 1)


class CharModels:
    """Models of several languages; ``cross_entropy`` scores a text under all of them."""

    def __init__(self, groups: list[_Tables]):
        self.groups = groups
        self.languages = [x for g in groups for x in g.languages]

    @staticmethod
    def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]], alphabet: int | None = None) -> CharModels:
        """From {language: (packed n-grams of the highest order, their counts)}; ``alphabet`` counts symbols that may follow."""
        known = sorted(counts)
        if alphabet is None:
            alphabet = len(np.unique(np.concatenate([k & _mask(1) for k, _ in counts.values()]))) + 1 if counts else 2
        return CharModels([_Tables({x: counts[x] for x in known[at : at + GROUP]}, max(2, alphabet)) for at in range(0, len(known), GROUP)])

    def cross_entropy(self, found: np.ndarray) -> np.ndarray:
        """Nats per symbol under each language."""
        packed = grams(found)
        total = np.concatenate([g.log_prob(packed) for g in self.groups] or [np.zeros(0)])
        return -total / max(1, len(packed))


class _Tables:
    """Sorted hash arrays of the languages of a group."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], alphabet: int):
        self.languages = sorted(counts)
        languages, tables = self.languages, [_Tables._counts_by_order(*counts[x]) for x in self.languages]
        self.floor = -np.log(alphabet)
        self.hashes, self.logs, self.context_hashes, self.context_logs = {}, {}, {}, {}  # by order, 1 to ORDER
        below: tuple[np.ndarray, np.ndarray] | None = None
        for order in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([t[order][0] for t in tables]))
            contexts = np.unique(keys >> np.uint64(_BITS))
            probs = np.zeros((len(keys), len(languages)))
            weights = np.ones((len(contexts), len(languages)))
            for n, table in enumerate(tables):
                own, count = table[order]
                discount = _Tables._discount(count)
                at = np.searchsorted(contexts, own >> np.uint64(_BITS))
                total = np.bincount(at, count, len(contexts))
                types = np.bincount(at, minlength=len(contexts))
                seen = total > 0
                weights[seen, n] = discount * types[seen] / total[seen]
                probs[np.searchsorted(keys, own), n] = (count - discount) / total[at]
            if below is None:
                lower = np.full(probs.shape, 1 / alphabet)
            else:
                lower = below[1][np.searchsorted(below[0], keys & _mask(order - 1))]
            probs += weights[np.searchsorted(contexts, keys >> np.uint64(_BITS))] * lower
            below = keys, probs
            for part, by, to_hash, to_log in ((keys, probs, self.hashes, self.logs), (contexts, weights, self.context_hashes, self.context_logs)):
                hashed = part * _HASH
                rank = np.argsort(hashed)
                to_hash[order], to_log[order] = hashed[rank], np.log(by[rank]).astype(np.float32)

    @staticmethod
    def _counts_by_order(keys: np.ndarray, count: np.ndarray) -> dict:
        """Counts of the highest order; below, in how many ways an n-gram continues to the left."""
        rank = np.argsort(keys)
        tables = {ORDER: (keys[rank], count[rank].astype(float))}
        for order in range(ORDER - 1, 0, -1):
            own, n = np.unique(tables[order + 1][0] & _mask(order), return_counts=True)
            tables[order] = own, n.astype(float)
        return tables

    @staticmethod
    def _discount(count: np.ndarray) -> float:
        once, twice = (count == 1).sum(), (count == 2).sum()
        return float(min(0.95, max(0.05, once / (once + 2 * twice)))) if once else 0.5

    def _find(self, table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(table, wanted)
        at[at == len(table)] = 0
        return at, table[at] == wanted

    def _log_probs(self, packed: np.ndarray, order: int) -> np.ndarray:
        if not order:
            return np.full((len(packed), len(self.languages)), self.floor, np.float32)
        at, found = self._find(self.hashes[order], packed * _HASH)
        out = self.logs[order][at]
        if not found.all():
            rest = packed[~found]
            lower = self._log_probs(rest & _mask(order - 1) if order > 1 else rest, order - 1)
            at, known = self._find(self.context_hashes[order], (rest >> np.uint64(_BITS)) * _HASH)
            lower[known] += self.context_logs[order][at[known]]
            out[~found] = lower
        return out

    def log_prob(self, packed: np.ndarray) -> np.ndarray:
        """Sum of the log probabilities of packed n-grams under each language."""
        total = np.zeros(len(self.languages))
        for at in range(0, len(packed), _STEP):
            total += self._log_probs(packed[at : at + _STEP], ORDER).sum(axis=0, dtype=np.float64)
        return total
