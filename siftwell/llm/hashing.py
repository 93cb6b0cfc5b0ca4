"""Hashes of words and word shingles with numpy, inside tasks."""

from __future__ import annotations

import hashlib

import numpy as np

_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _c in range(65, 91):  # A-Z count as a-z
    _BYTE[_c] = _BYTE[_c + 32]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_MIX = _SEED.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Texts are hashed in pieces of about so many bytes, cut between words.
PIECE = 1 << 20

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (a public finaliser of a well-known hash function)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _hash_piece(raw: np.ndarray) -> np.ndarray:
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    if not len(edge):
        return np.empty(0, np.uint64)
    first, last = edge[::2], edge[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _power(_BASE, len(raw)), out=sums[1:])
    return mixed((sums[last] - sums[first]) * _power(_INVERSE, len(raw))[first])


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each run of anything but ASCII white space, A-Z as a-z."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) <= PIECE:
        return _hash_piece(raw)
    out, at = [], 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while end < len(raw) and not _SPACE[raw[end]]:
            gap = np.flatnonzero(_SPACE[raw[end : end + PIECE]])
            end = end + int(gap[0]) if len(gap) else min(end + PIECE, len(raw))
        out.append(_hash_piece(raw[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width`` consecutive words; of the whole sequence, if it is shorter; none without words."""
    if not len(words):
        return np.empty(0, np.uint64)
    width_here = min(width, len(words))
    n = len(words) - width_here + 1
    total = np.full(n, (width_here * int(_MIX[-1])) % 2**64, np.uint64)
    for k in range(width_here):
        total += words[k : k + n] * _MIX[k]
    return np.unique(mixed(total))


def sequence_digest(words: np.ndarray) -> bytes:
    """16 bytes that stand for a sequence of words."""
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()
