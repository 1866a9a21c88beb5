"""Shingle sets and their fast similarity sketches (pure NumPy; no Spark)."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS, ROWS, BANDS = 5, 4, 36
SLOTS = ROWS * BANDS
_U = np.uint64
#: Odd multipliers by place in a shingle, the finaliser's multipliers and shifts.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; of the whole sequence with fewer words; none without words.

    A-Z are lower-cased; white space is ASCII's.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, _U)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in words], _U)
    n = max(1, len(h) - WORDS + 1)
    total = np.full(n, len(h) if len(h) < WORDS else WORDS, _U)
    for k in range(min(WORDS, len(h))):
        total += h[k : k + n] * _PLACES[k]
    return np.unique(_mixed(total))


def sketch(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """One value a slot, equal in two sets' sketches with the probability of their similarity.

    In round i each element falls into one slot with a value; a slot keeps the
    least value of the first round that reached it.  Rounds slots .. 2*slots-1
    put all elements into one slot each, in turn, so every slot fills.
    """
    out = np.zeros(slots, _U)
    empty = np.ones(slots, bool)
    done = 0
    while done < slots and empty.any():
        rounds = min(slots - done, max(1, -(-slots * 5 // len(elements))))
        seeds = _mixed(np.arange(done + 1, done + rounds + 1, dtype=_U) * _PLACES[0])
        h = _mixed(elements[None, :] ^ seeds[:, None])
        slot = (h >> _U(32)) * _U(slots) >> _U(32)
        # Slot, round, value: one sort finds each slot's first round and least value.
        key = np.sort((slot << _U(54) | np.arange(done, done + rounds, dtype=_U)[:, None] << _U(44) | (_mixed(h) >> _U(20))).reshape(-1))
        at = (key >> _U(54)).astype(np.int64)
        first = np.concatenate(([True], at[1:] != at[:-1]))
        s, v = at[first], key[first]
        new = empty[s]
        out[s[new]] = v[new]
        empty[s[new]] = False
        done += rounds
    for s in np.nonzero(empty)[0].tolist():
        out[s] = _U(s) << _U(54) | _U(slots + s) << _U(44) | (_mixed(elements ^ _mixed(_U(slots + s + 1) * _PLACES[1:2])).min() >> _U(20))
    return out


def bands(sketch_: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash for each run of rows values, as signed 64-bit; the values hold their slot, so bands don't mix."""
    parts = sketch_.reshape(-1, rows)
    total = np.zeros(len(parts), _U)
    for k in range(rows):
        total = _mixed(total * _PLACES[1] + parts[:, k])
    return total.view(np.int64)


def digest(sketch_: np.ndarray) -> bytes:
    """A byte a slot: where two sketches agree, their digests do; elsewhere they do once in 256."""
    return (_mixed(sketch_) >> _U(56)).astype(np.uint8).tobytes()


def set_key(elements: np.ndarray) -> bytes:
    """Equal sets have equal keys."""
    return xxhash.xxh3_128_digest(elements.tobytes())


def similar(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """100 * intersection >= percent * union."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.unique(np.concatenate((a, b))))
    return 100 * both >= percent * (len(a) + len(b) - both)
