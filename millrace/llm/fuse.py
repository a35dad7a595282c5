"""Static binary-fuse filters over 64-bit keys, built with numpy.

A key hits three slots in neighbouring segments; the xor of their bytes equals the key's
fingerprint. Building peels slots that hold a single key, round by round, and fills them in reverse.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A strong 64-bit mix of keys and seed (the finaliser of a public generator)."""
    with np.errstate(over="ignore"):
        x = keys + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _slots(mixed: np.ndarray, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = ((mixed >> _U(32)) * _U(segments)) >> _U(32)
    low, mask, base = mixed, _U(segment - 1), first.astype(np.int64) * segment
    return (
        base + (low & mask).astype(np.int64),
        base + segment + ((low >> _U(10)) & mask).astype(np.int64),
        base + 2 * segment + ((low >> _U(20)) & mask).astype(np.int64),
    )


def _print(mixed: np.ndarray) -> np.ndarray:
    return ((mixed ^ (mixed >> _U(32)) ^ (mixed >> _U(17))) & _U(0xFF)).astype(np.uint8)


def shape(n: int) -> tuple[int, int]:
    """Slots of a segment and starting segments for n keys."""
    segment = 1 << max(2, min(10, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    return segment, max(1, -(-int(n * factor + 64) // segment))


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, slots of a segment, starting segments, table) of distinct 64-bit keys."""
    keys = np.unique(np.asarray(keys).astype(np.int64).view(_U))
    segment, segments = shape(len(keys))
    for seed in range(1000):
        if seed % 10 == 9:
            segments += segments // 8 + 1
        mixed = _mix(keys, seed)
        slots = np.stack(_slots(mixed, segment, segments))
        size = segment * (segments + 2)
        order = _peel(slots, size)
        if order is not None:
            table, prints = np.zeros(size, np.uint8), _print(mixed)
            for who, at in reversed(order):
                a, b, c = slots[:, who]
                table[at] = prints[who] ^ table[a] ^ table[b] ^ table[c]
            return seed, segment, segments, table.tobytes()
    raise RuntimeError("no seed peels all keys")


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, their slots); None if some keys stay. A slot of a round holds one key only, so a round's keys don't depend on each other."""
    n = slots.shape[1]
    count = np.bincount(slots.ravel(), minlength=size)
    who = np.zeros(size, np.int64)
    ids = np.arange(n)
    for row in slots:
        np.bitwise_xor.at(who, row, ids)
    left, rounds = n, []
    ready = np.flatnonzero(count == 1)
    while len(ready):
        keys, first = np.unique(who[ready], return_index=True)
        rounds.append((keys, ready[first]))
        left -= len(keys)
        touched = slots[:, keys].ravel()
        np.subtract.at(count, touched, 1)
        np.bitwise_xor.at(who, touched, np.tile(keys, 3))
        touched = np.unique(touched)
        ready = touched[count[touched] == 1]
    return rounds if left == 0 else None


def contains(keys: np.ndarray, seed: int, segment: int, segments: int, table: bytes) -> np.ndarray:
    """Whether each key may be in the set: never false for one that is, true for 1 of 256 others."""
    mixed = _mix(np.asarray(keys).astype(np.int64).view(_U), seed)
    slots, cells = _slots(mixed, segment, segments), np.frombuffer(table, np.uint8)
    return (cells[slots[0]] ^ cells[slots[1]] ^ cells[slots[2]]) == _print(mixed)
