"""SuperMinHash signatures of many sets at once.

Each element walks through its own random permutation of the slots: at step ``j`` it offers ``j + u``
to the ``j``-th slot of the permutation, ``u`` uniform. A slot keeps the smallest offer. One element
never hits a slot twice, which makes slots negatively correlated and the estimate less spread than
with independent hashes. Once every slot of a set holds an offer below ``j``, later steps cannot
change anything, and the set drops out: long sets stop after a few steps.

NumPy takes one step for all live elements together. Permutations are swapped in place (one byte per
element and slot), for at most ``CHUNK`` elements at a time, so memory does not grow with a set.
"""

from __future__ import annotations

import numpy as np

from tallymart.llm.textbatch import mix

CHUNK = 1 << 15
_EMPTY = np.uint64(2**64 - 1)
_STEP = 0xD1B54A32D192ED03
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def signatures(elements: np.ndarray, counts: np.ndarray, slots: int) -> np.ndarray:
    """One row of ``slots`` values per set; ``counts`` elements of ``elements`` belong to each set.

    A value holds the step in its upper and the uniform draw in its lower 32 bits. Empty sets keep
    the largest value everywhere. Repeated elements change nothing.
    """
    if not 0 < slots <= 256:
        raise ValueError("slots must be between 1 and 256")
    table = np.full((len(counts), slots), _EMPTY, np.uint64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for low in range(0, len(elements), CHUNK):
        _offer(table, owner[low : low + CHUNK], elements[low : low + CHUNK], slots)
    return table


def _offer(table: np.ndarray, owner: np.ndarray, elements: np.ndarray, slots: int) -> None:
    flat = table.reshape(-1)
    order = None
    for j in range(slots):
        live = (table[owner[0] : owner[-1] + 1].max(axis=1) >> _32) >= j
        alive = live[owner - owner[0]]
        if not alive.all():
            at = np.flatnonzero(alive)
            if not len(at):
                return
            owner, elements = owner[at], elements[at]
            order = order[at] if order is not None else None
        draw = mix(elements + np.uint64((j + 1) * _STEP & 0xFFFFFFFFFFFFFFFF))
        pick = j + ((draw >> _32) * np.uint64(slots - j) >> _32).astype(np.int64)
        if j == 0:
            slot = pick
            first = pick
        else:
            rows = np.arange(len(owner))
            if order is None:  # built late: most sets are done after the first step
                order = np.tile(np.arange(slots, dtype=np.uint8), (len(owner), 1))
                chosen = first[at] if len(first) != len(owner) else first
                order[rows, chosen] = 0
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, j]
        np.minimum.at(flat, owner * slots + slot, (np.uint64(j) << _32) | (draw & _LOW))


def band_keys(table: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per set and band of neighbouring slots; equal only in the same band."""
    rows = table.shape[1] // bands
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_STEP), (len(table), bands)).copy()
    for k in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + table[:, k : bands * rows : rows])
    return keys
