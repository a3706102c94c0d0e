"""SuperMinHash signatures over distinct shingle hashes, computed for many sets at once.

Each element walks through a random permutation of the m slots; in step j it offers j + r, with
r uniform in [0, 1), to the step's slot. A slot keeps its smallest offer. A set is done once
the largest kept offer is below j, since later steps offer at least j: sets much larger than m
need about two steps. Offers are 32-bit integers, j above 24 random bits.
"""

from __future__ import annotations

import numpy as np

from weftline.llm.words import mix

_U = np.uint64
_EMPTY = np.uint32(0xFFFFFFFF)


def superminhash(elements: np.ndarray, ends: np.ndarray, m: int = 128) -> np.ndarray:
    """(sets, m) uint32 signatures; ``elements`` holds each set's distinct hashes from ends[i] to ends[i + 1]."""
    if not 1 <= m <= 255:
        raise ValueError("1 to 255 slots")
    sets = len(ends) - 1
    sig = np.full(sets * m, _EMPTY, np.uint32)
    owner = np.repeat(np.arange(sets), np.diff(ends))
    live, order = elements, None
    for j in range(m):
        if not len(live):
            break
        draw = mix(live + _U(0x9E3779B97F4A7C15 * (j + 1) & 0xFFFFFFFFFFFFFFFF))
        offer = (draw >> _U(40)).astype(np.uint32) | np.uint32(j << 24)
        k = j + ((draw & _U(0xFFFFFF)) * _U(m - j) >> _U(24)).astype(np.int64)
        if order is None:
            slot = k
        else:
            row = np.arange(len(live))
            slot = order[row, k].astype(np.int64)
            order[row, k] = order[:, j]
        np.minimum.at(sig, owner * m + slot, offer)
        most = (sig.reshape(sets, m) >> np.uint32(24)).max(axis=1)
        stay = most[owner] > j  # another step may still lower a slot
        if order is None:
            live, owner, k = live[stay], owner[stay], k[stay]
            order = np.tile(np.arange(m, dtype=np.uint8), (len(live), 1))
            row = np.arange(len(live))
            order[row, k] = 0
            order[:, 0] = k
        elif not stay.all():
            live, owner, order = live[stay], owner[stay], order[stay]
    return sig.reshape(sets, m)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """(sets, m // rows) int64 keys: each hashes a band's number with its slots."""
    sets, m = sig.shape
    bands = m // rows
    cut = sig[:, : bands * rows].reshape(sets, bands, rows).astype(_U)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=_U)), (sets, bands)).copy()
    for k in range(rows):
        key = mix(key * _U(0xD6E8FEB86659FD93) + cut[:, :, k] + _U(1))
    return key.view(np.int64)
