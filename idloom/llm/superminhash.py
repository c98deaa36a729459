"""SuperMinHash signatures of many sets at once, in numpy."""

from __future__ import annotations

import numpy as np

from idloom.llm.common import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Rounds in which the few earlier swaps are searched; later rounds keep a whole permutation per element.
_SPARSE_ROUNDS = 20


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """One row of m numbers per set of 64-bit hashes; two sets of similarity J agree in a share J of them.

    Each element draws a random permutation of the m places, one place a round, and offers there the value
    (round, random fraction); a place keeps its least value. Values of later rounds are always larger, so a
    set whose places are all taken has ended and its elements leave early. Empty sets keep the largest value.
    """
    out = np.full(len(sets) * m, np.iinfo(np.uint64).max, np.uint64)
    sizes = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    if not len(owner):
        return out.reshape(-1, m)
    state = np.concatenate(sets)
    swaps: list[tuple[np.ndarray, np.ndarray]] = []
    places: np.ndarray | None = None
    for j in range(m):
        state = state + _STEP
        draw = mix(state)
        k = j + ((draw & np.uint64(0xFFFF)) * np.uint64(m - j) >> np.uint64(16)).astype(np.int64)
        if j == _SPARSE_ROUNDS:
            places = np.tile(np.arange(m, dtype=np.uint16), (len(state), 1))
            rows = np.arange(len(state))
            for t, (at, moved) in enumerate(swaps):
                places[rows, t], places[rows, at] = places[rows, at], moved.astype(np.uint16)
        if places is None:
            mine, here = k.copy(), np.full(len(state), j)
            for at, moved in swaps:
                mine = np.where(at == k, moved, mine)
                here = np.where(at == j, moved, here)
            swaps.append((k, here))
        else:
            rows = np.arange(len(state))
            mine, here = places[rows, k].astype(np.int64), places[:, j].copy()
            places[rows, k] = here
        at = owner * m + mine
        free = np.flatnonzero(out[at] >= np.uint64(j << 48))
        np.minimum.at(out, at[free], np.uint64(j << 48) | (draw[free] >> np.uint64(16)))
        ended = (out.reshape(-1, m) < np.uint64((j + 1) << 48)).all(axis=1)
        stay = ~ended[owner]
        if not stay.all():
            if not stay.any():
                break
            owner, state = owner[stay], state[stay]
            swaps = [(a[stay], b[stay]) for a, b in swaps]
            places = None if places is None else places[stay]
    return out.reshape(-1, m)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number is part of it."""
    n, m = sig.shape
    parts = sig.reshape(n, bands, m // bands)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
    for i in range(parts.shape[2]):
        key = mix(key * _STEP + parts[:, :, i])
    return key
