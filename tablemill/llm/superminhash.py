"""SuperMinHash signatures (Ertl 2017), vectorised over the elements of many sets.

Each element draws a random permutation of the slots and one uniform value per step; slot ``p[j]`` takes the least
``j + value`` of all elements. The slots of an element are so correlated that signatures vary less than with independent
hashes. A set stops early, after step j, when every slot holds a value below ``j + 1``: no later step can lower any.
"""

from __future__ import annotations

import numpy as np

from tablemill.llm.shingles import mix

CHUNK = 200_000  # elements worked on together
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _chunk(sets: list[np.ndarray], slots: int) -> np.ndarray:
    sizes = np.array([len(s) for s in sets])
    signature = np.full((len(sets), slots), EMPTY, np.uint64)
    element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = None
    for j in range(slots):
        drawn = mix(element + np.uint64(j + 1) * _GOLD)
        pick = j + (((drawn >> _HALF) * np.uint64(slots - j)) >> _HALF).astype(np.int64)
        if order is None:
            slot = pick
        else:
            row = np.arange(len(element))
            slot = order[row, pick].astype(np.int64)
            order[row, pick] = order[row, j]
            order[row, j] = slot
        np.minimum.at(signature.reshape(-1), owner * slots + slot, (np.uint64(j) << _HALF) | (drawn & _LOW))
        going = (signature.max(axis=1) >> _HALF) > np.uint64(j)
        stays = going[owner]
        if not stays.any():
            break
        if order is None:
            element, owner, pick = element[stays], owner[stays], pick[stays]
            order = np.tile(np.arange(slots, dtype=np.uint16), (len(element), 1))
            row = np.arange(len(element))
            order[row, pick], order[row, 0] = 0, pick
        elif not stays.all():
            element, owner, order = element[stays], owner[stays], order[stays]
    return signature


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """One row of ``slots`` 64-bit values per set; an empty set keeps ``EMPTY`` everywhere."""
    with np.errstate(over="ignore"):
        out, at = [], 0
        while at < len(sets):
            end, held = at, 0
            while end < len(sets) and (end == at or held + len(sets[end]) <= CHUNK):
                held += len(sets[end])
                end += 1
            out.append(_chunk(sets[at:end], slots))
            at = end
        return np.concatenate(out) if out else np.empty((0, slots), np.uint64)
