"""Token ids of text units, encoded once per distinct unit and worker and laid out per text by numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Distinct units a worker remembers; beyond it the memo starts anew, which costs time and changes no result.
MEMO_UNITS = 1_000_000
#: Bytes of their texts likewise.
MEMO_BYTES = 64 << 20


class UnitMemo:
    """Ids of units by 64-bit hash; a hit counts where the bytes agree too. ``encode`` turns units (bytes) into (ids end to end, ids per unit).

    ``lower``: units that differ in the case of A-Z are one unit, as their hashes are.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = MEMO_UNITS, lower: bool = False):
        self.encode, self.limit = encode, limit
        self._fold = np.arange(256, dtype=np.uint8)
        if lower:
            self._fold[65:91] += 32
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        # narrow columns: the limits keep the pools far below 2**32 entries
        self.at, self.size, self.text_at, self.text_size = (np.zeros(0, np.uint32) for _ in range(4))
        self.ids, self.text = _Pool(np.uint32), _Pool(np.uint8)

    def _add(self, keys: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> None:
        ids, sizes = self.encode(_cut(data, start, end))
        length = end - start
        place = np.searchsorted(self.keys, keys)        # both ascend
        at, text_at = self.ids.add(ids), self.text.add(self._fold[data[ragged(start, length)]])
        for name, new in (("keys", keys), ("at", at + np.cumsum(sizes) - sizes), ("size", sizes), ("text_at", text_at + np.cumsum(length) - length),
                          ("text_size", length)):
            held = getattr(self, name)
            setattr(self, name, np.insert(held, place, new.astype(held.dtype)))

    def ids_of(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units end to end, ids per unit) for the units at ``start`` to ``end`` of ``data``."""
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > self.limit or self.text.used > MEMO_BYTES:
            self._clear()
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == distinct[inside]
        if not known.all():
            new = first[~known]
            self._add(distinct[~known], start[new], end[new], data)
            place = np.searchsorted(self.keys, distinct)
        place = place[back]
        at, size = self.at[place].astype(np.int64), self.size[place].astype(np.int64)
        other = self._differs(place, start, end, data)
        if not len(other):
            return self.ids.held[ragged(at, size)], size
        ids, sizes = self.encode(_cut(data, start[other], end[other]))     # same hash, other bytes
        size[other], at[other] = sizes, self.ids.used + np.cumsum(sizes) - sizes
        return np.concatenate([self.ids.held[:self.ids.used], ids])[ragged(at, size)], size

    def _differs(self, place: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Units whose bytes are not those of their entries."""
        length = end - start
        wrong = length != self.text_size[place]
        same = np.flatnonzero(~wrong)
        there = self.text_at[place[same]].astype(np.int64)
        unequal = self._fold[data[ragged(start[same], length[same])]] != self.text.held[ragged(there, length[same])]
        if unequal.any():
            wrong[same[np.searchsorted(np.cumsum(length[same]), np.flatnonzero(unequal), "right")]] = True
        return np.flatnonzero(wrong)


class _Pool:
    """A growing array."""

    def __init__(self, kind: type):
        self.held, self.used = np.zeros(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> int:
        """The place of the first value."""
        first, self.used = self.used, self.used + len(values)
        if self.used > len(self.held):
            more = max(self.used - len(self.held), len(self.held) // 4)
            self.held = np.concatenate([self.held, np.zeros(more, self.held.dtype)])
        self.held[first:self.used] = values
        return first


def _cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(start.tolist(), end.tolist())]


def ragged(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of stretches that begin at ``at`` and have ``size`` elements, end to end."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = at - (np.cumsum(size) - size)
    return np.arange(total) + np.repeat(shift, size)
