"""Ids of text pieces, kept by the piece's 64-bit name."""

from __future__ import annotations

import numpy as np

CACHE_PIECES = 500_000  # emptied beyond: a worker's memory stays bounded


class PieceMemo:
    def __init__(self, limit: int = CACHE_PIECES):
        self.limit = limit
        self.clear()

    def clear(self):
        self.names = np.zeros(0, np.uint64)  # sorted
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def lay_out(self, names: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, offsets per piece).

        ``make`` gets the places of one piece for each new name and returns
        (their ids, id counts).
        """
        distinct, where, back = np.unique(names, return_index=True, return_inverse=True)
        known = self._known(distinct)
        if not known.all():
            if len(self.names) > self.limit:
                self.clear()
                known[:] = False
            new = np.flatnonzero(~known)
            ids, counts = make(where[new])
            first = np.cumsum(counts) - counts + len(self.ids)
            place = np.searchsorted(self.names, distinct[new])  # the new names are sorted too
            self.names = np.insert(self.names, place, distinct[new])
            self.first = np.insert(self.first, place, first)
            self.count = np.insert(self.count, place, counts)
            self.ids = np.concatenate([self.ids, ids])
        pos = np.searchsorted(self.names, distinct)
        first, count = self.first[pos][back], self.count[pos][back]
        upto = np.concatenate([[0], np.cumsum(count)])
        return self.ids[np.repeat(first - upto[:-1], count) + np.arange(upto[-1])], upto

    def _known(self, distinct: np.ndarray) -> np.ndarray:
        pos = np.searchsorted(self.names, distinct)
        known = np.zeros(len(distinct), bool)
        inside = pos < len(self.names)
        known[inside] = self.names[pos[inside]] == distinct[inside]
        return known
