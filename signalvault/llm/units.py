"""Ids of text units that repeat: each distinct unit is encoded once, the rest is gathered."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import islice, repeat

import numpy as np

from signalvault.llm.common import ragged


class UnitCache:
    """Ids per unit. When it holds more than ``limit`` units it keeps the half it met first, which has the frequent
    ones, so its memory is bounded."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 800_000) -> None:
        self.encode, self.limit = encode, limit
        self.number: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _add(self, units: list[str]) -> None:
        flat, lengths = self.encode(units)
        n, used = len(self.number), self.used + len(flat)
        while used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(units) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.flat[self.used:used] = flat
        self.bounds[n + 1:n + 1 + len(units)] = self.used + np.cumsum(lengths)
        self.number.update(zip(units, range(n, n + len(units))))
        self.used = used

    def ids(self, units: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each unit has."""
        if len(self.number) > self.limit:
            kept = self.limit // 2
            self.number = dict(islice(self.number.items(), kept))
            self.used = int(self.bounds[kept])
        at = np.fromiter(map(self.number.get, units, repeat(-1)), np.int64, len(units))
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            missing = [units[i] for i in fresh.tolist()]
            self._add(list(dict.fromkeys(missing)))
            at[fresh] = np.fromiter(map(self.number.__getitem__, missing), np.int64, len(missing))
        starts = self.bounds[at]
        lengths = self.bounds[at + 1] - starts
        return self.flat[ragged(starts, lengths)], lengths
