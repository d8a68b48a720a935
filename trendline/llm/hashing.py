"""Hashes of many stretches of bytes at once, from prefix sums of a polynomial."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Any odd numbers with well mixed bits will do.
BASE, MIX = 0xD1342543DE82EF95, 0x9E3779B97F4A7C15


def mixed(values: np.ndarray) -> np.ndarray:
    """The hashes with their bits spread, in place."""
    values ^= values >> np.uint64(31)
    values *= np.uint64(MIX)
    values ^= values >> np.uint64(29)
    return values


class PrefixHash:
    """Hashes stretches of an array of bytes without cutting them out."""

    def __init__(self, longest: int):
        self._powers(longest)

    def _powers(self, longest: int) -> None:
        steps = np.ones(longest + 1, np.uint64)
        steps[1:] = BASE
        self.up = np.cumprod(steps)
        steps[1:] = pow(BASE, -1, 1 << 64)
        self.down = np.cumprod(steps)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            self._powers(2 * len(data))
        found = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * self.up[: len(data)], out=found[1:])
        return found

    def stretches(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The hash of the bytes between each start and stop."""
        prefix = self.prefix(data)
        return mixed((prefix[stops] - prefix[starts]) * self.down[starts])

    def windows(self, data: np.ndarray, length: int) -> np.ndarray:
        """The hash of every stretch of some length."""
        prefix = self.prefix(data)
        return mixed((prefix[length:] - prefix[:-length]) * self.down[: len(data) - length + 1])
