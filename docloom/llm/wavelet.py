"""A wavelet tree over numbers, for reports of many ranges at once.

The tree stands for points (place, number). Each level holds, for one bit of the numbers, how many zeros come before
a place, and orders the numbers for the next level by that bit, zeros first. A rectangle of places and numbers is
followed down all levels at once with every other one; halves without places, or outside the wanted numbers, end.
"""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Numbers from 0 on, at places 0, 1, ..."""

    def __init__(self, numbers: np.ndarray):
        self.bits = max(1, int(numbers.max(initial=0)).bit_length())
        self.zeros = []  # by level: zeros before each place
        for b in reversed(range(self.bits)):
            zero = (numbers >> b) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero, dtype=np.int64)]))
            numbers = np.concatenate([numbers[zero], numbers[~zero]])

    def report(self, first: np.ndarray, end: np.ndarray, least: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rectangle, and which number in it, for each place in ``[first, end)`` whose number is in ``[least, above)``.

        A number that stands at several places of a rectangle is reported once for each.
        """
        which, base = np.arange(len(first)), np.zeros(len(first), dtype=np.int64)
        for b, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            half = 1 << b
            a0, e0 = zeros[first], zeros[end]
            a1, e1 = zeros[-1] + first - a0, zeros[-1] + end - e0
            low = (e0 > a0) & (base < above[which]) & (base + half > least[which])
            high = (e1 > a1) & (base + half < above[which]) & (base + 2 * half > least[which])
            first, end = np.concatenate([a0[low], a1[high]]), np.concatenate([e0[low], e1[high]])
            which, base = np.concatenate([which[low], which[high]]), np.concatenate([base[low], base[high] + half])
        return np.repeat(which, end - first), np.repeat(base, end - first)
