"""Least squares on any subset of columns, one column in or out at a time, without solving anew."""

from __future__ import annotations

import numpy as np

LEAST_PIVOT = 1e-10
"""A column whose rest, after the columns before it, holds a smaller share of its spread counts as explained by them."""


class Sweep:
    """Regression of the last column of a Gram matrix of ``[1, columns, target]`` on the columns brought in.

    ``gram`` is of the rows that are fitted, ``held`` of those that are scored. ``flip`` brings column k (from 1; 0 is
    the constant, which is always in) in or takes it out in O(p²); ``errors`` gives the squared error on the held rows
    after every possible flip at once. A column that the others explain is noted as ``idle``: it adds nothing, and
    takes the place of one of those that explain it when that goes.
    """

    def __init__(self, gram: np.ndarray, held: np.ndarray) -> None:
        total = gram + held
        spread = np.diag(total) - total[0] ** 2 / max(total[0, 0], 1.0)
        self.scale = np.sqrt(np.maximum(spread, 0.0))
        self.scale[0] = np.sqrt(max(total[0, 0], 1.0))
        # A spread that is all rounding is that of a constant column.
        self.scale[self.scale <= 1e-13 * np.sqrt(np.diag(total))] = 1.0
        self.state = gram / np.outer(self.scale, self.scale)
        # Cross products, over the held rows, of what is left of each column (columns out) or stands for it (columns in).
        self.held = held / np.outer(self.scale, self.scale)
        self.inside = np.zeros(len(gram), dtype=bool)
        self.idle = np.zeros(len(gram), dtype=bool)
        self.limit = LEAST_PIVOT * np.maximum(np.diag(self.state), 1.0)
        self.start = self.state.copy(), self.held.copy()
        self.turns = 0
        self.flip(0)

    def _turn(self, k: int) -> None:
        pivot = self.state[k, k]
        share = self.state[:, k] / pivot
        share[k] = 0.0
        self.held -= np.outer(share, self.held[k])
        self.held -= np.outer(self.held[:, k], share)
        self.held[k] /= abs(pivot)
        self.held[:, k] /= abs(pivot)
        row = self.state[k].copy()
        self.state -= np.outer(share, row)
        self.state[k] = self.state[:, k] = row / abs(pivot)
        self.state[k, k] = -1.0 / pivot
        self.inside[k] = not self.inside[k]
        self.turns += 1

    def _renew(self) -> None:
        """Bring the same columns in anew: rounding adds up from turn to turn, most of all by small pivots."""
        inside = np.flatnonzero(self.inside)
        self.state, self.held = (m.copy() for m in self.start)
        self.inside[:] = False
        for k in inside:
            self._turn(k)
        self.turns = 0

    def flip(self, k: int) -> None:
        if self.idle[k]:
            self.idle[k] = False
        elif self.inside[k]:
            self._turn(k)
            for other in np.flatnonzero(self.idle):
                if self.state[other, other] > self.limit[other]:
                    self.idle[other] = False
                    self._turn(other)
        elif self.state[k, k] > self.limit[k]:
            self._turn(k)
        else:
            self.idle[k] = True
        # As many turns as columns pay for bringing all of them in anew.
        if self.turns > len(self.state):
            self._renew()

    def errors(self) -> np.ndarray:
        """Squared error on the held rows after flipping each column; of the target's own place that of no flip."""
        pivots = np.diag(self.state)
        free = np.where(self.inside, True, pivots > self.limit) & ~self.idle
        if self.idle.any():
            # An idle column takes the place of a column that helps to explain it.
            free &= ~(self.inside & (np.abs(self.state[:, self.idle]) > 1e-6).any(axis=1))
        free[-1] = False
        step = np.where(free, self.state[:, -1] / np.where(free, pivots, 1.0), 0.0)
        found = self.held[-1, -1] - 2 * step * self.held[:, -1] + step**2 * np.diag(self.held)
        return np.maximum(found, 0.0) * self.scale[-1] ** 2

    def weights(self) -> np.ndarray:
        """The coefficient of every column; 0 outside and for idle ones."""
        return np.where(self.inside, self.state[:, -1], 0.0)[1:-1] * self.scale[-1] / self.scale[1:-1]
