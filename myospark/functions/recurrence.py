"""The bandpass filter as a recurrence that can be cut anywhere: an affine map of its states.

Filtering a block from the states s ends in the states T s + e, where T depends on the block's length alone and e is what the block leaves
behind from zero states. These maps compose, so the states before every block follow from a scan over (T, e), and the blocks' outputs
from zero states need only the response to the states before them added.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np

from myospark.functions.butterworth import Bandpass, advance

#: Samples of a column; samples that are stepped through together, about.
STEP, MOST = 256, 1 << 22


class Recurrence:
    """States are vectors: two numbers for each section."""

    def __init__(self, f: Bandpass):
        self.f, self.size = f, 2 * len(f.sections)
        self.initial = f.initial.ravel()
        self.known: dict[int, np.ndarray] = {}

    def _zero_input(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Output (n by states) and states after n zeros, from each unit state."""
        y, after = advance(np.zeros((n, self.size)), self.f.sections, np.eye(self.size).reshape(-1, 2, self.size))
        return y, after.reshape(self.size, self.size)

    @cached_property
    def response(self) -> tuple[np.ndarray, np.ndarray]:
        return self._zero_input(STEP)

    @cached_property
    def single(self) -> np.ndarray:
        return self._zero_input(1)[1]

    def transition(self, n: int) -> np.ndarray:
        """T of a block of n samples."""
        if n not in self.known:
            self.known[n] = np.linalg.matrix_power(self.single, n)
        return self.known[n]

    def run(self, series: list[np.ndarray], states: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Outputs and the states after them, of series that start from these states.

        All series are cut into columns of STEP samples, which are stepped through together from zero states. A series' first column is
        short: zeros stand before it, which leave zero states as they are.
        """
        outputs: list[np.ndarray] = []
        after: list[np.ndarray] = []
        for some in together(series):
            rows = min(STEP, max((len(series[i]) for i in some), default=0)) or 1
            edges = np.cumsum([0, *(-(-len(series[i]) // rows) for i in some)])
            whole = np.zeros((rows, edges[-1]))
            for i, a, b in zip(some, edges, edges[1:], strict=False):
                flat = np.zeros((b - a) * rows)
                flat[len(flat) - len(series[i]) :] = series[i]
                whole[:, a:b] = flat.reshape(b - a, rows).T
            out, left = advance(whole, self.f.sections, np.zeros((len(self.f.sections), 2, edges[-1])))
            left, (response, step) = left.reshape(self.size, edges[-1]), self.response  # several columns have STEP rows
            for i, a, b in zip(some, edges, edges[1:], strict=False):
                n, now, before = len(series[i]), np.asarray(states[i], float), np.zeros((self.size, b - a))
                short = n - (b - a - 1) * rows
                for k in range(a, b):
                    before[:, k - a] = now
                    now = (self.transition(short) if k == a else step) @ now + left[:, k]
                y = out[:, a:b]
                if b > a:
                    y[rows - short :, 0] += response[:short] @ before[:, 0]
                if b > a + 1:
                    y[:, 1:] += response @ before[:, 1:]
                outputs.append(y.T.ravel()[(b - a) * rows - n :])
                after.append(now)
        return outputs, after

    def left_by(self, series: list[np.ndarray]) -> list[np.ndarray]:
        """e of each: the states after it, from zero states."""
        return self.run(series, [np.zeros(self.size)] * len(series))[1]


def together(series: list[np.ndarray]) -> Iterator[range]:
    """Runs of series of about MOST samples."""
    first, held = 0, 0
    for i, x in enumerate(series):
        held += len(x)
        if held >= MOST or i == len(series) - 1:
            yield range(first, i + 1)
            first, held = i + 1, 0


def starts(r: Recurrence, sizes: list[int], left: list[np.ndarray], first: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The states before each of the blocks, and after the last."""
    out, now = [], first
    for n, e in zip(sizes, left, strict=True):
        out.append(now)
        now = r.transition(n) @ now + e
    return out, now
