"""Zero-phase Butterworth bandpass filtering: design on the driver, and a kernel that steps through many series at once."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

import numpy as np

#: Error at which overlapping blocks of a long series are cut off from each other.
TOLERANCE = 1e-17
#: Series above this length are cut into blocks of at least this length.
LONGEST = 16_384


@dataclass(frozen=True)
class Bandpass:
    """Sections: rows b0, b1, b2, a1, a2. pad: samples of odd extension at each end."""

    sections: np.ndarray
    pad: int
    overlap: int

    @property
    def initial(self) -> np.ndarray:
        """Each section's states after a long constant input of 1."""
        states, level = [], 1.0
        for b0, b1, b2, a1, a2 in self.sections:
            out = level * (b0 + b1 + b2) / (1 + a1 + a2)
            states.append((out - b0 * level, b2 * level - a2 * out))
            level = out
        return np.array(states)


def design(order: int, low: float, high: float, rate: float) -> Bandpass:
    """The filter for a total order (even; half of it in each direction) and cut-off frequencies in Hz.

    The edges are divided by (sqrt(2) - 1)^(1 / (2 order)) and kept inside (1e-6, 0.999) of half the rate.
    """
    if order < 2 or order % 2:
        raise ValueError(f"the order must be even and 2 or more, not {order}")
    if rate <= 0 or low <= 0 or high <= 0 or low >= high:
        raise ValueError(f"frequencies must satisfy 0 < low < high and rate > 0, not {low}, {high}, {rate}")
    half, stretch = order // 2, (2**0.5 - 1) ** (1 / (2 * order))
    edges = np.clip(2 * np.array([low, high]) / (rate * stretch), 1e-6, 0.999)
    if edges[0] >= edges[1]:
        raise ValueError(f"both cut-off frequencies are above what a rate of {rate} Hz can carry")
    below, above = 4 * np.tan(np.pi * edges / 2)  # bilinear transform at rate 2
    width, middle = above - below, (below * above) ** 0.5
    angles = np.pi * (2 * np.arange(half) + 1 + half) / (2 * half)
    lowpass = np.exp(1j * angles) * width / 2
    root = np.sqrt(lowpass**2 - middle**2 + 0j)
    analog = np.concatenate([lowpass + root, lowpass - root])
    gain = (width**half) * (4.0**half) / np.prod(4 - analog).real
    poles = (4 + analog) / (4 - analog)
    sections = []
    for a1, a2 in paired(poles):
        sections.append([1.0, 0.0, -1.0, a1, a2])
    sections[0][:3] = [gain, 0.0, -gain]
    radius = float(np.abs(poles).max())
    return Bandpass(np.array(sections), 3 * (order + 1), ceil(log(TOLERANCE) / log(radius)) if radius < 1 else LONGEST)


def paired(poles: np.ndarray) -> list[tuple[float, float]]:
    """Denominators of second-order sections: conjugate pairs, and real poles two by two; those nearest the circle last."""
    upper = sorted(poles[poles.imag > 1e-12], key=abs)
    real = sorted(poles[np.abs(poles.imag) <= 1e-12].real)
    out = [(-2 * p.real, abs(p) ** 2) for p in upper]
    return [(-(p + q), p * q) for p, q in zip(real[::2], real[1::2], strict=True)] + out


def advance(x: np.ndarray, sections: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter the columns of x (samples by series), and the states after it. states: sections by 2 by series."""
    y, after = x.copy(), states.copy()
    for i, (b0, b1, b2, a1, a2) in enumerate(sections):
        s1, s2 = after[i, 0].copy(), after[i, 1].copy()
        for t in range(len(y)):
            value = y[t].copy()
            out = b0 * value + s1
            s1 = b1 * value - a1 * out + s2
            s2 = b2 * value - a2 * out
            y[t] = out
        after[i] = s1, s2
    return y, after


def step_through(x: np.ndarray, sections: np.ndarray, states: np.ndarray) -> np.ndarray:
    """Filter the columns of x (samples by series). states: sections by 2 by series."""
    return advance(x, sections, states)[0]


def one_way(series: list[np.ndarray], f: Bandpass) -> list[np.ndarray]:
    """Filter each series forwards, from the steady state of its first sample. Long ones in overlapping blocks."""
    jobs, block = [], max(LONGEST, 4 * f.overlap)
    for i, x in enumerate(series):
        for first in range(0, len(x), block if len(x) > LONGEST else len(x)):
            lead = min(first, f.overlap)
            jobs.append((i, first, lead, x[first - lead : first + block if len(x) > LONGEST else len(x)]))
    out = [np.empty(len(x)) for x in series]
    jobs.sort(key=lambda j: len(j[3]))
    for some in batches(jobs):
        m = np.zeros((max(len(j[3]) for j in some), len(some)))
        begin = np.zeros(len(some))
        for k, (_, first, _, x) in enumerate(some):
            m[: len(x), k] = x
            begin[k] = x[0] if first == 0 else 0.0
        y = step_through(m, f.sections, f.initial[:, :, None] * begin)
        for k, (i, first, lead, x) in enumerate(some):
            out[i][first : first + len(x) - lead] = y[lead : len(x), k]
    return out


def batches(jobs: list, most: int = 4_000_000) -> list[list]:
    """Jobs of like lengths together, in matrices of bounded size."""
    out: list[list] = []
    for j in jobs:
        if out and len(out[-1]) and len(j[3]) * (len(out[-1]) + 1) <= most and len(j[3]) <= 2 * len(out[-1][0][3]) + 64:
            out[-1].append(j)
        else:
            out.append([j])
    return out


def zero_phase(series: list[np.ndarray], f: Bandpass) -> list[np.ndarray]:
    """Filter each series forwards and backwards, over odd extensions of `pad` samples at both ends."""
    for x in series:
        if len(x) <= f.pad:
            raise ValueError(f"a series of {len(x)} samples is too short: the filter needs more than {f.pad}")
    p = f.pad
    long = [np.concatenate([2 * x[0] - x[p:0:-1], x, 2 * x[-1] - x[-2 : -p - 2 : -1]]) for x in (np.asarray(s, float) for s in series)]
    forth = one_way(long, f)
    back = one_way([y[::-1] for y in forth], f)
    return [y[::-1][p:-p] for y in back]
