"""What a decoder makes of a recording."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


def logger_of(name: str) -> logging.Logger:
    """A logger that says nothing unless someone has set it up, also in a worker that has imported nothing."""
    logger = logging.getLogger(name)
    if not logger.hasHandlers():
        logger.addHandler(logging.NullHandler())
    return logger


@dataclass
class Decoded:
    """read(start, n): channels by samples; nothing of them is read before. time: only if the file stores one.

    ranged: whether `read` costs only what it returns. warnings: what is odd about the recording, in words.
    """

    rate: float
    n_samples: int
    descriptions: list[str] | None
    read: Callable[[int, int], np.ndarray] | None
    time: np.ndarray | None = None
    single: bool = False
    time_aligned: bool = True
    channels: int | None = None
    ranged: bool = False
    warnings: list[str] = field(default_factory=list)

    @property
    def n_channels(self) -> int:
        return self.channels if self.channels is not None else len(self.descriptions or [])

    @property
    def data(self) -> np.ndarray | None:
        """All samples, or nothing if only the header was asked for."""
        return None if self.read is None else self.read(0, self.n_samples)

    def warn(self, logger: logging.Logger, text: str) -> None:
        logger.warning(text)
        self.warnings.append(text)


def nothing(start: int, n: int) -> np.ndarray:
    """The samples of a recording without channels."""
    return np.zeros((0, 0))
