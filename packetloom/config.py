"""Immutable options shared by the operators."""

from __future__ import annotations

import math
from dataclasses import dataclass

MICROS = 1_000_000


@dataclass(frozen=True)
class WindowSpec:
    """Input grid and sequence geometry, in integer microseconds."""

    size_us: int = 5_000_000
    stride_us: int = 2_500_000
    seq_len: int = 10
    horizon_k: int = 4

    def __post_init__(self) -> None:
        if min(self.size_us, self.stride_us) <= 0:
            raise ValueError("window size and stride must be positive")
        if self.stride_us > self.size_us:
            raise ValueError("a stride wider than the window leaves uncovered time")
        if min(self.seq_len, self.horizon_k) < 1:
            raise ValueError("seq_len and horizon_k must be at least 1")

    @property
    def pane_us(self) -> int:
        """Widest slice of time that tiles both the stride and the window."""
        return math.gcd(self.size_us, self.stride_us)

    @property
    def input_span_us(self) -> int:
        """Distance from the first input start to the last input end."""
        return (self.seq_len - 1) * self.stride_us + self.size_us

    @property
    def horizon_us(self) -> int:
        return self.horizon_k * self.size_us

    @property
    def aligned(self) -> bool:
        """True when every future target window is itself a grid window."""
        return self.size_us % self.stride_us == 0


@dataclass(frozen=True)
class SplitSpec:
    train_frac: float = 0.70
    val_frac: float = 0.15
    buffer: int = 14
    seed: int = 42
