"""What follows from the settings and the number of samples before any data is read."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np

from specloom.config import InvalidConfigError, SpectrumConfig
from specloom.functions.taper import taper


@dataclass(frozen=True)
class Geometry:
    """N window points, h shift of the interlaced chunks, m windows of a chunk, bins: the signed bins of the band."""

    config: SpectrumConfig
    n: int
    full: bool
    bins: tuple[int, ...]

    @property
    def h(self) -> int:
        return self.n // 2

    @property
    def m(self) -> int:
        return self.config.m

    @property
    def chunk_points(self) -> int:
        return self.n * self.m

    @cached_property
    def weights(self) -> np.ndarray:
        return taper(self.n, self.config.dt)

    @property
    def rows3(self) -> list[int]:
        """Bins of the rows of order 3."""
        return list(range(len(self.bins) // 2))

    @property
    def columns3(self) -> list[int]:
        """Bins of its columns: as the rows, or mirrored."""
        n = len(self.bins) // 2
        return list(range(n)) if self.config.s3_calc == "1/4" else list(range(1 - n, n))

    @property
    def transform_bins(self) -> list[int]:
        """Bins that the transform has: order 3 needs some beyond the band."""
        return list(range(-(self.n // 2), (self.n + 1) // 2)) if self.full else list(range(self.n // 2 + 1))

    def frequency(self, k: int) -> float:
        return k / (self.n * self.config.dt)

    def norm(self, order: int) -> float:
        return float(self.config.dt * np.sum(self.weights**order))

    def fitted(self, samples: int, orders: list[int], cross: list[tuple[int, ...]]) -> Geometry:
        """This geometry, or if the settings allow it and the samples are too few, that of the most windows a chunk for which
        they suffice; a warning says so. Where no number of windows does, this one, which check() rejects."""
        needed = max([*orders, *map(len, cross), 2])
        for m in range(self.m, needed - 1, -1) if self.config.fit_m else []:
            if samples // (self.n * m + self.h) >= 2:
                if m < self.m:
                    warnings.warn(f"{samples} samples are too few for chunks of {self.m} windows; they have {m}", stacklevel=3)
                return replace(self, config=replace(self.config, m=m))
        return self

    def check(self, samples: int, orders: list[int], cross: list[tuple[int, ...]]) -> None:
        """Raise where the reference estimators have no value: too few windows, chunks or samples."""
        needed = max([*orders, *map(len, cross), 1])
        if needed > 1 and self.m < needed:
            raise InvalidConfigError(f"order {needed} needs m of {needed} or more")
        if 3 in orders + [len(c) for c in cross] and self.config.f_min != 0:
            raise InvalidConfigError("order 3 needs f_min = 0")
        span = self.chunk_points + self.h
        if samples <= span:
            raise InvalidConfigError(f"not enough samples: {samples}, and a chunk and its shift take {span}")
        if samples // span < min(self.m, 2):
            raise InvalidConfigError("not enough samples for two chunks")


def geometry(config: SpectrumConfig) -> Geometry:
    """The geometry of a configuration. Window length and band follow from floating point expressions on purpose: they decide
    on which side of a bin a limit falls."""
    nyquist = 1 / (2 * config.dt)
    f_max = nyquist if config.f_max is None else config.f_max
    if f_max <= config.f_min:
        raise InvalidConfigError("f_max must be larger than f_min")
    length = (config.spectrum_size - 1) * (2 * config.dt * (nyquist / (f_max - config.f_min)))
    n = int(np.round(length / config.dt))
    if n < 2:
        raise InvalidConfigError("the window has fewer than two points")
    full = config.f_min < 0
    freq = np.fft.fftshift(np.fft.fftfreq(n, config.dt)) if full else np.fft.rfftfreq(n, config.dt)
    labels = range(-(n // 2), (n + 1) // 2) if full else range(n // 2 + 1)
    high, low = int(np.sum(freq <= f_max)), int(np.sum(freq < config.f_min))
    return Geometry(config, n, full, tuple(labels)[low:high])
