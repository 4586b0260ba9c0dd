"""Validated settings of an analysis."""

from __future__ import annotations

from dataclasses import dataclass, field

TIME_UNITS = {"Hz": "s", "kHz": "ms", "MHz": "us", "GHz": "ns", "THz": "ps"}
S3_CALCS = ("1/4", "1/2")


class InvalidConfigError(ValueError):
    """A setting, or a combination of settings and data, that has no result."""


def _positive_int(name: str, value) -> None:
    if not isinstance(value, int) or isinstance(value, bool) or value <= 0:
        raise InvalidConfigError(f"{name} must be a positive integer")


def _number(name: str, value) -> None:
    if not isinstance(value, (int, float)) or isinstance(value, bool):
        raise InvalidConfigError(f"{name} must be a number")


@dataclass(frozen=True)
class SpectrumConfig:
    """How spectra are estimated. dt: sampling interval; f_max: by default Nyquist; f_min below 0 asks for signed frequencies,
    which have no order 3; spectrum_size sets the window length; m: windows of a chunk; m_var: chunks of an error batch;
    break_after: chunks used for a key at most, by default all; method: 'kernel', an FFT in Arrow groups,
    'relational', joins and aggregations alone, or 'auto', the faster, which is the kernel at all lengths that were measured;
    fit_m: whether chunks of fewer windows may be taken, with a warning, where the signal is too short for m."""

    dt: float
    f_unit: str = "Hz"
    f_max: float | None = None
    f_min: float = 0
    s3_calc: str = "1/4"
    spectrum_size: int = 100
    order_in: str | list[int] | tuple[int, ...] = "all"
    m: int = 10
    m_var: int = 10
    break_after: int | None = None
    method: str = "auto"
    fit_m: bool = False

    def __post_init__(self) -> None:
        if not isinstance(self.dt, float) or self.dt <= 0:
            raise InvalidConfigError("dt must be a positive float")
        if self.f_unit not in TIME_UNITS:
            raise InvalidConfigError(f"f_unit must be one of {', '.join(TIME_UNITS)}")
        if self.s3_calc not in S3_CALCS:
            raise InvalidConfigError("s3_calc must be '1/4' or '1/2'")
        _number("f_min", self.f_min)
        if self.f_max is not None:
            _number("f_max", self.f_max)
            if self.f_max <= self.f_min:
                raise InvalidConfigError("f_max must be larger than f_min")
        for name in ("spectrum_size", "m", "m_var"):
            _positive_int(name, getattr(self, name))
        if self.break_after is not None:
            _positive_int("break_after", self.break_after)
        if self.spectrum_size < 2:
            raise InvalidConfigError("spectrum_size must be 2 or more")
        if self.order_in != "all":
            if not isinstance(self.order_in, (list, tuple)) or not self.order_in or not set(self.order_in) <= {1, 2, 3, 4}:
                raise InvalidConfigError("order_in must be 'all' or a list of orders from 1 to 4")
        if self.m_var < 2:
            raise InvalidConfigError("m_var must be 2 or more")
        if self.method not in ("auto", "relational", "kernel"):
            raise InvalidConfigError("method must be 'auto', 'relational' or 'kernel'")
        if not isinstance(self.fit_m, bool):
            raise InvalidConfigError("fit_m must be a bool")

    def orders(self) -> list[int]:
        """The orders of auto spectra: with signed frequencies, not the third."""
        wanted = [1, 2, 3, 4] if self.order_in == "all" else sorted(set(self.order_in))
        return [n for n in wanted if n != 3 or self.f_min >= 0]


@dataclass(frozen=True)
class Dataset:
    """Where a channel's samples are: a file, the group in it if they are in one, and the name of the dataset. dt: the sampling
    interval, if the file doesn't say."""

    path: str
    dataset: str
    group: str | None = None
    dt: float | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.path, str) or not isinstance(self.dataset, str) or not self.path or not self.dataset:
            raise InvalidConfigError("a path and the name of a dataset are needed")
        if self.group is not None and not isinstance(self.group, str):
            raise InvalidConfigError("group must be a name")
        if self.dt is not None and (not isinstance(self.dt, float) or self.dt <= 0):
            raise InvalidConfigError("dt must be a positive float")


@dataclass(frozen=True)
class CrossConfig:
    """Which spectra: auto_corr for single channels, and tuples of channels for cross spectra of order 2, 3 and 4."""

    auto_corr: bool = True
    cross_corr_2: list[tuple[int, int]] | None = None
    cross_corr_3: list[tuple[int, int, int]] | None = None
    cross_corr_4: list[tuple[int, int, int, int]] | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.auto_corr, bool):
            raise InvalidConfigError("auto_corr must be a bool")
        for n in (2, 3, 4):
            for key in getattr(self, f"cross_corr_{n}") or []:
                if not isinstance(key, tuple) or len(key) != n or not all(isinstance(c, int) and not isinstance(c, bool) for c in key):
                    raise InvalidConfigError(f"cross_corr_{n} must be a list of tuples of {n} channels")

    def keys(self, channels: list[int]) -> list[tuple[int, ...]]:
        """The cross keys, each once; a key that names another channel than `channels` is an error."""
        found = [key for n in (2, 3, 4) for key in getattr(self, f"cross_corr_{n}") or []]
        for key in found:
            if not set(key) <= set(channels):
                raise InvalidConfigError(f"cross key {key} names a channel that isn't selected: {channels}")
        return list(dict.fromkeys(found))


@dataclass(frozen=True)
class ViewConfig:
    """How results are shown: frequency limits, orders, significance (sigmas), arcsinh scaling (on, alpha), components."""

    f_min: float
    f_max: float
    display_orders: list[int] = field(default_factory=lambda: [1, 2, 3, 4])
    significance: int = 1
    arcsinh_scale: tuple[bool, float] = (False, 0.02)
    plot_format: list[str] = field(default_factory=lambda: ["re", "im"])
    insignif_transparency: float = 0.8

    def __post_init__(self) -> None:
        _number("f_min", self.f_min)
        _number("f_max", self.f_max)
        if self.f_min >= self.f_max:
            raise InvalidConfigError("f_max must be larger than f_min")
        if not isinstance(self.display_orders, list) or not set(self.display_orders) <= {1, 2, 3, 4}:
            raise InvalidConfigError("display_orders must be a list of orders from 1 to 4")
        _positive_int("significance", self.significance)
        on, alpha = self.arcsinh_scale
        _number("arcsinh_scale's alpha", alpha)
        if not isinstance(on, bool) or alpha < 0:
            raise InvalidConfigError("arcsinh_scale must be a bool and a non-negative number")
        if not self.plot_format or not set(self.plot_format) <= {"re", "im"}:
            raise InvalidConfigError("plot_format must hold 're', 'im' or both")
        _number("insignif_transparency", self.insignif_transparency)
        if not 0 <= self.insignif_transparency <= 1:
            raise InvalidConfigError("insignif_transparency must be from 0 to 1")
