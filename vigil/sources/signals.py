"""Signals of one trace in the driver, for building, looking up and reading results."""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

from ..errors import InvalidPush, NonMonotonicSignal
from ..types import NS, dtype, nanos


class Signal:
    """Empty until the first push; ``constant`` and ``from_samples`` make the other forms."""

    _kind: dtype

    def __init__(self, *, interpolation_method: str = "linear"):
        if type(self) is Signal:
            raise NotImplementedError("make a BoolSignal, IntSignal, UnsignedIntSignal or FloatSignal")
        if interpolation_method not in ("linear", "constant"):
            raise ValueError(f"interpolation is linear or constant, not {interpolation_method!r}")
        self.interpolation_method, self.value = interpolation_method, None
        self._times: list[int] = []
        self._values: list = []

    @classmethod
    def constant(cls, value, *, interpolation_method: str = "linear"):
        out = cls(interpolation_method=interpolation_method)
        out.value = cls._kind.check(value)
        return out

    @classmethod
    def from_samples(cls, samples: Iterable[tuple[float, object]], *, interpolation_method: str = "linear"):
        out = cls(interpolation_method=interpolation_method)
        for t, v in samples:
            out.push(t, v)
        return out

    @classmethod
    def zero(cls, **how):
        return cls.constant(cls._kind.check(0 if cls._kind.numeric else False), **how)

    @classmethod
    def one(cls, **how):
        return cls.constant(cls._kind.check(1 if cls._kind.numeric else True), **how)

    def push(self, time: float, value) -> None:
        if self.value is not None:
            raise InvalidPush
        self._push(nanos(time), self._kind.check(value))

    def _push(self, t: int, value) -> None:
        if self._kind is dtype.float64 and value != value:
            raise ValueError("a sample is not NaN")
        if self._times and t <= self._times[-1]:
            raise NonMonotonicSignal(self._times[-1] / NS, t / NS)
        self._times.append(t)
        self._values.append(value)

    @property
    def kind(self) -> dtype:
        return self._kind

    def is_empty(self) -> bool:
        return self.value is None and not self._times

    @property
    def start_time(self) -> float | None:
        return self._times[0] / NS if self._times else None

    @property
    def end_time(self) -> float | None:
        return self._times[-1] / NS if self._times else None

    @property
    def time_points(self) -> list[float] | None:
        return None if self.value is not None else [t / NS for t in self._times]

    def __iter__(self) -> Iterator[tuple[float, object]]:
        return ((t / NS, v) for t, v in zip(self._times, self._values, strict=True))

    def __len__(self) -> int:
        return len(self._times)

    def sample_at(self, time: float):
        """The value of the sample at exactly this time, or None."""
        t = nanos(time)
        i = bisect.bisect_left(self._times, t)
        return self.value if self.value is not None else self._values[i] if i < len(self._times) and self._times[i] == t else None

    def at(self, time: float):
        """The value at any time by the signal's interpolation; before the first and after the last sample theirs; None if empty."""
        if self.value is not None or not self._times:
            return self.value
        t = nanos(time)
        i = bisect.bisect_left(self._times, t)
        if i == len(self._times):
            return self._values[-1]
        if self._times[i] == t or i == 0:
            return self._values[i]
        a, b = self._values[i - 1], self._values[i]
        if self._kind is dtype.bool_ or self.interpolation_method == "constant" or abs(a) == float("inf") or abs(b) == float("inf"):
            return a
        x = (t - self._times[i - 1]) / (self._times[i] - self._times[i - 1])
        v = x * b + (1 - x) * a if a <= 0 <= b or b <= 0 <= a else a + x * (b - a)
        return v if self._kind is dtype.float64 else int(v)

    def __repr__(self) -> str:
        what = f"constant {self.value}" if self.value is not None else f"{len(self._times)} samples"
        return f"{type(self).__name__}({what}, {self.interpolation_method})"


class BoolSignal(Signal):
    _kind = dtype.bool_

    @classmethod
    def const_true(cls, **how):
        return cls.constant(True, **how)

    @classmethod
    def const_false(cls, **how):
        return cls.constant(False, **how)


class IntSignal(Signal):
    _kind = dtype.int64


class UnsignedIntSignal(Signal):
    _kind = dtype.uint64


class FloatSignal(Signal):
    _kind = dtype.float64


class Trace:
    """Names with signals."""

    def __init__(self, signals: dict[str, Signal]):
        for name, s in signals.items():
            if not isinstance(name, str) or not isinstance(s, Signal):
                raise TypeError("a trace maps names to signals")
        self.signals = dict(signals)

    def signal_names(self) -> list[str]:
        return list(self.signals)

    def get(self, name: str, kind: dtype) -> Signal | None:
        """The signal of this name if it has this type."""
        found = self.signals.get(name)
        return found if found is not None and found.kind is kind else None
