"""Value types and time."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T

from .errors import InvalidCast

NS = 1_000_000_000


class dtype(Enum):  # noqa: N801
    bool_ = 0
    int64 = 1
    uint64 = 2
    float64 = 3

    @classmethod
    def convert(cls, kind) -> dtype:
        """A dtype, or the one of bool, int or float."""
        if isinstance(kind, cls):
            return kind
        found = {bool: cls.bool_, int: cls.int64, float: cls.float64}.get(kind)
        if found is None:
            raise TypeError(f"no signal type for {kind!r}")
        return found

    def __int__(self) -> int:
        return self.value

    @property
    def spark(self) -> T.DataType:
        return {0: T.BooleanType(), 1: T.LongType(), 2: T.DecimalType(20, 0), 3: T.DoubleType()}[self.value]

    @property
    def numeric(self) -> bool:
        return self is not dtype.bool_

    def check(self, value):
        """value as this type, or InvalidCast; a fraction is cut off where an integer is asked for."""
        if self is dtype.bool_:
            if isinstance(value, bool):
                return value
            raise InvalidCast(value, "bool")
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise InvalidCast(value, self.name)
        if self is dtype.float64:
            return float(value)
        if value != value or value in (float("inf"), float("-inf")):
            raise InvalidCast(value, self.name)
        value, low, high = int(value), *((-(2**63), 2**63 - 1) if self is dtype.int64 else (0, 2**64 - 1))
        if not low <= value <= high:
            raise InvalidCast(value, self.name)
        return value


def nanos(seconds: float) -> int:
    """Seconds, not negative, as nanoseconds."""
    if seconds != seconds or seconds < 0 or seconds == float("inf"):
        raise ValueError(f"a time is a finite number of seconds, not below 0: {seconds}")
    return round(seconds * NS)
