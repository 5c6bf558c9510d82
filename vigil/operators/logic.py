"""Operators on signal tables (trace, t, v) and constants: connectives on truth values, powers on numbers.

Two signals are taken over the times of both, where both have a value; truth values are held between samples.
"""

from __future__ import annotations

import math
import operator

from ..functions import numeric
from ..functions.interpolation import METHODS, Held, Method
from . import align
from .align import Sig


def not_(x: Sig) -> Sig:
    return align.unary(x, operator.invert, operator.not_)


def _connective(columns, constants):
    def over(x: Sig, y: Sig, how: Method = METHODS["constant"]) -> Sig:
        return align.binary(x, y, columns, constants, Held() if how.name == "linear" else how, False)

    return over


and_ = _connective(lambda a, b: a & b, lambda a, b: a and b)
or_ = _connective(lambda a, b: a | b, lambda a, b: a or b)
xor = _connective(lambda a, b: a != b, operator.ne)
equiv = _connective(lambda a, b: a == b, operator.eq)
implies = _connective(lambda a, b: ~a | b, lambda a, b: not a or b)


def power(x: Sig, y: Sig, how: Method = METHODS["linear"]) -> Sig:
    """x to the power of y, at the times of both."""
    return align.binary(x, y, numeric.power, math.pow, how, False)
