"""Signals in the driver.  No Spark."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from vigil import BoolSignal, FloatSignal, IntSignal, Signal, Trace, UnsignedIntSignal, dtype
from vigil.errors import InvalidCast, InvalidPush, NonMonotonicSignal

VALUES = {BoolSignal: st.booleans(), IntSignal: st.integers(-(2**63), 2**63 - 1), UnsignedIntSignal: st.integers(0, 2**64 - 1), FloatSignal: st.floats(allow_nan=False, allow_infinity=False)}


@given(st.data())
def test_create_and_push(data):
    cls = data.draw(st.sampled_from(list(VALUES)))
    times = sorted(data.draw(st.sets(st.integers(0, 2**32 - 1), min_size=2, max_size=12)))
    samples = [(t / 1000, data.draw(VALUES[cls])) for t in times]
    s = cls.from_samples(samples)
    assert list(s) == samples and s.start_time == samples[0][0] and s.end_time == samples[-1][0] and not s.is_empty()
    other = cls()
    for t, v in samples:
        other.push(t, v)
    assert list(other) == samples
    for t, v in samples:
        assert s.at(t) == v and s.sample_at(t) == v
    with pytest.raises(NonMonotonicSignal):
        cls.from_samples([samples[1], samples[0]])
    with pytest.raises(RuntimeError):
        s.push(samples[-1][0], samples[-1][1])


def test_forms():
    empty, c = FloatSignal(), FloatSignal.constant(2)
    assert empty.is_empty() and empty.at(1) is None and empty.start_time is None and empty.time_points == []
    assert not c.is_empty() and c.at(9) == 2.0 and c.start_time is None and c.time_points is None and list(c) == []
    with pytest.raises(InvalidPush):
        c.push(0, 1.0)
    assert FloatSignal.zero().at(0) == 0 and IntSignal.one().at(0) == 1 and BoolSignal.const_true().at(0) is True and BoolSignal.const_false().at(5) is False
    assert c.kind is dtype.float64 and "constant 2.0" in repr(c)
    for bad in (lambda: Signal(), lambda: FloatSignal(interpolation_method="nearest"), lambda: FloatSignal.from_samples([(-1, 1.0)]), lambda: FloatSignal.from_samples([(0, float("nan"))])):
        with pytest.raises((NotImplementedError, ValueError)):
            bad()
    for cls, v in ((BoolSignal, 1), (IntSignal, "1"), (UnsignedIntSignal, -1), (IntSignal, 2**63)):
        with pytest.raises(InvalidCast):
            cls.constant(v)


def test_interpolation():
    line = FloatSignal.from_samples([(1, 1.0), (3, 5.0)])
    assert [line.at(t) for t in (0, 1, 2, 3, 4)] == [1, 1, 3, 5, 5] and line.sample_at(2) is None
    step = FloatSignal.from_samples([(1, 1.0), (3, 5.0)], interpolation_method="constant")
    assert step.at(2.9) == 1 and IntSignal.from_samples([(0, 0), (2, 5)]).at(1) == 2
    assert BoolSignal.from_samples([(0, False), (2, True)]).at(1.9) is False


def test_trace():
    t = Trace({"a": BoolSignal(), "x": FloatSignal()})
    assert t.signal_names() == ["a", "x"] and t.get("a", dtype.bool_) is not None and t.get("a", dtype.int64) is None and t.get("z", dtype.bool_) is None
    with pytest.raises(TypeError):
        Trace({"a": 1})
