"""Small traces with known answers."""

import pytest

from vigil import BoolSignal, FloatSignal, IntSignal, Trace, eval_bool_semantics, eval_robust_semantics, parse_expr
from vigil import Always, Cmp, ConstFloat, ConstInt, Eventually, Next, Until, VarBool, VarFloat, VarInt, numbers
from vigil.errors import InvalidInterval, SignalNotPresent
from vigil.sources.frames import from_trace

A = [(0, 1.3), (0.7, 3.0), (1.3, 0.1), (2.1, -2.2)]
B = [(0, 2.5), (0.7, 4.0), (1.3, -1.2), (2.1, 1.7)]


def floats(**signals):
    return Trace({k: FloatSignal.from_samples(v) for k, v in signals.items()})


def bools(**signals):
    return Trace({k: BoolSignal.from_samples(v) for k, v in signals.items()})


def close(signal, expected):
    got = list(signal)
    assert [round(t, 8) for t, _ in got] == pytest.approx([t for t, _ in expected], abs=1e-8)
    assert [v for _, v in got] == pytest.approx([v for _, v in expected], abs=1e-7)


def test_addition(spark):
    out = numbers(VarFloat("a") + VarFloat("b"), from_trace(spark, floats(a=A, b=B))).orderBy("t").collect()
    assert [r["t"] for r in out] == [0, 700_000_000, 1_300_000_000, 2_100_000_000]
    assert [r["v"] for r in out] == pytest.approx([x + y for (_, x), (_, y) in zip(A, B, strict=True)])


def test_less_robustness(spark):
    out = eval_robust_semantics(VarFloat("a") < 0.0, floats(a=A), spark=spark)
    close(out, [(0, -1.3), (0.7, -3), (1.3, -0.1), (1.334782609, 0.0), (2.1, 2.2)])


@pytest.mark.parametrize("mode", ["observed", "documented"])
def test_less_truth(spark, mode):
    out = eval_bool_semantics(VarFloat("a") < 0.0, floats(a=A), mode=mode, spark=spark)
    assert [v for _, v in out][:3] == [False] * 3 and out.at(2.1) is True
    if mode == "observed":
        assert out.at(1.334782609) is True


C = [(0, 2.5), (0.7, 4.0), (1.3, -1.0), (2.1, 1.7)]


def test_eventually(spark):
    spec = Eventually(VarFloat("a") >= 0.0)
    close(eval_robust_semantics(spec, floats(a=C), spark=spark), [(0, 4), (0.7, 4), (1.18, 1.7), (1.3, 1.7), (1.596296296, 1.7), (2.1, 1.7)])
    assert all(v for _, v in eval_bool_semantics(spec, floats(a=C), spark=spark))
    last = eval_bool_semantics(spec, floats(a=[(0, 2.5), (0.7, 4), (1.3, 1.7), (1.4, 0), (2.1, -2)]), spark=spark)
    assert [v for _, v in last] == [True] * (len(last) - 1) + [False]


def test_until(spark):
    spec = Until(VarInt("a") > ConstInt(0), VarInt("b") > ConstInt(0))
    ints = lambda **s: Trace({k: IntSignal.from_samples(v) for k, v in s.items()})
    close(eval_robust_semantics(spec, ints(a=[(0, 2), (5, 2)], b=[(0, 4), (5, 4)]), interpolation_method="constant", spark=spark), [(0, 2), (5, 2)])
    both = ints(a=[(1, 1), (3.5, 7), (4.7, 3), (5.3, 5), (6.2, 1)], b=[(4, 2), (6, 3)])
    close(eval_robust_semantics(spec, both, interpolation_method="constant", mode="observed", spark=spark), [(4, 3), (6, 3)])
    full = eval_robust_semantics(spec, both, interpolation_method="constant", spark=spark)
    assert full.start_time == 4 and full.end_time == 6


def test_response(spark):
    spec = parse_expr("G(a -> F[0,2] b)")
    out = eval_bool_semantics(spec, bools(a=[(1, False), (2, False), (3, False)], b=[(1, False), (2, True), (3, False)]), interpolation_method="constant", spark=spark)
    assert len(out) and all(v for _, v in out)


def test_bool_variable(spark):
    out = eval_bool_semantics(VarBool("a"), bools(a=[(0, False), (196.864, True), (12709.888, True)]), spark=spark)
    assert [v for _, v in out] == [False, True, True]


@pytest.mark.parametrize("end", [2.002, 4.002])
@pytest.mark.parametrize("mode", ["observed", "documented"])
def test_all_false(spark, end, mode):
    out = eval_bool_semantics(parse_expr("F[0,2] a"), bools(a=[(0, False), (0.001, False), (end, False)]), mode=mode, spark=spark)
    assert len(out) and not any(v for _, v in out)


X = [(t, float(v)) for t, v in enumerate([1, -2, 3, 0, -1, -4, 6])]


def test_windows(spark):
    at = lambda spec, **how: eval_robust_semantics(spec, floats(x=X), spark=spark, **how)
    spec = lambda a, b: Eventually(VarFloat("x") >= 0.0, interval=(a, b))
    documented = at(spec(0, 2))
    assert [documented.at(t) for t in range(7)] == pytest.approx([3, 3, 3, 0, 6, 6, 6])
    observed = at(spec(0, 2), mode="observed")
    assert [observed.at(t) for t in range(7)] == [6] * 7
    half = at(spec(0.5, 1.5))
    assert [half.at(t) for t in range(5)] == pytest.approx([0.5, 3, 1.5, -0.5, 1])
    assert half.start_time == 0 and half.end_time == 5.5 and half.at(5) == pytest.approx(6)
    assert at(spec(7, 9)).is_empty()
    late = at(spec(2, None))
    assert [late.at(t) for t in range(5)] == [6] * 5 and late.end_time == 4
    low = at(Always(VarFloat("x") >= 0.0, interval=(0, 2)))
    assert [low.at(t) for t in range(7)] == pytest.approx([-2, -2, -1, -4, -4, -4, 6])


def test_next(spark):
    out = eval_robust_semantics(Next(VarFloat("x") >= 0.0), floats(x=X), interpolation_method="constant", spark=spark)
    assert list(out) == [(float(t), X[t + 1][1]) for t in range(6)]


def test_until_keeps_values(spark):
    trace = floats(p=list(enumerate([5.0, 1, 1, 9, 2])), q=list(enumerate([0.0, 0, 0, 9, 9])))
    spec = Until(VarFloat("p") >= 0.0, VarFloat("q") >= 0.0)
    out = eval_robust_semantics(spec, trace, interpolation_method="constant", spark=spark)
    assert [v for _, v in out] == [1, 1, 1, 9, 2]
    assert list(eval_robust_semantics(spec, trace, interpolation_method="constant", mode="observed", spark=spark)) == [(0, 1), (3, 9), (4, 2)]


def test_constants(spark):
    assert eval_bool_semantics(parse_expr("true"), Trace({}), spark=spark).at(3) is True
    assert eval_robust_semantics(ConstFloat(5.0) > ConstFloat(2.0), Trace({}), spark=spark).at(0) == 3
    for spec in ("true & x > 0.0", "x > 0.0 & true"):
        assert [v for _, v in eval_robust_semantics(parse_expr(spec), floats(x=X), interpolation_method="constant", spark=spark)] == [v for _, v in X]
    one = floats(x=X)
    one.signals["c"] = FloatSignal.constant(2.0)
    out = eval_robust_semantics(parse_expr("(x > 0.0) U[0,2] (c > 0.0)"), one, interpolation_method="constant", spark=spark)
    assert not out.is_empty()


def test_errors(spark):
    with pytest.raises(SignalNotPresent):
        eval_robust_semantics(VarFloat("y") > 0.0, floats(x=X), spark=spark)
    with pytest.raises(KeyError):
        eval_robust_semantics(VarInt("x") > 0, floats(x=X), spark=spark)
    for make in (Always, Eventually):
        with pytest.raises(InvalidInterval):
            make(VarBool("a"), interval=(2, 2))
    with pytest.raises(InvalidInterval):
        Until(VarBool("a"), VarBool("b"), interval=(3, 1))
    assert eval_robust_semantics(parse_expr("p > 0.0 & q > 0.0"), floats(p=[(0, 1), (1, 1)], q=[(2, 1), (3, 1)]), spark=spark).is_empty()


def test_not_equal(spark):
    trace = floats(x=X)
    spec = Cmp.not_equal(VarFloat("x"), ConstFloat(0.0))
    assert eval_bool_semantics(spec, trace, interpolation_method="constant", spark=spark).at(3) is False
    assert eval_bool_semantics(spec, trace, interpolation_method="constant", spark=spark).at(0) is True
    assert [v for _, v in eval_bool_semantics(spec, trace, interpolation_method="constant", mode="observed", spark=spark)] == [v == 0 for _, v in X]
