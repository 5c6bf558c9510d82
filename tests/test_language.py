"""Formulas: operators, printing, parsing, errors.  No Spark."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vigil import (
    Abs, Add, Always, And, Cmp, ConstBool, ConstFloat, ConstInt, ConstUInt, Div, Eventually, ExprBuilder, Interval, Mul, Negate, Next, Not, Or, Oracle, Sub, Until, VarBool, VarFloat, VarInt, VarUInt, dtype, parse_expr,
)
from vigil.errors import IdentifierRedeclaration, IncompleteArgs, InvalidCast, ParseError
from vigil.plans.parser import scan

a, b, x, y = VarBool("a"), VarBool("b"), VarFloat("x"), VarFloat("y")


def same(text, node):
    assert parse_expr(text).same(node), f"{parse_expr(text)} is not {node}"


@pytest.mark.parametrize("sign", ["!", "~", "¬"])
def test_not(sign):
    same(f"{sign}a & b", And([Not(a), b]))


@pytest.mark.parametrize(("signs", "cls"), [("& && ∧", And), ("| || ∨", Or)])
def test_and_or(signs, cls):
    for s in signs.split():
        same(f"a {s} b {s} c", cls([a, b, VarBool("c")]))


def test_sugar():
    e = ExprBuilder()
    for s in ("->", "=>"):
        same(f"a {s} b", e.implies(a, b))
    for s in ("<->", "<=>"):
        same(f"a {s} b", e.equiv(a, b))
    same("a ^ b", e.xor(a, b))


def test_temporal_spellings():
    for text in ("G", "alw", "always", "globally", "□"):
        same(f"{text} a", Always(a))
    for text in ("F", "ev", "eventually", "finally", "◇"):
        same(f"{text}[1, 2.5] a", Eventually(a, interval=(1, 2.5)))
    for text in ("X", "next", "○", "◯"):
        same(f"{text} a", Next(a))
    for text in ("U", "until"):
        same(f"a {text}[0..2] b", Until(a, b, interval=(0, 2)))
    same("G[2,] a", Always(a, interval=(2, None)))
    same("F[,2] a", Eventually(a, interval=(None, 2)))
    same("X[0,2] a", Oracle(a, 2))
    same("X[0,1] a", Next(a))


def test_precedence():
    c = VarBool("c")
    same("a U b U c", Until(a, Until(b, c)))
    same("F a & b", And([Eventually(a), b]))
    same("F x > 0.0", Eventually(x > 0.0))
    same("a | b & c", Or([a, And([b, c])]))
    same("a & b U c", And([a, Until(b, c)]))
    same("-x + y * 2.0 < 1.0 // note", Cmp.less_than(Add([Negate(x), Mul([y, ConstFloat(2.0)])]), ConstFloat(1.0)))
    same("(x - y) / 2.0 == 1.0", Cmp.equal(Div(Sub(x, y), ConstFloat(2.0)), ConstFloat(1.0)))


def test_types_of_variables():
    assert parse_expr("n > 0").variables() == {"n": dtype.uint64}
    assert parse_expr("n > 0.0").variables() == {"n": dtype.float64}
    assert parse_expr("m + n > 1").variables() == {"m": dtype.float64, "n": dtype.float64}
    assert parse_expr("m & F n").variables() == {"m": dtype.bool_, "n": dtype.bool_}
    assert parse_expr('"two words" & a').variables()['"two words"'] is dtype.bool_


@pytest.mark.parametrize("text", ["", "1 + 2", "a &", "(a", "a b", "![0,1] a", "G[3,1] a", "F[2,2] a", "X[1,] a", "X[2,1] a", "x > 0 & x > 0.0", "a @ b", "a + b", "true > 1", "G[a,b] c", "x > ", "a = b", "a;"])
def test_errors(text):
    with pytest.raises(ParseError):
        parse_expr(text)


def test_all_errors_are_told():
    with pytest.raises(ParseError) as e:
        parse_expr("$ a &\n @ b &")
    assert "1:1" in str(e.value) and "2:2" in str(e.value) and "^" in str(e.value)


def test_tokens():
    kinds = lambda t: [k.kind for k in scan(t)[0]]
    assert kinds("0..10") == ["number", "..", "number"] and kinds("1.5e3 .5 2.") == ["number"] * 3
    assert kinds("a<->b<=>c<=d") == ["name", "equiv", "name", "equiv", "name", "<=", "name"]


def test_python_operators():
    assert (x + y + 1).same(Add([x, y, ConstInt(1)])) and (1 + x).same(Add([ConstInt(1), x])) and (2.0 * x * y).same(Mul([ConstFloat(2.0), x, y]))
    assert (1 - x).same(Sub(ConstInt(1), x)) and (1 / x).same(Div(ConstInt(1), x)) and abs(-x).same(Abs(Negate(x)))
    assert (x + (y + 1)).same(Add([x, y, ConstInt(1)]))
    assert (True & a).same(And([ConstBool(True), a])) and (False | a).same(Or([ConstBool(False), a])) and (~a).same(Not(a))
    assert [c.op.value for c in (x < y, x <= y, x > y, x >= y, x == y, x != y)] == ["<", "<=", ">", ">=", "==", "!="]
    for bad in (lambda: x + "1", lambda: x & a, lambda: a & 1, lambda: bool(a)):
        with pytest.raises(TypeError):
            bad()


def test_nodes():
    for cls in (Add, Mul):
        with pytest.raises(IncompleteArgs):
            cls([x])
    for cls in (And, Or):
        with pytest.raises(ValueError):
            cls([a])
    with pytest.raises(IdentifierRedeclaration):
        ((VarInt("x") > 0) & (x > 0.0)).variables()
    e = ExprBuilder()
    e.float_var("x")
    with pytest.raises(ValueError):
        e.int_var("x")
    assert [str(n) for n in (Always(a, interval=(1, 2)) & b).walk()] == ["(G[1, 2](a)) && (b)", "G[1, 2](a)", "b", "a"]
    assert str(Until(a, b, interval=(0, None))) == "(a) U (b)" and str(Eventually(a, interval=(2, None))) == "F[2, ](a)"
    assert Interval(0, None).untimed and ConstUInt(2**64 - 1).value == 2**64 - 1
    for bad in (lambda: ConstUInt(-1), lambda: ConstInt(2**63), lambda: ConstBool(1), lambda: ConstFloat(True)):
        with pytest.raises(InvalidCast):
            bad()
    assert (x + 1).is_numeric and not (x + 1).is_boolean and (x < 1).is_boolean
    assert VarUInt("u").kind is dtype.uint64 and dtype.convert(float) is dtype.float64
    with pytest.raises(TypeError):
        dtype.convert(str)


numbers = st.deferred(lambda: st.sampled_from(["x", "y", "1.5", "0.25"]) | st.builds("({} {} {})".format, numbers, st.sampled_from("+-*/"), numbers) | st.builds("-{}".format, numbers))
formulas = st.deferred(
    lambda: st.sampled_from(["a", "b", "true", "FALSE"])
    | st.builds("{} {} {}".format, numbers, st.sampled_from(["<", "<=", ">", ">=", "==", "!="]), numbers)
    | st.builds("({} {} {})".format, formulas, st.sampled_from(["&", "||", "->", "<=>", "^", "U", "U[0,2]"]), formulas)
    | st.builds("{} {}".format, st.sampled_from(["!", "G", "F", "G[1,2]", "F[0..3]", "X"]), st.builds("({})".format, formulas))
)


@settings(max_examples=300, deadline=None)
@given(formulas)
def test_generated_formulas_parse(text):
    node = parse_expr(text)
    assert node.same(parse_expr(text)) and hash(node) == hash(parse_expr(text))
