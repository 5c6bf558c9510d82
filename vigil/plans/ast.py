"""Formulas: immutable nodes with Python operators.  Nothing here touches Spark.

Comparison operators of numeric nodes build formulas, so nodes are compared with ``same``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from enum import Enum

from ..errors import IdentifierRedeclaration, IncompleteArgs, InvalidInterval
from ..types import NS, dtype, nanos


class Ordering(Enum):
    eq, ne, lt, le, gt, ge = "==", "!=", "<", "<=", ">", ">="

    @property
    def strict(self) -> bool:
        return self in (Ordering.lt, Ordering.gt, Ordering.ne)


class Interval:
    """[a, b] in seconds; an open start is 0, an open end is none."""

    __slots__ = ("a", "b")

    def __init__(self, a: float | None = None, b: float | None = None):
        self.a = 0 if a is None else nanos(a)
        self.b = None if b is None else nanos(b)

    @classmethod
    def of(cls, what) -> Interval:
        return what if isinstance(what, Interval) else cls(*(what or (None, None)))

    def checked(self) -> Interval:
        if self.b is not None and self.b <= self.a:
            raise InvalidInterval(self.a / NS, self.b / NS)
        return self

    @property
    def untimed(self) -> bool:
        return self.a == 0 and self.b is None

    def key(self) -> tuple:
        return self.a, self.b

    def __str__(self) -> str:
        return f"[{self.a / NS:g}, {'' if self.b is None else f'{self.b / NS:g}'}]"


class Expr:
    """Base of all nodes."""

    args: tuple[Expr, ...] = ()

    def own(self) -> tuple:
        """What tells this node from another of its class, apart from its arguments."""
        return ()

    def key(self) -> tuple:
        found = self.__dict__.get("_key")
        if found is None:
            found = self.__dict__["_key"] = (type(self).__name__, *self.own(), *(a.key() for a in self.args))
        return found

    def same(self, other: Expr) -> bool:
        return self.key() == other.key()

    def __hash__(self) -> int:
        return hash(self.key())

    def __repr__(self) -> str:
        return str(self)

    def __bool__(self) -> bool:
        raise TypeError("a formula has no truth value; combine formulas with & | ~")

    def walk(self) -> Iterator[Expr]:
        """All nodes, root first, level by level."""
        queue: deque[Expr] = deque([self])
        while queue:
            node = queue.popleft()
            yield node
            queue.extend(node.args)

    def variables(self) -> dict[str, dtype]:
        """Names with their types; one name with two types is an error."""
        found: dict[str, dtype] = {}
        for node in self.walk():
            if isinstance(node, (VarNum, VarBool)) and found.setdefault(node.name, node.kind) is not node.kind:
                raise IdentifierRedeclaration(node.name)
        return found

    is_numeric = is_boolean = False


def num(x) -> NumExpr:
    if isinstance(x, NumExpr):
        return x
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise TypeError(f"not a numeric expression: {x!r}")
    return ConstInt(x) if isinstance(x, int) else ConstFloat(x)


def boolean(x) -> BoolExpr:
    if isinstance(x, BoolExpr):
        return x
    if isinstance(x, bool):
        return ConstBool(x)
    raise TypeError(f"not a formula: {x!r}")


class NumExpr(Expr):
    is_numeric = True
    __hash__ = Expr.__hash__

    def __neg__(self):
        return Negate(self)

    def __abs__(self):
        return Abs(self)

    def __add__(self, other):
        return Add.flat(self, num(other))

    def __radd__(self, other):
        return Add.flat(num(other), self)

    def __mul__(self, other):
        return Mul.flat(self, num(other))

    def __rmul__(self, other):
        return Mul.flat(num(other), self)

    def __sub__(self, other):
        return Sub(self, num(other))

    def __rsub__(self, other):
        return Sub(num(other), self)

    def __truediv__(self, other):
        return Div(self, num(other))

    def __rtruediv__(self, other):
        return Div(num(other), self)

    def __lt__(self, other):
        return Cmp(Ordering.lt, self, num(other))

    def __le__(self, other):
        return Cmp(Ordering.le, self, num(other))

    def __gt__(self, other):
        return Cmp(Ordering.gt, self, num(other))

    def __ge__(self, other):
        return Cmp(Ordering.ge, self, num(other))

    def __eq__(self, other):
        return Cmp(Ordering.eq, self, num(other))

    def __ne__(self, other):
        return Cmp(Ordering.ne, self, num(other))


class _ConstNum(NumExpr):
    kind: dtype

    def __init__(self, value):
        self.value = self.kind.check(value)

    def own(self):
        return (repr(self.value),)

    def __str__(self):
        return str(self.value)


class ConstInt(_ConstNum):
    kind = dtype.int64


class ConstUInt(_ConstNum):
    kind = dtype.uint64


class ConstFloat(_ConstNum):
    kind = dtype.float64


class VarNum(NumExpr):
    kind: dtype

    def __init__(self, name: str):
        self.name = name

    def own(self):
        return (self.name,)

    def __str__(self):
        return self.name


class VarInt(VarNum):
    kind = dtype.int64


class VarUInt(VarNum):
    kind = dtype.uint64


class VarFloat(VarNum):
    kind = dtype.float64


class _Unary(Expr):
    coerce = staticmethod(num)

    def __init__(self, arg):
        self.args = (self.coerce(arg),)

    @property
    def arg(self):
        return self.args[0]


class _Nary(Expr):
    coerce = staticmethod(num)
    sign = ""

    def __init__(self, args):
        self.args = tuple(map(self.coerce, args))
        if len(self.args) < 2:
            raise IncompleteArgs(type(self).__name__)

    @classmethod
    def flat(cls, left, right):
        """left sign right; operands that are of this kind themselves are opened."""
        parts = [x.args if isinstance(x, cls) else (x,) for x in (left, right)]
        return cls(parts[0] + parts[1])

    def __str__(self):
        return f" {self.sign} ".join(f"({a})" for a in self.args)


class Negate(_Unary, NumExpr):
    def __str__(self):
        return f"-({self.arg})"


class Abs(_Unary, NumExpr):
    def __str__(self):
        return f"abs({self.arg})"


class Add(_Nary, NumExpr):
    sign = "+"


class Mul(_Nary, NumExpr):
    sign = "*"


class _Binary(Expr):
    coerce = staticmethod(num)
    sign = ""

    def __init__(self, lhs, rhs):
        self.args = (self.coerce(lhs), self.coerce(rhs))

    @property
    def lhs(self):
        return self.args[0]

    @property
    def rhs(self):
        return self.args[1]

    def __str__(self):
        return f"({self.lhs}) {self.sign} ({self.rhs})"


class Sub(_Binary, NumExpr):
    sign = "-"


class Div(_Binary, NumExpr):
    sign = "/"


class BoolExpr(Expr):
    is_boolean = True

    def __invert__(self):
        return Not(self)

    def __and__(self, other):
        return And.flat(self, boolean(other))

    def __rand__(self, other):
        return And.flat(boolean(other), self)

    def __or__(self, other):
        return Or.flat(self, boolean(other))

    def __ror__(self, other):
        return Or.flat(boolean(other), self)


class ConstBool(BoolExpr):
    kind = dtype.bool_

    def __init__(self, value: bool):
        self.value = dtype.bool_.check(value)

    def own(self):
        return (self.value,)

    def __str__(self):
        return str(self.value).lower()


class VarBool(BoolExpr):
    kind = dtype.bool_

    def __init__(self, name: str):
        self.name = name

    def own(self):
        return (self.name,)

    def __str__(self):
        return self.name


class Cmp(_Binary, BoolExpr):
    def __init__(self, op: Ordering, lhs, rhs):
        super().__init__(lhs, rhs)
        self.op = op

    def own(self):
        return (self.op.value,)

    @property
    def sign(self):
        return self.op.value

    @staticmethod
    def equal(lhs, rhs):
        return Cmp(Ordering.eq, lhs, rhs)

    @staticmethod
    def not_equal(lhs, rhs):
        return Cmp(Ordering.ne, lhs, rhs)

    @staticmethod
    def less_than(lhs, rhs):
        return Cmp(Ordering.lt, lhs, rhs)

    @staticmethod
    def less_than_eq(lhs, rhs):
        return Cmp(Ordering.le, lhs, rhs)

    @staticmethod
    def greater_than(lhs, rhs):
        return Cmp(Ordering.gt, lhs, rhs)

    @staticmethod
    def greater_than_eq(lhs, rhs):
        return Cmp(Ordering.ge, lhs, rhs)


class Not(_Unary, BoolExpr):
    coerce = staticmethod(boolean)

    def __str__(self):
        return f"!({self.arg})"


class And(_Nary, BoolExpr):
    coerce, sign = staticmethod(boolean), "&&"


class Or(_Nary, BoolExpr):
    coerce, sign = staticmethod(boolean), "||"


class Next(_Unary, BoolExpr):
    coerce, steps = staticmethod(boolean), 1

    def __str__(self):
        return f"X ({self.arg})"


class Oracle(_Unary, BoolExpr):
    """The value so many samples later."""

    coerce = staticmethod(boolean)

    def __init__(self, arg, steps: int):
        super().__init__(arg)
        if steps < 0:
            raise ValueError(f"steps are not negative: {steps}")
        self.steps = steps

    def own(self):
        return (self.steps,)

    def __str__(self):
        return f"X[0,{self.steps}]({self.arg})"


class _Timed(BoolExpr):
    coerce = staticmethod(boolean)
    interval: Interval
    letter = ""

    def own(self):
        return self.interval.key()

    @property
    def mark(self) -> str:
        return self.letter + ("" if self.interval.untimed else str(self.interval))


class Always(_Unary, _Timed):
    coerce, letter = staticmethod(boolean), "G"

    def __init__(self, arg, *, interval=None):
        super().__init__(arg)
        self.interval = Interval.of(interval).checked()

    def __str__(self):
        return f"{self.mark}({self.arg})"


class Eventually(Always):
    letter = "F"


class Until(_Binary, _Timed):
    coerce, letter = staticmethod(boolean), "U"

    def __init__(self, lhs, rhs, *, interval=None):
        super().__init__(lhs, rhs)
        self.interval = Interval.of(interval).checked()

    def __str__(self):
        return f"({self.lhs}) {self.mark} ({self.rhs})"


class ExprBuilder:
    """Factories that keep one type for each variable name."""

    _kinds = {dtype.bool_: VarBool, dtype.int64: VarInt, dtype.uint64: VarUInt, dtype.float64: VarFloat}

    def __init__(self):
        self.declared: dict[str, dtype] = {}

    def var(self, name: str, kind: dtype):
        kind = dtype.convert(kind)
        if self.declared.setdefault(name, kind) is not kind:
            raise IdentifierRedeclaration(name)
        return self._kinds[kind](name)

    def bool_var(self, name):
        return self.var(name, dtype.bool_)

    def int_var(self, name):
        return self.var(name, dtype.int64)

    def uint_var(self, name):
        return self.var(name, dtype.uint64)

    def float_var(self, name):
        return self.var(name, dtype.float64)

    bool_const, int_const, uint_const, float_const = map(staticmethod, (ConstBool, ConstInt, ConstUInt, ConstFloat))
    neg, absolute, sub, div = map(staticmethod, (Negate, Abs, Sub, Div))
    lt, le, gt, ge, eq, ne = map(staticmethod, (Cmp.less_than, Cmp.less_than_eq, Cmp.greater_than, Cmp.greater_than_eq, Cmp.equal, Cmp.not_equal))
    negation = staticmethod(Not)

    @staticmethod
    def cmp(op: Ordering, lhs, rhs):
        return Cmp(op, lhs, rhs)

    @staticmethod
    def _open(cls, args):
        return cls([x for a in args for x in (a.args if isinstance(a, cls) else (a,))])

    def add(self, args):
        return self._open(Add, args)

    def mul(self, args):
        return self._open(Mul, args)

    def conjunction(self, args):
        return self._open(And, args)

    def disjunction(self, args):
        return self._open(Or, args)

    @staticmethod
    def implies(p, q):
        return Or.flat(Not(p), boolean(q))

    @staticmethod
    def equiv(p, q):
        return Or([And.flat(p, q), And.flat(Not(p), Not(q))])

    def xor(self, p, q):
        return Not(self.equiv(p, q))

    @staticmethod
    def next(arg):
        return Next(arg)

    @staticmethod
    def oracle(arg, steps: int):
        return Next(arg) if steps == 1 else Oracle(arg, steps)

    @staticmethod
    def always(arg, interval=None):
        return Always(arg, interval=interval)

    @staticmethod
    def eventually(arg, interval=None):
        return Eventually(arg, interval=interval)

    @staticmethod
    def until(lhs, rhs, interval=None):
        return Until(lhs, rhs, interval=interval)
