"""Errors, each also an instance of the built-in kind that callers expect."""


class MonitorError(Exception):
    """Base of all."""


class IdentifierRedeclaration(MonitorError, ValueError):
    def __init__(self, name: str):
        super().__init__(f"variable {name!r} is declared with two types")


class IncompleteArgs(MonitorError, ValueError):
    def __init__(self, what: str):
        super().__init__(f"{what} takes two operands at least")


class InvalidInterval(MonitorError, ValueError):
    def __init__(self, a, b):
        super().__init__(f"no time lies strictly inside the interval from {a} to {b}")


class ParseError(MonitorError, ValueError):
    """All errors of a text at once, each with its place."""


class InvalidPush(MonitorError, RuntimeError):
    def __init__(self):
        super().__init__("only a sampled signal takes samples")


class NonMonotonicSignal(MonitorError, RuntimeError):
    def __init__(self, last, now):
        super().__init__(f"times have to increase: {now} follows {last}")


class SignalNotPresent(MonitorError, KeyError):
    def __init__(self, name: str, kind: str):
        super().__init__(f"the trace has no {kind} signal {name!r}")


class InvalidCast(MonitorError, TypeError):
    def __init__(self, value, kind: str):
        super().__init__(f"{value!r} cannot be held as {kind}")


class InvalidOperation(MonitorError, ValueError):
    pass


class InvalidSignalType(MonitorError, TypeError):
    pass
