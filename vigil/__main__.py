"""python -m vigil FORMULA: print the formula as it is understood, its variables, and the tree of its parts."""

from __future__ import annotations

import sys

from .errors import MonitorError
from .plans.parser import parse_expr


def tree(node, depth: int = 0) -> list[str]:
    label = type(node).__name__ + (f" {node.interval}" if getattr(node, "interval", None) is not None else "")
    parts = getattr(node, "args", ())
    return [f"{'  ' * depth}{label}" + ("" if parts else f" {node}"), *(line for a in parts for line in tree(a, depth + 1))]


def main(args: list[str]) -> int:
    if len(args) != 1:
        print(__doc__, file=sys.stderr)
        return 2
    try:
        node = parse_expr(args[0])
    except MonitorError as error:
        print(error, file=sys.stderr)
        return 1
    print(node)
    for name, kind in sorted(node.variables().items()):
        print(f"{name}: {kind.name}")
    print("\n".join(tree(node)))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
