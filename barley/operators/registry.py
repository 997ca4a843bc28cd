"""Operators by name. A user adds one with the ``operator`` decorator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

#: rolling: along one instrument; smooth: recursive along one instrument; slice: across instruments at one
#: time; total: an aggregate of one instrument's whole history; scalar: cell by cell; macro: built of others
KINDS = ("rolling", "smooth", "slice", "total", "scalar", "macro")


@dataclass(frozen=True)
class Operator:
    name: str
    kind: str
    build: Callable
    series: int
    most: int
    back: Callable[..., int]

    def check(self, count: int) -> None:
        if not self.series <= count <= self.most:
            raise TypeError(f"{self.name} takes {self.series} to {self.most} arguments, got {count}")


OPERATORS: dict[str, Operator] = {}


def operator(kind: str, *names: str, series: int = 1, extra: int = 0, back: Callable[..., int] | None = None):
    """Register a Column builder.

    ``series`` leading arguments are Columns, up to ``extra`` more are plain parameters. ``back`` tells from the
    parameters how many earlier rows a rolling operator reads; by default the first parameter is its window.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}, use one of {KINDS}")

    def add(build: Callable) -> Callable:
        reach = back or (lambda n=1, *rest: int(n) - 1)
        for name in names or (build.__name__,):
            OPERATORS[name] = Operator(name, kind, build, series, series + extra, reach)
        return build

    return add


def lookup(name: str) -> Operator:
    try:
        return OPERATORS[name]
    except KeyError:
        raise AttributeError(f"no operator named {name!r}") from None
