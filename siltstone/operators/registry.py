"""Named operators, chains of wrappers around them, and checks before writes."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Operator = Callable[[DataFrame], DataFrame]
Wrapper = Callable[[str, Operator], Operator]


class Registry:
    """Operators by name; a name is taken once."""

    def __init__(self):
        self._known: dict[str, Operator] = {}

    def register(self, name: str, operator: Operator) -> None:
        if name in self._known:
            raise ValueError(f"{name!r} is registered already")
        self._known[name] = operator

    def get(self, name: str) -> Operator | None:
        return self._known.get(name)

    def require(self, name: str) -> Operator:
        if name not in self._known:
            raise KeyError(name)
        return self._known[name]

    def names(self) -> list[str]:
        return sorted(self._known)


def wrapped(name: str, operator: Operator, *wrappers: Wrapper) -> Operator:
    """The operator inside the wrappers, the first outermost."""
    for wrapper in reversed(wrappers):
        operator = wrapper(name, operator)
    return operator


def only(*allowed: str) -> Wrapper:
    """Refuses operators outside the allow-list."""

    def wrap(name: str, operator: Operator) -> Operator:
        def run(df: DataFrame) -> DataFrame:
            if name not in allowed:
                raise PermissionError(name)
            return operator(df)

        return run

    return wrap


def traced(log: list) -> Wrapper:
    """Notes each call's name, the time to plan it, and its columns."""

    def wrap(name: str, operator: Operator) -> Operator:
        def run(df: DataFrame) -> DataFrame:
            began = time.perf_counter()
            out = operator(df)
            log.append((name, time.perf_counter() - began, tuple(out.columns)))
            return out

        return run

    return wrap


@dataclass
class Hooks:
    """Checks that rows pass before they are written, each for some tables or all."""

    checks: list[tuple[str | None, str, Column]] = field(default_factory=list)

    def on(self, table: str | None, message: str, passes: Column) -> Hooks:
        self.checks.append((table, message, passes))
        return self

    def reject(self, table: str) -> Hooks:
        return self.on(table, f"{table} can't be changed", F.lit(False))

    def apply(self, table: str, rows: DataFrame) -> DataFrame:
        """rows, failing at run time on the first check that one doesn't pass."""
        faults = [F.when(~F.coalesce(passes, F.lit(False)), F.lit(message)) for t, message, passes in self.checks if t in (None, table)]
        if not faults:
            return rows
        fault = F.coalesce(*faults)
        return rows.where(F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(fault).cast("boolean")))
