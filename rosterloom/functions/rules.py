"""Declarative tables of rules, score components and filters, turned into single columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


@dataclass(frozen=True)
class Rule:
    name: str
    when: Column


def cascade(rules: list[Rule], default: str | None = None) -> Column:
    """The name of the first rule that holds; an unknown predicate does not hold."""
    out = None
    for r in rules:
        test = F.coalesce(r.when, F.lit(False))
        out = F.when(test, F.lit(r.name)) if out is None else out.when(test, F.lit(r.name))
    return out.otherwise(F.lit(default))


@dataclass(frozen=True)
class Component:
    name: str
    weight: float
    value: Column


def weighted(components: list[Component], round_to: Callable[[Column], Column]) -> tuple[dict[str, Column], Column]:
    """(rounded points by component, rounded total); the total is summed before rounding."""
    points = {c.name: c.value * F.lit(c.weight) for c in components}
    return {k: round_to(v) for k, v in points.items()}, round_to(reduce(lambda a, b: a + b, points.values()))


@dataclass
class FilterSpec:
    """Facets of a view: all must hold, a facet without values is no constraint, unknown fails."""

    members: dict[str, list] = field(default_factory=dict)
    excluded: dict[str, list] = field(default_factory=dict)
    bands: dict[str, list[tuple[float | None, float | None]]] = field(default_factory=dict)
    flags: list[str] = field(default_factory=list)

    def facets(self) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for c, values in self.members.items():
            if values:
                out[c] = F.col(c).isin(*values)
        for c, values in self.excluded.items():
            if values:
                out[f"not_{c}"] = ~F.col(c).isin(*values)
        for c, ranges in self.bands.items():
            tests = [(F.lit(True) if a is None else F.col(c) >= a) & (F.lit(True) if b is None else F.col(c) < b) & F.col(c).isNotNull() for a, b in ranges]
            if tests:
                out[f"band_{c}"] = reduce(lambda x, y: x | y, tests)
        for c in self.flags:
            out[c] = F.col(c)
        return {k: F.coalesce(v, F.lit(False)) for k, v in out.items()}

    def predicate(self) -> Column:
        return reduce(lambda a, b: a & b, self.facets().values(), F.lit(True))

    def hiding(self, df: DataFrame, target: Column) -> DataFrame:
        """One row: for each facet, whether it alone hides every row of the target."""
        return df.filter(target).agg(*[(~F.max(v)).alias(k) for k, v in self.facets().items()])
