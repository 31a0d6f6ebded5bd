"""Numbers: absent stays absent, divisions never raise, rounding is explicit."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """A filed number: padding and thousands commas go, anything else unreadable is null."""
    return F.trim(F.replace(text, F.lit(","), F.lit(""))).try_cast("double")


def flag(text: Column, yes: tuple[str, ...] = ("Y",)) -> Column:
    return F.coalesce(F.upper(F.trim(text)).isin(*yes), F.lit(False))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where the whole is zero or either is absent."""
    return part / F.nullif(whole, F.lit(0))


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def present(*parts: Column) -> Column:
    """Sum in which an absent part counts as zero."""
    total = F.lit(0.0)
    for p in parts:
        total = total + F.coalesce(p, F.lit(0.0))
    return total


def log_scale(value: Column, low: float, high: float) -> Column:
    """0 at ``low``, 1 at ``high`` on a log scale; zero, negative and absent values are 0."""
    from math import log10

    scaled = (F.log10(F.greatest(value, F.lit(low))) - F.lit(log10(low))) / F.lit(log10(high) - log10(low))
    return F.when(value > 0, F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def half_even(value: Column, places: int, precision: int = 38) -> Column:
    """Half-even rounding of the decimal value, so that engines agree."""
    return F.bround(value.cast(f"decimal({precision},10)"), places).cast("double")


def band(value: Column, edges: list[float], labels: list[str], right: bool = True) -> Column:
    """Label of the bin; right-closed bins by default, left-closed otherwise. Absent stays absent."""
    out = F.when(value.isNull(), F.lit(None))
    for edge, label in zip(edges, labels):
        out = out.when(value <= edge if right else value < edge, F.lit(label))
    return out.otherwise(F.lit(labels[len(edges)]))


def percent_rank_average(value: Column, *group: str) -> Column:
    """Average rank of ties over the group's size, as dataframes of the statistics kind define it."""
    everyone, ordered = Window.partitionBy(*group), Window.partitionBy(*group).orderBy(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, value))
    return (F.rank().over(ordered) + (ties - 1) / F.lit(2.0)) / F.count(F.lit(1)).over(everyone)


def upper_median(values: Column) -> Column:
    """Of a collected list: the greater of the two middle values."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))


def floor_quantile(values: Column, q: float) -> Column:
    """Of a collected list: the value at the floored index of q * (n - 1)."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, (F.floor((F.size(ordered) - 1) * F.lit(q)) + 1).cast("int"))


def latest(value: Column, *stamps: Column) -> Column:
    return F.max_by(value, F.struct(*stamps))
