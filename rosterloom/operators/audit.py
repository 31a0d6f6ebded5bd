"""Invariants as data: each check is a frame of one row (name, failures)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _row(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("failures")).select(F.lit(name).alias("name"), "failures")


def unique(name: str, df: DataFrame, keys: list[str]) -> DataFrame:
    return _row(df.groupBy(*keys).count().filter("count > 1"), name)


def referenced(name: str, df: DataFrame, key: str, to: DataFrame, to_key: str) -> DataFrame:
    known = to.select(F.col(to_key).alias("__to")).distinct()
    return _row(df.join(known, F.col(key) == F.col("__to"), "left_anti"), name)


def vocabulary(name: str, df: DataFrame, column: str, words: list) -> DataFrame:
    return _row(df.filter(~F.col(column).isin(*words)), name)


def same_count(name: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """Failures: by how much the counts differ."""
    both = a.select(F.lit(1).alias("n")).unionAll(b.select(F.lit(-1).alias("n")))
    return both.agg(F.abs(F.coalesce(F.sum("n"), F.lit(0))).alias("failures")).select(F.lit(name).alias("name"), "failures")


def failures(checks: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), checks)


def drift_within(before: DataFrame, after: DataFrame, key: str, column: str, most: int) -> bool:
    """Whether at most ``most`` keys changed value between two snapshots."""
    pairs = before.select(key, F.col(column).alias("__a")).join(after.select(key, F.col(column).alias("__b")), key)
    return pairs.filter(~F.col("__a").eqNullSafe(F.col("__b"))).limit(most + 1).count() <= most


def no_double_count(name: str, rows: DataFrame, own: Column, team: Column) -> DataFrame:
    """Rows that carry both an amount of their own and one of a team."""
    return _row(rows.filter((F.coalesce(own, F.lit(0)) > 0) & (F.coalesce(team, F.lit(0)) > 0)), name)


def sound_crosswalk(name: str, rows: DataFrame, key: str, candidate: str, accept: float) -> DataFrame:
    """Repeated or blank keys, high rows below the threshold, and tiers that contradict the id."""
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(1).alias("x"))
    blank = F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""
    under = (F.col("tier") == "high") & (F.col("score") < accept)
    odd = (F.col("tier") == "none") == F.col(candidate).isNotNull()
    faults = F.explode(F.filter(F.array(blank, under, odd), lambda f: f))
    return _row(twice.unionAll(rows.select(faults.alias("f")).select(F.lit(1))), name)


def shared_book(name: str, per_holder: DataFrame, union: DataFrame, stated: DataFrame, slack: float = 1.05) -> DataFrame:
    """What holders are written at must exceed the union, and the union must not exceed what is stated.

    Each frame has one row with ``total``.
    """
    both = per_holder.select(F.col("total").alias("p")).crossJoin(union.select(F.col("total").alias("u"))).crossJoin(stated.select(F.col("total").alias("s")))
    faults = (F.col("p") <= F.col("u") * slack).cast("int") + (F.col("u") > F.col("s") + 1).cast("int")
    return both.select(F.lit(name).alias("name"), faults.cast("long").alias("failures"))


@dataclass(frozen=True)
class Check:
    """A named check; ``run`` gives a frame of (name, failures) or None where its table is not there."""

    name: str
    run: Callable[[], DataFrame | None]


def run_checks(checks: list[Check]) -> tuple[list[tuple[str, str, int]], int]:
    """((name, ok | failed | skipped | error, failures) of every check, how many failed or broke)."""
    out = []
    for c in checks:
        try:
            frame = c.run()
            n = None if frame is None else int(frame.agg(F.sum("failures")).first()[0] or 0)
            out.append((c.name, "skipped" if n is None else "failed" if n else "ok", n or 0))
        except Exception as e:  # a check that breaks is a result of its own, not the end of the others
            out.append((f"{c.name}: {e}"[:200], "error", 1))
    return out, sum(state in ("failed", "error") for _, state, _ in out)


@dataclass(frozen=True)
class Passing:
    """A check of single rows that is counted while they are written: ``bad`` rows are failures."""

    name: str
    bad: Column
    most: int = 0


def write_checked(df: DataFrame, write: Callable[[DataFrame], None], checks: list[Passing], totals: dict[str, Column] | None = None) -> tuple[list[tuple[str, str, int]], int, dict]:
    """Writes ``df`` and counts all checks and totals in the same pass: no check reads the table again.

    Gives the rows of ``run_checks``, how many failed, and the totals (any aggregates: counts, sums,
    vocabularies). A check on a column that is not there is skipped. More than ``most`` failures fail it.
    """
    there, skipped = [], []
    for c in checks:
        try:
            df.select(c.bad).schema  # noqa: B018  only resolves the names
            there.append(c)
        except Exception:
            skipped.append(c)
    seen = Observation()
    metrics = [F.count_if(F.coalesce(c.bad, F.lit(False))).alias(f"check_{k}") for k, c in enumerate(there)]
    metrics += [v.alias(f"total_{n}") for n, v in (totals or {}).items()]
    write(df.observe(seen, *metrics) if metrics else df)
    found = seen.get if metrics else {}
    out = [(c.name, "ok" if found[f"check_{k}"] <= c.most else "failed", int(found[f"check_{k}"])) for k, c in enumerate(there)]
    out += [(c.name, "skipped", 0) for c in skipped]
    return out, sum(state == "failed" for _, state, _ in out), {n: found[f"total_{n}"] for n in totals or {}}
