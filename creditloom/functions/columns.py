"""Column functions: bands, states, months, cohorts, eras. Each is one expression, so Catalyst sees all of it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditloom.config import Settings


def either(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def band(value: Column | str, edges: Sequence[int], prefix: str) -> Column:
    """Label of the half-open band [low, high) that holds the value; null outside all of them."""
    value = either(value)
    out = F.lit(None).cast("string")
    for low, high in reversed(list(zip(edges[:-1], edges[1:], strict=True))):
        out = F.when((value >= low) & (value < high), F.lit(f"{prefix}{low:03d}-{high - 1:03d}")).otherwise(out)
    return out


def mob_band(value: Column | str, s: Settings) -> Column:
    return band(value, s.mob_edges, "MOB_")


def score_band(value: Column | str, s: Settings) -> Column:
    return band(value, s.score_edges, "FICO_")


def lookup(value: Column | str, table: Mapping[str, str]) -> Column:
    """The table's value for the trimmed key, null for other keys."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(pairs, F.trim(either(value)))


def is_blank(value: Column | str) -> Column:
    return either(value).isNull() | (F.trim(either(value)) == "")


def delinquency_state(code: Column | str, dpd: Column | str, s: Settings) -> Column:
    """A mapped terminal code, else the highest state whose floor the days past due reach, else Current."""
    out = F.lit("Current")
    for state, floor in sorted(s.dpd_floors.items(), key=lambda x: x[1]):
        out = F.when(either(dpd) >= floor, F.lit(state)).otherwise(out)
    return F.coalesce(lookup(code, s.codes), out)


def months_apart(later: Column | str, earlier: Column | str) -> Column:
    """Whole calendar months from one month to another."""
    return (F.year(either(later)) - F.year(either(earlier))) * 12 + F.month(either(later)) - F.month(either(earlier))


def cohort(month: Column | str, grain: str) -> Column:
    month = either(month)
    if grain == "monthly":
        return F.date_format(month, "yyyy-MM")
    year = F.year(month).cast("string")
    if grain == "annual":
        return year
    if grain == "quarterly":
        return F.concat(year, F.lit("-Q"), F.quarter(month).cast("string"))
    raise ValueError(f"unknown cohort grain {grain!r}")


def era(year: Column | str) -> Column:
    """Origination eras around the crisis."""
    year = either(year)
    return F.when(year < 2008, "pre-2008").when(year <= 2010, "2008-2010").otherwise("2011+")


def clip(x: Column | str, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    x = either(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as a double, null where b is 0 or null."""
    return F.try_divide(either(a).cast("double"), either(b).cast("double"))


def sum_if(condition: Column, value: Column | str) -> Column:
    return F.sum(F.when(condition, either(value)).otherwise(F.lit(0)))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def need(columns: Sequence[str], *wanted: str) -> None:
    """Raises KeyError when a wanted column is missing."""
    if missing := sorted(set(wanted) - set(columns)):
        raise KeyError(f"missing columns: {missing}")
