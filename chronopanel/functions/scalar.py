"""Scalar normalisation: identifiers, names, months, numbers, classes, bands."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CLASSES

# Geography words dropped from the end of a name.
NAME_SUFFIXES = ("county", "parish", "borough", "census area", "city and borough", "municipality")


def snake_case(names: list[str]) -> list[str]:
    return [re.sub(r"[^a-z0-9]+", "_", n.strip().lower()).strip("_") for n in names]


def zero_pad(x: Column, width: int) -> Column:
    """Left-pad with zeros; unlike ``lpad`` a longer value is never cut."""
    t = F.trim(x.cast("string"))
    return F.when(F.length(t) < width, F.lpad(t, width, "0")).otherwise(t)


def compose_id(state: Column, county: Column, state_width: int = 2, county_width: int = 3) -> Column:
    return F.concat(zero_pad(state, state_width), zero_pad(county, county_width))


def name_key(name: Column) -> Column:
    """Comparable form of an entity name: no qualifier, no suffix, alphanumerics only."""
    t = F.lower(F.trim(name))
    t = F.regexp_replace(t, r",\s*[a-z .]+$", "")
    t = F.regexp_replace(t, r"\s+(" + "|".join(NAME_SUFFIXES) + ")$", "")
    t = F.regexp_replace(t, r"[^a-z0-9]+", " ")
    return F.trim(t)


def to_date(x: Column) -> Column:
    """Any ISO-like date text, date or timestamp; unparseable becomes NULL."""
    return x.try_cast("date")


def month_start(x: Column) -> Column:
    return F.trunc(to_date(x), "MM")


def cutoff(month: Column, months_after: int = 1, day: int = 15) -> Column:
    """Forecast cutoff: a fixed day of a following month."""
    return F.date_add(F.add_months(month, months_after), day - 1)


def published_at(month: Column, delay_days: Column | int) -> Column:
    return F.date_add(F.last_day(month), delay_days)


def is_month_code(period: Column) -> Column:
    return period.rlike(r"^M(0[1-9]|1[0-2])$")


def coded_month(year: Column, period: Column) -> Column:
    """('2024', 'M03') -> 2024-03-01."""
    return F.concat(year, F.lit("-"), F.substring(period, 2, 2), F.lit("-01")).try_cast("date")


def period_label(month: Column, freq: str) -> Column:
    year = F.year(month).cast("string")
    head = freq[0].upper()
    if head == "Y":
        return year
    if head == "Q":
        return F.concat(year, F.lit("Q"), F.quarter(month).cast("string"))
    raise ValueError(f"unsupported period {freq!r}; use 'Y' or 'Q'")


def to_number(x: Column) -> Column:
    return x.try_cast("double")


def classify(x: Column, tau: float) -> Column:
    """Direction of a change; inclusive at +-tau, NULL stays NULL."""
    down, flat, up = CLASSES
    return F.when(x <= -tau, down).when(x >= tau, up).when(x.isNotNull(), flat)


def tier(volume: Column, tiers: tuple[tuple[str, float], ...]) -> Column:
    """Band by lower bounds only, so the bands leave no gap between integers."""
    out = None
    for name, low in reversed(tiers):
        out = F.when(volume >= low, name) if out is None else out.when(volume >= low, name)
    return out


def tier_order(column: Column, tiers: tuple[tuple[str, float], ...]) -> Column:
    out = None
    for i, (name, _) in enumerate(tiers):
        out = F.when(column == name, i) if out is None else out.when(column == name, i)
    return out


def band(x: Column, edges: tuple[float, ...], labels: tuple[str, ...]) -> Column:
    """Left-closed bands [edge_i, edge_i+1); outside all of them is NULL."""
    out = None
    for low, high, label in zip(edges, edges[1:], labels):
        hit = (x >= low) & (x < high)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out
