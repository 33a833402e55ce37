"""The feature transform vocabulary as window expressions.

Each builder takes the value column, its parameter, the effective lag and the
entity window.  The lag is folded into the frame (``[t-L-w+1, t-L]``) instead of
shifting first, so every transform of every column shares one partitioning, one
sort and one Window operator.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def shift(x: Column, periods: int, w: WindowSpec) -> Column:
    """x(t - periods); refuses to look forward."""
    if periods < 0:
        raise ValueError(f"shift of {periods}: feature transforms are backward-looking")
    return x if periods == 0 else F.lag(x, periods).over(w)


def positive(x: Column) -> Column:
    return F.when(x > 0, x)


def full_window(agg: Callable[[Column], Column], x: Column, size: int, lag: int, w: WindowSpec) -> Column:
    """``agg`` over the ``size`` rows ending ``lag`` rows back, NULL unless all are present."""
    frame = w.rowsBetween(-(lag + size - 1), -lag)
    return F.when(F.count(x).over(frame) == size, agg(x).over(frame))


def log_growth(now: Column, before: Column) -> Column:
    ratio = F.try_divide(now, before)
    return F.when(ratio > 0, 100.0 * F.ln(ratio))


def _lag(x, p, lag, w):
    return shift(x, lag + p, w)


def _diff(x, p, lag, w):
    return shift(x, lag, w) - shift(x, lag + p, w)


def _log_diff(x, p, lag, w):
    pos = positive(x)
    return log_growth(shift(pos, lag, w), shift(pos, lag + p, w))


def _rollmean(x, p, lag, w):
    return full_window(F.avg, x, p, lag, w)


def _rollstd(x, p, lag, w):
    return full_window(F.stddev_samp, x, p, lag, w)


def _reltrend(x, p, lag, w):
    return F.try_divide(shift(x, lag, w), full_window(F.avg, x, p, lag, w)) - 1.0


Builder = Callable[[Column, int, int, WindowSpec], Column]

class Transform(NamedTuple):
    build: Builder
    depth: Callable[[int], int]  # months of history read beyond the nearest one
    reading: str  # how the months ``{near}`` and ``{far}`` enter


# Register more with ``register_transform``: a transform is any function returning a Column.
_REGISTRY: dict[str, Transform] = {
    "lag": Transform(_lag, lambda p: p, "value of {far}"),
    "diff": Transform(_diff, lambda p: p, "{near} minus {far}"),
    "log_diff": Transform(_log_diff, lambda p: p, "100 x log({near} / {far})"),
    "rollmean": Transform(_rollmean, lambda p: p - 1, "mean over {far} .. {near}"),
    "rollstd": Transform(_rollstd, lambda p: p - 1, "sample SD over {far} .. {near}"),
    "reltrend": Transform(_reltrend, lambda p: p - 1, "{near} / mean over {far} .. {near}, less 1"),
}


def known_transforms() -> frozenset[str]:
    return frozenset(_REGISTRY)


def register_transform(name: str, builder: Builder, depth: Callable[[int], int], reading: str = "months {far} .. {near}") -> None:
    _REGISTRY[name] = Transform(builder, depth, reading)


def _entry(name: str) -> Transform:
    if name not in _REGISTRY:
        raise KeyError(f"unknown transform {name!r}; known: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name]


def history_depth(name: str, param: int) -> int:
    return _entry(name).depth(param)


def reading(name: str, near: int, far: int) -> str:
    return _entry(name).reading.format(near=f"t-{near}", far=f"t-{far}")


def apply_transform(x: Column, name: str, param: int, lag: int, w: WindowSpec) -> Column:
    return _entry(name).build(x.cast("double"), param, lag, w)
