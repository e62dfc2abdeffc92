"""Row-count rolling aggregates with a minimum number of periods.

Frame = the current row and the ``n - 1`` rows before it in flight order.
Missing values stay in the frame but are not counted; the result is NULL
when fewer than ``min_periods`` values are present.  The standard deviation
is the sample one (n - 1).
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec, functions as F

ROLLING_OPS = ("mean", "std", "max", "min")

_AGGS = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "max": F.max,
    "min": F.min,
}


def rolling_frame(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(int(n) - 1), 0)


def default_min_periods(n: int) -> int:
    return max(1, int(n) // 2)


def rolling(col: Column, w: WindowSpec, n: int, op: str,
            min_periods: int | None = None) -> Column:
    """Rolling ``op`` of ``col`` over the last ``n`` rows of window ``w``."""
    if op not in _AGGS:
        raise ValueError(f"Unknown rolling operation: {op}")
    if min_periods is None:
        min_periods = default_min_periods(n)
    frame = rolling_frame(w, n)
    value = _AGGS[op](col).over(frame)
    if min_periods <= 1 and op != "std":
        return value
    return F.when(F.count(col).over(frame) >= F.lit(int(min_periods)), value)


class RollingSet:
    """Collects rolling aggregates so that each (column, frame, aggregate)
    is computed once.

    Spark does not merge identical window expressions; building ``count``
    once per column and frame (instead of once per statistic) removes a
    third of the sliding-frame work.  ``columns()`` gives the window
    columns to add in one projection; ``rolling()`` gives an expression over
    them (NULL below ``min_periods``).
    """

    _OPS = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min,
            "sum": F.sum, "count": F.count}

    def __init__(self, w: WindowSpec, prefix: str = "_r"):
        self.w = w
        self.prefix = prefix
        self._cols: dict[str, Column] = {}

    def agg(self, src: str, n: int, op: str) -> Column:
        if op not in self._OPS:
            raise ValueError(f"Unknown rolling operation: {op}")
        name = f"{self.prefix}_{op}{int(n)}_{src.strip('_')}"
        if name not in self._cols:
            self._cols[name] = self._OPS[op](F.col(src)).over(rolling_frame(self.w, n))
        return F.col(name)

    def rolling(self, src: str, n: int, op: str, min_periods: int | None = None) -> Column:
        if min_periods is None:
            min_periods = default_min_periods(n)
        value = self.agg(src, n, op)
        return F.when(self.agg(src, n, "count") >= F.lit(int(min_periods)), value)

    def columns(self) -> dict[str, Column]:
        return dict(self._cols)

    def names(self) -> list[str]:
        return list(self._cols)
