"""Null handling and reason-string helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from aerolens.schema import REASON_SEP


def null_to_false(pred: Column) -> Column:
    """A predicate on a missing value is no violation."""
    return F.coalesce(pred, F.lit(False))


def nan_to_null(col: Column) -> Column:
    """NaN compares greater than every number in Spark; turn it into NULL."""
    return F.nanvl(col, F.lit(None).cast("double"))


def join_reasons(flags: Sequence[tuple[Column, str]], sep: str = REASON_SEP) -> Column:
    """Names of the true flags in the given order, joined by ``sep``; '' if none.

    ``concat_ws`` skips NULLs, so a false flag contributes nothing.
    """
    parts = [F.when(flag, F.lit(name)) for flag, name in flags]
    return F.concat_ws(sep, *parts)


def any_true(flags: Sequence[Column]) -> Column:
    out = None
    for f in flags:
        out = f if out is None else (out | f)
    return out if out is not None else F.lit(False)
