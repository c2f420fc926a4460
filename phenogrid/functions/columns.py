"""Small column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from phenogrid.schema import SENTINEL


def W(*more):
    """The panel's window: one location in time order.

    A panel holds at most one row per location and grid step, so a window partition is
    bounded by the length of the calendar whatever the number of raw observations was.
    """
    return Window.partitionBy("mws_id").orderBy("date", *more)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing_to_null(c, sentinel: float | None = SENTINEL) -> Column:
    """NaN and the sentinel become NULL."""
    c = col(c)
    bad = F.isnan(c) if sentinel is None else (F.isnan(c) | (c == F.lit(sentinel)))
    return F.when(~bad, c)


def clip(c, low=None, high=None) -> Column:
    """Clip that keeps NULL (``least``/``greatest`` would skip it)."""
    c = col(c)
    out = c
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    return F.when(c.isNotNull(), out)


def flags(*pairs) -> Column:
    """Array of the labels whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, label) for cond, label in pairs]))


def ladder(cases, default) -> Column:
    """``when`` chain from (condition, value) pairs."""
    first, *rest = cases
    start = F.when(first[0], first[1])
    return reduce(lambda acc, cv: acc.when(cv[0], cv[1]), rest, start).otherwise(default)


def rounded(c, digits=6) -> Column:
    """Rounded for output, halves away from zero; the nudge keeps a value that sits on a rounding
    boundary from depending on the order in which a distributed sum was added up.

    ``F.round`` makes a decimal of every double. Whole units are counted instead while a double holds
    them exactly; larger values, NaN and infinities are left to ``F.round``.
    """
    v, unit = col(c) + 1e-9, float(10 ** digits)
    size = F.floor(F.abs(v) * unit + 0.5) / unit
    return F.when(F.abs(v) * unit < 1e15, F.when((v < 0) & (size > 0), -size).otherwise(size)).otherwise(F.round(v, digits))


def round_cols(df, cols, digits=6):
    return df.withColumns({c: rounded(c, digits) for c in cols})


def r2(truth, pred) -> Column:
    """Coefficient of determination as one aggregate; below two rows it is NULL.

    A constant truth gives 1.0 for a perfect prediction and 0.0 otherwise.
    """
    both = col(truth).isNotNull() & col(pred).isNotNull()
    t = F.when(both, col(truth))
    p = F.when(both, col(pred))
    ss_res = F.sum((t - p) * (t - p))
    ss_tot = F.var_pop(t) * F.count(t)
    return F.when(F.count(t) >= 2, F.when(ss_tot > 0, 1 - F.try_divide(ss_res, ss_tot))
                  .otherwise(F.when(ss_res == 0, 1.0).otherwise(0.0)))


def seeded_hash(seed: int, *cols: str) -> Column:
    """The first 15 hex digits of the md5 of the columns and the seed: the same in every engine."""
    return F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed)))), 1, 15)


def seeded_share(seed: int, *cols: str) -> Column:
    """A number from 0 to 1 drawn by the columns and the seed."""
    return F.conv(seeded_hash(seed, *cols), 16, 10).cast("double") / float(16 ** 15)
