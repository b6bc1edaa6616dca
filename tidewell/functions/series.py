"""Column expressions over the long model: rows of (series, d, values), windows within a series by date.

A window over k rows gives null until it holds k non-null values, and where one of its values is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SERIES, DAY = "series", "d"


def close() -> Column:
    return F.col("close")


def ordered():
    return W.partitionBy(SERIES).orderBy(DAY)


def rows(first: int, last: int):
    return ordered().rowsBetween(first, last)


def trailing(k: int):
    """The last k rows, the current one included."""
    return rows(-(k - 1), 0)


def so_far():
    return ordered().rowsBetween(W.unboundedPreceding, 0)


def whole():
    return W.partitionBy(SERIES)


def guarded(agg: Callable[[Column], Column], x: Column, k: int) -> Column:
    """agg of the last k values, null unless there are k."""
    return F.when(F.count(x).over(trailing(k)) == k, agg(x).over(trailing(k)))


def sma(x: Column, k: int) -> Column:
    return guarded(F.avg, x, k)


def before(x: Column, k: int = 1) -> Column:
    return F.lag(x, k).over(ordered())


def after(x: Column, k: int = 1) -> Column:
    return F.lead(x, k).over(ordered())


def change(x: Column, k: int = 1) -> Column:
    """x over its value k rows ago, less 1."""
    return x / before(x, k) - 1


def true_range(high: Column, low: Column, close: Column) -> Column:
    previous = before(close)
    return F.greatest(high - low, F.abs(high - previous), F.abs(low - previous))


def volatility(returns: Column, k: int = 30, days: int = 365) -> Column:
    return guarded(F.stddev_samp, returns, k) * F.sqrt(F.lit(float(days)))


def drawdown(x: Column) -> Column:
    return x / F.max(x).over(so_far()) - 1


def filled(x: Column, most: int | None = None) -> Column:
    """The last non-null value, at most that many rows old."""
    return F.last(x, ignorenulls=True).over(so_far() if most is None else rows(-most, 0))


def filled_back(x: Column) -> Column:
    """The next non-null value."""
    return F.first(x, ignorenulls=True).over(ordered().rowsBetween(0, W.unboundedFollowing))


def population_sd(x: Column, k: int) -> Column:
    """Standard deviation over k rows, divided by k."""
    return guarded(F.stddev_pop, x, k)


def span_of_rows(k: int) -> Column:
    """Days from a row to the one k rows on."""
    return F.date_diff(after(F.col(DAY), k), F.col(DAY))


def correlation(x: Column, y: Column, k: int) -> Column:
    """Pearson's of the last k pairs; null unless there are k, and where one side doesn't vary."""
    both = x.isNotNull() & y.isNotNull()
    x, y, w = F.when(both, x), F.when(both, y), trailing(k)
    spread = F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w)
    return F.when(F.count(x).over(w) == k, F.covar_pop(x, y).over(w) / F.when(spread > 0, spread))


def strict_percentile(x: Column, now: Column) -> Column:
    """Aggregate: share of x below now, in hundredths; nulls of x don't count."""
    return F.avg(F.when(x.isNotNull(), (x < now).cast("double"))) * 100


def ladder(x: Column, steps: list[tuple[float, str]], rest: str, inclusive: bool = True, missing: str | None = None) -> Column:
    """Label of the first step that x reaches (steps fall); rest below all; missing where x is null."""
    out = F.lit(rest)
    for least, label in reversed(steps):
        out = F.when(x >= least if inclusive else x > least, F.lit(label)).otherwise(out)
    return F.when(x.isNull(), F.lit(missing)).otherwise(out)


def bins(x: Column, cuts: list[float], labels: list[str]) -> Column:
    """labels[i] for the first cut above x; a value equal to a cut belongs above it."""
    out = F.lit(labels[-1])
    for cut, label in reversed(list(zip(cuts, labels, strict=False))):
        out = F.when(x < cut, F.lit(label)).otherwise(out)
    return F.when(x.isNotNull(), out)


def rounded(**columns: Column) -> list[Column]:
    """Named doubles with 6 places."""
    return [F.round(c, 6).alias(name) for name, c in columns.items()]
