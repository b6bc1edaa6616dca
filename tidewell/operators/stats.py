"""Tests of a mask of days against forward returns: masks, effects, rank correlations, incremental R2, rotations, corrections.

Rows are (series, d, m, r): m whether the day is masked, r the return that follows it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import series as S
from tidewell.operators import rolling

OPERATORS = {"<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, ">": lambda a, b: a > b}


def operator_of(text: Column) -> Column:
    """The first of OPERATORS, in their order, that a rule in words holds; null where there is none."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(sign)), F.lit(sign)) for sign in OPERATORS])


def mask(metric: DataFrame, q: float = 0.8, operator: str = ">", days: int = 365, warm_up: int = 365) -> DataFrame:
    """series, d, value, m: value against the quantile of the days before it; days of warm-up and without a quantile are left out."""
    first = metric.groupBy("series").agg(F.min("d").alias("first"))
    x = rolling.quantiles_of_days(metric, "value", {"th": q}, days).join(first, "series")
    x = x.where(F.col("th").isNotNull() & (F.col("d") >= F.date_add("first", warm_up)))
    return x.select("series", "d", "value", OPERATORS[operator](F.col("value"), F.col("th")).alias("m"))


def forward_returns(bars: DataFrame, n: int = 30) -> DataFrame:
    """series, d, r: what the close n rows later is over this one, less 1; rows without it are left out."""
    return bars.select("series", "d", (S.after(S.close(), n) / S.close() - 1).alias("r")).where("r IS NOT NULL")


def runs(masked: DataFrame) -> DataFrame:
    """series, m, a, n: runs of rows of one value."""
    new = F.coalesce((F.col("m") != S.before(F.col("m"))).cast("int"), F.lit(1))
    numbered = masked.withColumn("new", new).withColumn("run", F.sum("new").over(S.so_far()))
    return numbered.groupBy("series", "run", "m").agg(F.min("d").alias("a"), F.count("*").alias("n")).drop("run")


def theta(r: str = "r") -> Column:
    """Aggregate: difference of the medians of masked and other rows; null without rows on a side."""
    return F.percentile(F.when(F.col("m"), F.col(r)), F.lit(0.5)) - F.percentile(F.when(~F.col("m"), F.col(r)), F.lit(0.5))


def average_rank(x: str, within: list[str]) -> Column:
    w = W.partitionBy(*within)
    return F.rank().over(w.orderBy(x)) + (F.count("*").over(W.partitionBy(*within, x)) - 1) / 2


def pearson(x: str, y: str) -> Column:
    """Aggregate with guards: null under 3 pairs or where one side doesn't vary."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)) >= 3) & (spread > 0), F.covar_pop(x, y) / F.when(spread > 0, spread))


def spearman(df: DataFrame, x: str, y: str, within: list[str]) -> DataFrame:
    """within, n, rho: rank correlation with average ranks."""
    ranked = df.withColumns({"_x": average_rank(x, within), "_y": average_rank(y, within)})
    return ranked.groupBy(*within).agg(F.count("*").alias("n"), pearson("_x", "_y").alias("rho"))


def incremental_r2(df: DataFrame, base: list[str], added: str, y: str) -> DataFrame:
    """series, n, r2, gain: R2 of y on base with intercept and what added adds to it (percentage points).

    One pass gathers the covariances; their Cholesky factor is worked out in columns. Null where a column depends on others.
    """
    names = [*base, added, y]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    sums = [F.covar_pop(F.col(names[i]).cast("double"), F.col(names[j]).cast("double")).alias(f"s{i}_{j}") for i, j in pairs]
    return cholesky_gain(df.dropna(subset=names).groupBy("series").agg(F.count("*").alias("n"), *sums), len(base), ["series"])


def cholesky_gain(cov: DataFrame, n_base: int, by: list[str]) -> DataFrame:
    """cov: by, n and covariances s{i}_{j} of base, added and y. by, n, r2, gain, by the Cholesky factor of each row's covariances, batches of rows at once."""
    k = n_base + 2
    kinds = {f.name: f.dataType.simpleString() for f in cov.schema.fields}

    def factor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f: dict[tuple[int, int], np.ndarray] = {}
            for j in range(k):
                for i in range(j, k):
                    left = pdf[f"s{i}_{j}"].to_numpy(dtype=float) - sum(f[i, m] * f[j, m] for m in range(j))
                    f[i, j] = np.sqrt(np.where(left > 1e-18, left, np.nan)) if i == j else left / f[j, j]
            share = [f[k - 1, m] ** 2 / pdf[f"s{k - 1}_{k - 1}"].to_numpy(dtype=float) for m in range(k - 1)]
            whole = np.isfinite(f[k - 1, k - 1])
            yield pdf[[*by, "n"]].assign(r2=np.where(whole, sum(share[:-1]), np.nan), gain=np.where(whole, 100 * share[-1], np.nan))

    out = cov.mapInPandas(factor, ", ".join([*(f"{c} {kinds[c]}" for c in by), "n long", "r2 double", "gain double"]))
    return out.select(*by, "n", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("r2", "gain")])


def benjamini_yekutieli(p: DataFrame, q: float = 0.05, least: int = 3) -> DataFrame:
    """p: id, p. Adds rank, limit and accepted: step-up under any dependence. The number of tests is small; the ranks need one sort."""
    order = W.orderBy("p", "id")
    m = F.greatest(F.count("*").over(W.partitionBy()), F.lit(least))
    ranked = p.select("id", "p", F.row_number().over(order).alias("rank"), m.cast("int").alias("m"))
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("m")), F.lit(0.0), lambda a, j: a + 1 / j)
    ranked = ranked.withColumn("limit", F.col("rank") / F.col("m") * q / harmonic)
    last = F.max(F.when(F.col("p") <= F.col("limit"), F.col("rank"))).over(W.partitionBy())
    return ranked.withColumn("accepted", F.coalesce(F.col("rank") <= last, F.lit(False))).select("id", "p", "rank", "limit", "accepted")


def trimmed_mean(df: DataFrame, x: str, by: list[str], share: float = 0.10) -> DataFrame:
    """Mean without the share smallest and largest (rounded down to rows)."""
    w = W.partitionBy(*by)
    ranked = df.where(F.col(x).isNotNull()).select(*by, x, F.row_number().over(w.orderBy(x)).alias("i"), F.count("*").over(w).alias("n"))
    cut = F.floor(F.col("n") * share)
    return ranked.where((F.col("i") > cut) & (F.col("i") <= F.col("n") - cut)).groupBy(*by).agg(F.avg(x).alias("trimmed"))


def hodges_lehmann(df: DataFrame) -> DataFrame:
    """series, shift: the median of the differences of all masked and all other returns; null without rows on a side.

    No pair is made: how many differences are at most x is counted by binary search in the sorted sides, and x is bisected. A series has one row a day.
    """

    def shift(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.sort(pdf.loc[pdf["m"] == side, "r"].to_numpy(dtype=float)) for side in (True, False))
        n = len(a) * len(b)
        found = (_nth_difference(a, b, (n - 1) // 2) + _nth_difference(a, b, n // 2)) / 2 if n else None
        return pd.DataFrame({"series": [pdf["series"].iloc[0]], "shift": pd.Series([found], dtype="float64")})

    return df.select("series", "m", "r").groupBy("series").applyInPandas(shift, f"series {df.schema['series'].dataType.simpleString()}, shift double")


def _nth_difference(a: np.ndarray, b: np.ndarray, n: int) -> float:
    """The nth smallest (from 0) of all a - b, both sorted."""
    low, high = a[0] - b[-1], a[-1] - b[0]
    at_most = lambda x: int((len(b) - np.searchsorted(b, a - x, side="left")).sum())
    while True:
        middle = low + (high - low) / 2
        if middle <= low or middle >= high:
            break
        low, high = (low, middle) if at_most(middle) > n else (middle, high)
    return float(low if at_most(low) > n else high)


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """95 % interval of a share k of n; nulls for n = 0."""
    n = F.when(n > 0, n)
    p, d = k / n, 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    middle = (p + z * z / (2 * n)) / d
    return F.greatest(middle - half, F.lit(0.0)), F.least(middle + half, F.lit(1.0))


def clopper_pearson(k: Column, n: Column, level: float = 0.05) -> Column:
    """Struct low, high: the exact interval of a share k of n, by bisecting the binomial tails; null for n = 0 or nulls."""

    @F.pandas_udf("low double, high double")
    def interval(ks: pd.Series, ns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_exact_interval(a, b, level / 2) for a, b in zip(ks, ns, strict=True)], columns=["low", "high"])

    return interval(k.cast("double"), n.cast("double"))


def _exact_interval(k: float, n: float, tail: float) -> tuple[float | None, float | None]:
    if not n > 0 or np.isnan(k):
        return None, None
    k, n = int(k), int(n)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])

    def sought(first: int, last: int, rises: bool) -> float:
        """Where the probability of first to last hits is the tail's."""
        j = np.arange(first, last + 1)
        ways, low, high = logs[n] - logs[j] - logs[n - j], 0.0, 1.0
        for _ in range(60):
            p = (low + high) / 2
            below = np.exp(ways + j * np.log(p) + (n - j) * np.log1p(-p)).sum() < tail
            low, high = (p, high) if below == rises else (low, p)
        return (low + high) / 2

    return (0.0 if k == 0 else sought(k, n, True)), (1.0 if k == n else sought(0, k, False))


def weighted_quantile(df: DataFrame, x: str, weight: str, q: float, by: list[str]) -> DataFrame:
    """Linear interpolation of x over the cumulative share of weight."""
    w = W.partitionBy(*by)
    order = w.orderBy(x, weight)
    c = df.select(*by, F.col(x).alias("x"), (F.sum(weight).over(order.rowsBetween(W.unboundedPreceding, 0)) / F.sum(weight).over(w)).alias("c"))
    c = c.withColumns({"px": F.lag("x").over(w.orderBy("c", "x")), "pc": F.lag("c").over(w.orderBy("c", "x")), "last": F.max("c").over(w), "top": F.max("x").over(w)})
    at = F.when(F.col("pc").isNull() & (F.col("c") >= q), F.col("x")).when((F.col("c") >= q) & (F.col("pc") < q), F.col("px") + (F.col("x") - F.col("px")) * (q - F.col("pc")) / (F.col("c") - F.col("pc")))
    return c.groupBy(*by).agg(F.coalesce(F.min(at), F.max("top")).alias("quantile"))


def pinball(y: Column, q: Column, tau: float) -> Column:
    return F.avg(F.when(y <= q, (1 - tau) * (q - y)).otherwise(tau * (y - q)))


def ar1(df: DataFrame, x: str = "value") -> DataFrame:
    """series, mean, phi (of lag 1, within 0.999), sd of the residuals."""
    c = df.withColumn("c", F.col(x) - F.avg(x).over(S.whole())).withColumn("b", S.before(F.col("c")))
    sums = c.where("b IS NOT NULL").groupBy("series").agg((F.sum(F.col("c") * F.col("b")) / F.sum(F.when(F.col("b") != 0, F.col("b") * F.col("b")))).alias("phi"))
    fitted = c.join(sums, "series").withColumn("phi", F.least(F.greatest(F.coalesce("phi", F.lit(0.0)), F.lit(-0.999)), F.lit(0.999)))
    return fitted.groupBy("series", "phi").agg(F.avg(x).alias("mean"), F.stddev_samp(F.col("c") - F.col("phi") * F.col("b")).alias("sd"))


def sign_consistency(quarters: DataFrame, sign: Column | int, least: int = 3) -> DataFrame:
    """quarters: series, t (null where not evaluable). series, n, undefined, same, verdict: whether more than half of the n quarters have the sign.

    A quarter of 0 counts against it. No verdict ("none") under least quarters and at exactly half.
    """
    got = quarters.groupBy("series").agg(F.count("t").alias("n"), F.count_if(F.col("t").isNull()).alias("undefined"), F.count_if(F.signum("t") == sign).alias("same"))
    return got.select("series", "n", "undefined", "same", majority(F.col("same"), F.col("n"), least).alias("verdict"))


def majority(same: Column, n: Column, least: int = 3) -> Column:
    return F.when((n < least) | (2 * same == n), "none").when(2 * same > n, "yes").otherwise("no")


def isotonic_blocks(points: list[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """Pool adjacent violators: (first x, last x, level) of the weighted rising fit; points: x, y, weight in order of x."""
    out: list[list[float]] = []
    for x, y, w in points:
        out.append([x, x, y, w])
        while len(out) > 1 and out[-2][2] >= out[-1][2]:
            b, a = out.pop(), out.pop()
            out.append([a[0], b[1], (a[2] * a[3] + b[2] * b[3]) / (a[3] + b[3]), a[3] + b[3]])
    return [(a, b, level) for a, b, level, _ in out]
