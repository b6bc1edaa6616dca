"""Point-in-time bands for the range of the next rows: three models, each told only what was known on its day.

A row's range is known AHEAD rows later, so a day's models learn from the rows at least that far back (the embargo). Model A: quantiles of the ranges
that began in the day's quarter of volatility, quarters by the volatilities learnt from; B: quantiles of the ranges in units of volatility; C: the same,
weights halving each HALF_LIFE rows. Rows come in order and go into trees of sums over ranks, one step a row, so a day asks the state
that it is entitled to in logarithmic time: nothing is sorted or joined for a day. Weights relative to each other don't depend on the day that asks, so
one tree serves all days. Only model A looks at its quarter's rows one by one.

A series is dealt in blocks of ROWS days; a task builds its block's state from the rows before it. A series has a row a day, so a block's
copy is small and a century has 36 blocks; series are independent.

Defined cases: rows whose range or volatility isn't known, or whose volatility is 0, teach nothing and have no bands; a day that nothing (or, for A, no row of
its quarter) teaches has nulls; equal values are taken in order of time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import series as S
from tidewell.operators import rolling, scan
from tidewell.session import ship

#: Rows ahead, rows of volatility, days of a year, half-life in rows, quantiles, quarters.
AHEAD, LOOK_BACK, YEAR, HALF_LIFE = 30, 30, 365, 3 * 365
SHARES, QUARTERS = (0.75, 0.95), (0.25, 0.5, 0.75)
ROWS = 1024
MODELS = ("a", "b", "c")


class Sums:
    """A tree of sums over n ranks (Fenwick's): add to a rank, find where the running sum reaches a target."""

    def __init__(self, n: int):
        self.n, self.top, self.total = n, 1 << max(n.bit_length() - 1, 0), 0.0
        self.tree = [0.0] * (n + 1)

    def add(self, rank: int, w: float) -> None:
        self.total += w
        rank += 1
        while rank <= self.n:
            self.tree[rank] += w
            rank += rank & -rank

    def below(self, rank: int) -> float:
        """The sum of the ranks before rank."""
        out = 0.0
        while rank:
            out += self.tree[rank]
            rank -= rank & -rank
        return out

    def reach(self, target: float) -> int:
        """The first rank whose running sum is target or more."""
        at, left, step = 0, target, self.top
        while step:
            if at + step <= self.n and self.tree[at + step] < left:
                at += step
                left -= self.tree[at]
            step >>= 1
        return min(at, self.n - 1)


class Ordered:
    """Values that come in order of time, with weights; quantiles of those that have come."""

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(values, kind="stable")
        self.sorted = values[self.order].tolist()
        self.rank = np.empty(len(values), np.int64)
        self.rank[self.order] = np.arange(len(values))
        self.counts, self.weights = Sums(len(values)), Sums(len(values))

    def come(self, i: int, w: float) -> None:
        self.counts.add(int(self.rank[i]), 1.0)
        self.weights.add(int(self.rank[i]), w)

    def quantile(self, q: float) -> float:
        """Linear between order statistics."""
        place = q * (self.counts.total - 1)
        low = int(place)
        a = self.sorted[self.counts.reach(low + 1)]
        b = self.sorted[self.counts.reach(min(low + 2, int(self.counts.total)))]
        return a + (b - a) * (place - low)

    def weighted(self, q: float) -> float:
        """Linear between running shares of weight; the least value below the first of them."""
        at = self.weights.reach(q * self.weights.total)
        before, own = self.weights.below(at), self.weights.below(at + 1)
        n = self.counts.below(at)
        if not n:
            return self.sorted[at]
        last = self.sorted[self.counts.reach(n)]
        return last + (self.sorted[at] - last) * (q * self.weights.total - before) / (own - before)


def block_bands(place: np.ndarray, vol: np.ndarray, amp: np.ndarray, first: int, ahead: int, half_life: float) -> np.ndarray:
    """Bands (a row of six numbers a place) of the places from first on. Places rise, and all values are known."""
    r = np.log1p(amp) / (vol * np.sqrt(ahead / YEAR))
    by_vol, by_r = Ordered(vol), Ordered(r)
    by_amp = np.argsort(amp, kind="stable")
    rank_of = by_vol.rank[by_amp]
    out, come = np.full((len(place), 6), np.nan), 0
    for t in range(int(np.searchsorted(place, first)), len(place)):
        known = int(np.searchsorted(place, place[t] - ahead, "right"))
        for i in range(come, known):
            by_vol.come(i, 1.0)
            by_r.come(i, 2.0 ** ((place[i] - first) / half_life))
        come = known
        if not known:
            continue
        cuts = [by_vol.quantile(q) for q in QUARTERS]
        mine = int(np.searchsorted(cuts, vol[t], side="right"))
        edges = [0, *np.searchsorted(by_vol.sorted, cuts, side="left").tolist(), len(place)]
        like = amp[by_amp[(by_amp < known) & (rank_of >= edges[mine]) & (rank_of < edges[mine + 1])]]
        scale = vol[t] * np.sqrt(ahead / YEAR)
        for k, q in enumerate(SHARES):
            if len(like):
                at = q * (len(like) - 1)
                low = int(at)
                out[t, k] = like[low] + (like[min(low + 1, len(like) - 1)] - like[low]) * (at - low)
            out[t, 2 + k] = np.expm1(by_r.quantile(q) * scale)
            out[t, 4 + k] = np.expm1(by_r.weighted(q) * scale)
    return out


def known_ranges(bars: DataFrame, ahead: int = AHEAD) -> DataFrame:
    """series, d, vol, amp, fall: volatility of the LOOK_BACK log returns, and the range and the deepest fall of the ahead rows that follow."""
    lret = F.log(S.close() / S.before(S.close()))
    x = bars.select("series", "d", "close", lret.alias("x")).withColumn("vol", S.volatility(F.col("x"), LOOK_BACK, YEAR))
    w = S.rows(0, ahead)
    whole = F.count("close").over(w) == ahead + 1
    amp, fall = F.max("close").over(w) / F.min("close").over(w) - 1, 1 - F.min("close").over(w) / S.close()
    return x.select("series", "d", "vol", F.when(whole, amp).alias("amp"), F.when(whole, fall).alias("fall"))


def bands(ranges: DataFrame, start: str, ahead: int = AHEAD, half_life: float = HALF_LIFE) -> DataFrame:
    """series, d, amp, fall, a75, a95, b75, b95, c75, c95 of the days from start on whose range (known_ranges) is known."""
    ship(ranges.sparkSession)
    placed = rolling.numbered(ranges, "series", "d", scan.day_blocks())
    own = placed.where("vol > 0 AND amp IS NOT NULL").withColumn("block", F.floor(F.col("_place") / ROWS))
    last = own.groupBy("series").agg(F.max("block").alias("last"))
    dealt = own.join(last, "series").withColumn("to", F.explode(F.sequence("block", "last"))).drop("last")
    names = [f"{m}{round(q * 100)}" for m in MODELS for q in SHARES]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place", ignore_index=True)
        to = int(pdf["to"].iloc[0])
        found = block_bands(pdf["_place"].to_numpy(), pdf["vol"].to_numpy(), pdf["amp"].to_numpy(), to * ROWS, ahead, half_life)
        out = pdf[["series", "d", "amp", "fall"]].join(pd.DataFrame(found, columns=names))
        return out[pdf["block"] == to]

    kinds = ", ".join(f"{n} double" for n in ("amp", "fall", *names))
    found = dealt.groupBy("series", "to").applyInPandas(work, f"series string, d date, {kinds}").where(F.col("d") >= F.lit(start).cast("date"))
    return found.select("series", "d", "amp", "fall", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])


def judged(found: DataFrame, periods: list[tuple[str, str, str]]) -> DataFrame:
    """series, period, model, n, cover75, cover95, width75, width95, loss (pinball, both quantiles), cover_fall of bands in periods (name, from, to)."""
    period = F.coalesce(*[F.when(F.col("d").between(F.lit(a).cast("date"), F.lit(z).cast("date")), F.lit(n)) for n, a, z in periods])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), *[F.col(f"{m}{round(q * 100)}").alias(f"q{round(q * 100)}") for q in SHARES]) for m in MODELS]))
    x = found.withColumn("period", period).where("period IS NOT NULL").select("series", "period", "amp", "fall", each.alias("m")).select("*", "m.*").where("q75 IS NOT NULL")
    missed = lambda q, share: F.when(F.col("amp") <= F.col(q), (1 - share) * (F.col(q) - F.col("amp"))).otherwise(share * (F.col("amp") - F.col(q)))
    share = lambda c: F.avg(c.cast("double"))
    return x.groupBy("series", "period", "model").agg(
        F.count("*").alias("n"),
        share(F.col("amp") <= F.col("q75")).alias("cover75"),
        share(F.col("amp") <= F.col("q95")).alias("cover95"),
        F.avg("q75").alias("width75"),
        F.avg("q95").alias("width95"),
        (F.avg(missed("q75", SHARES[0])) + F.avg(missed("q95", SHARES[1]))).alias("loss"),
        share(F.col("fall") <= F.col("q95") / 2).alias("cover_fall"),
    )
