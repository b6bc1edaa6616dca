"""Curves of a share over a variable, their weights and resamples, and quantiles by block bootstrap.

Draws are made from hashes (md5 of the draw's and the item's number), so reruns agree and any engine can repeat them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators import nulls, stats

ROUNDS, RIDGE, EDGE = 25, 1e-6, 35.0


def logistic(points: DataFrame, by: list[str]) -> DataFrame:
    """points: by, x, hits, weight (hits of weight, summed over equal x). by, intercept, slope: weighted logistic fit by Newton's steps with a small ridge.

    A by's points are its distinct x; they fit one row. Null where there are none.
    """
    rows = points.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("x", "hits", "weight")]))).alias("points"))

    def step(acc: Column, _: Column) -> Column:
        def add(s: Column, p: Column) -> Column:
            eta = F.least(F.greatest(acc["a"] + acc["b"] * p["x"], F.lit(-EDGE)), F.lit(EDGE))
            q = 1 / (1 + F.exp(-eta))
            v, g = p["weight"] * q * (1 - q), p["hits"] - p["weight"] * q
            terms = {"h0": v, "h1": v * p["x"], "h2": v * p["x"] * p["x"], "g0": g, "g1": g * p["x"]}
            return F.struct(*[(s[name] + t).alias(name) for name, t in terms.items()])

        zero = F.struct(*[F.lit(0.0).alias(c) for c in ("h0", "h1", "h2", "g0", "g1")])
        return F.transform(F.array(F.aggregate("points", zero, add)), lambda s: _newton(acc, s))[0]

    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    fitted = rows.withColumn("fit", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step))
    return fitted.select(*by, F.col("fit.a").alias("intercept"), F.col("fit.b").alias("slope"))


def _newton(acc: Column, s: Column) -> Column:
    h0, h2, g0, g1 = s["h0"] + RIDGE, s["h2"] + RIDGE, s["g0"] - RIDGE * acc["a"], s["g1"] - RIDGE * acc["b"]
    det = h0 * h2 - s["h1"] * s["h1"]
    return F.struct((acc["a"] + (h2 * g0 - s["h1"] * g1) / det).alias("a"), (acc["b"] + (h0 * g1 - s["h1"] * g0) / det).alias("b"))


def predicted(intercept: Column, slope: Column, x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(intercept + slope * x, F.lit(-EDGE)), F.lit(EDGE))))


def isotonic(points: DataFrame, by: str) -> DataFrame:
    """points: by, x, hits, weight. by, x, level: the weighted rising fit at each x. A by's points are its distinct x."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x").reset_index(drop=True)
        blocks = stats.isotonic_blocks(list(zip(pdf["x"], pdf["hits"] / pdf["weight"], pdf["weight"], strict=True)))
        levels = [level for x in pdf["x"] for first, last, level in blocks if first <= x <= last]
        return pd.DataFrame({by: pdf[by], "x": pdf["x"], "level": levels})

    typed = points.select(by, *[F.col(c).cast("double").alias(c) for c in ("x", "hits", "weight")])
    return typed.groupBy(by).applyInPandas(fit, f"{by} {typed.schema[by].dataType.simpleString()}, x double, level double")


def mixture_weights(generated: DataFrame, cases: DataFrame, prevalence: dict[str, float]) -> DataFrame:
    """generated: level, n_generated; cases: level, n. level, weight of a case (prevalence over n_generated), and the level's share of all weight."""
    wanted = F.lit(None).cast("double")
    for level, p in prevalence.items():
        wanted = F.when(F.col("level") == level, F.lit(p)).otherwise(wanted)
    j = generated.join(cases, "level").withColumn("weight", wanted / F.col("n_generated")).where("weight > 0 AND n > 0")
    total = j.agg(F.sum(F.col("weight") * F.col("n")).alias("total"))
    return j.join(F.broadcast(total)).select("level", "n_generated", "n", "weight", (F.col("weight") * F.col("n") / F.col("total")).alias("composition"))


def picked(draw: Column, item: Column, n: Column) -> Column:
    """A place from 0 to n - 1 for an item of a draw: md5 of "draw:item", its first 7 digits."""
    h = F.md5(F.concat_ws(":", draw.cast("string"), item.cast("string")))
    return F.conv(F.substring(h, 1, 7), 16, 10).cast("long") % n


def quantile(ordered: Column, share: Column | float) -> Column:
    """Of a sorted array, by linear interpolation."""
    at = (F.size(ordered) - 1) * share
    low = F.floor(at).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return a + (b - a) * (at - low)


def block_bootstrap(df: DataFrame, shares: list[float], draws: int, block: int = 90) -> DataFrame:
    """df: series, d, value. series, share, n, quantile, low, high: the 2.5 and 97.5 % points of the quantile over draws of circular blocks.

    A series' values fit one row (one a day); the draws are dealt over the cluster.
    """
    rows = df.where("value IS NOT NULL").groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", F.col("value").cast("double").alias("v")))), lambda x: x["v"]).alias("x"))
    rows = rows.select("series", "x", F.size("x").alias("n"))
    starts = F.transform(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1), lambda j: picked(F.col("k"), j, F.col("n")))
    drawn = nulls.dealt(rows, F.sequence(F.lit(0), F.lit(draws - 1)), "k").withColumn("starts", starts)
    places = F.slice(F.flatten(F.transform("starts", lambda s: F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda o: (s + o) % F.col("n")))), 1, F.col("n"))
    sample = drawn.select("series", F.sort_array(F.transform(places, lambda p: F.get("x", p.cast("int")))).alias("s"))
    each = lambda of: F.array(*[quantile(F.col(of), q) for q in shares])
    got = sample.select("series", F.posexplode(each("s")).alias("j", "q")).groupBy("series", "j").agg(F.percentile("q", F.lit(0.025)).alias("low"), F.percentile("q", F.lit(0.975)).alias("high"))
    real = rows.select("series", "n", F.sort_array("x").alias("s")).select("series", "n", F.posexplode(each("s")).alias("j", "quantile"))
    share = F.element_at(F.array(*map(F.lit, shares)), F.col("j") + 1)
    return real.join(got, ["series", "j"]).select("series", share.alias("share"), "n", "quantile", "low", "high")
